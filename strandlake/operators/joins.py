"""Lookups, pairings, interval joins and k-mer matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import PIECE, canonical, hamming, pieces, revcomp, words
from strandlake.operators.filters import small
from strandlake.sources.shared import stored


#: Panels of at most so many rows are broadcast.
PANEL = 10_000


def base_name(name: Column) -> Column:
    return F.regexp_replace(F.split_part(name, F.lit(" "), F.lit(1)), "/[12]$", "")


def repair(df: DataFrame, name: str = "name", pair: str = "pair") -> tuple[DataFrame, DataFrame]:
    """(pairs, singles): mates by base name. The first row of a name and mate number counts, by ordinal."""
    rows = df.withColumn("key", base_name(F.col(name)))
    one = lambda n: F.min_by(F.struct("bases", "quals"), F.when(F.col(pair) == n, F.col("ordinal")))
    some = rows.groupBy("key").agg(*[F.min_by(F.when(F.col(pair) == n, F.struct("ordinal", "bases", "quals")), F.when(F.col(pair) == n, F.col("ordinal"))).alias(f"r{n}") for n in (1, 2)])
    both = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    return some.where(both), some.where(~both).select("key", F.coalesce("r1", "r2").alias("r"))


def split_pairs(df: DataFrame, min_length: int) -> DataFrame:
    """Rows with bases1 and bases2 get the class pair, single1, single2 or bad."""
    a, b = F.length("bases1") >= min_length, F.length("bases2") >= min_length
    return df.withColumn("class", F.when(a & b, "pair").when(a, "single1").when(b, "single2").otherwise("bad"))


def mux(spark, paths: list[str]) -> DataFrame:
    """Lines of text files with the file's name before them."""
    lines = spark.read.text(paths).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    return lines.withColumn("value", F.concat_ws("_", "file", "value"))


def merge_barcodes(reads: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Reads (name) with their barcode at the end of the name; barcodes has name and barcode."""
    return reads.join(barcodes.select("name", F.col("barcode").alias("__b")), "name").withColumn("name", F.concat_ws(":", "name", "__b")).drop("__b")


def replace_headers(df: DataFrame, names: DataFrame, prefix: bool = False) -> DataFrame:
    """Names by position: names has ordinal and name."""
    new = names.select("ordinal", F.col("name").alias("__new"))
    return df.join(new, "ordinal").withColumn("name", F.concat_ws(" ", "__new", "name") if prefix else F.col("__new")).drop("__new")


def rename_ref(df: DataFrame, mapping: DataFrame, column: str = "rname") -> DataFrame:
    m = small(mapping.select(F.col(mapping.columns[0]).alias(column), F.col(mapping.columns[1]).alias("__new")).dropDuplicates([column]))
    return df.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def rename_by_mapping(contigs: DataFrame, aln: DataFrame, digits: int = 2) -> DataFrame:
    """contigs (name, length) with coverage and majority taxon in the name; aln has rname, ref_len, taxid."""
    cov = aln.groupBy("rname").agg(F.sum("ref_len").alias("covered"))
    votes = aln.groupBy("rname", "taxid").agg(F.count("*").alias("n"))
    best = votes.groupBy("rname").agg(F.max(F.struct("n", (-F.col("taxid")).alias("t"))).alias("b")).select("rname", (-F.col("b.t")).alias("taxid"))
    rows = contigs.join(cov, F.col("name") == F.col("rname"), "left").drop("rname").join(best, F.col("name") == F.col("rname"), "left").drop("rname")
    text = F.format_string(f"%s cov_%.{digits}f tid_%d", "name", F.coalesce(F.col("covered") / F.col("length"), F.lit(0.0)), F.coalesce("taxid", F.lit(0)))
    return rows.withColumn("renamed", text).drop("covered", "taxid")


def merge_tables(a: DataFrame, b: DataFrame, key_a: str, key_b: str, order: str) -> DataFrame:
    """Full outer join; of rows with one key the last by order counts. Columns of b get the suffix _b."""
    last = lambda df, k: df.withColumn("__n", F.row_number().over(Window.partitionBy(k).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    x = last(a, key_a)
    y = last(b, key_b)
    y = y.select(*[F.col(c).alias(f"{c}_b") for c in y.columns])
    return x.join(y, x[key_a] == y[f"{key_b}_b"], "full_outer").withColumn("key", F.coalesce(key_a, f"{key_b}_b"))


def matrices_to_columns(a: DataFrame, b: DataFrame, row: str) -> DataFrame:
    """Lower triangles of two square matrices (columns named as rows) as (row, column, value_a, value_b)."""
    names = [c for c in a.columns if c != row]
    long = lambda m, v: m.unpivot(row, names, "column", v).where(F.col("column") < F.col(row))
    return long(a, "value_a").join(long(b, "value_b"), [row, "column"])


def transpose(df: DataFrame, key: str, names: list) -> DataFrame:
    """Columns to rows; the values of key (a given list) become columns."""
    rest = [c for c in df.columns if c != key]
    return df.unpivot(key, rest, "column", "value").groupBy("column").pivot(key, names).agg(F.first("value"))


def assign_barcodes(observed: DataFrame, expected: DataFrame, max_hdist: int = 1, clearzone: int = 1, split_at: int = 0, max_sum: int | None = None) -> DataFrame:
    """(barcode, assigned, distance): distinct observed barcodes with the nearest expected one if it is near and the
    runner-up at least clearzone further.

    With split_at, barcodes are two indexes (the first has so many letters; a separator is not counted): max_hdist holds
    for each of them and max_sum for both. Expected barcodes are a panel: it is broadcast if a count shows it small, else
    both sides meet in blocks."""
    from strandlake.operators.similarity import in_blocks

    o, e = observed.select("barcode").distinct(), expected.select(F.col("barcode").alias("expected")).distinct()
    pairs = o.join(F.broadcast(e)) if e.limit(PANEL + 1).count() <= PANEL else in_blocks(o, e, "barcode", "expected")
    cut = lambda c, x: F.left(c, F.lit(split_at)) if x == 0 else F.regexp_replace(F.substring(c, split_at + 1, 1 << 20), "^[^A-Za-z]", "")
    if split_at:
        d1, d2 = (hamming(cut(F.col("barcode"), x), cut(F.col("expected"), x)) for x in (0, 1))
        d, fits = d1 + d2, (d1 <= max_hdist) & (d2 <= max_hdist) & (d1 + d2 <= (2 * max_hdist if max_sum is None else max_sum))
    else:
        d = hamming(F.col("barcode"), F.col("expected"))
        fits = d <= max_hdist
    ranked = pairs.select("barcode", "expected", d.alias("d"), fits.alias("fits"))
    nearest = F.row_number().over(Window.partitionBy("barcode").orderBy("d", "expected"))
    runner_up = F.lead("d").over(Window.partitionBy("barcode").orderBy("d", "expected"))
    best = ranked.withColumns({"n": nearest, "next": runner_up}).where("n = 1")
    clear = F.col("fits") & (F.coalesce("next", F.lit(1 << 20)) - F.col("d") >= clearzone)
    return best.select("barcode", F.when(clear, F.col("expected")).alias("assigned"), F.col("d").cast("bigint").alias("distance"))


def cut_gff(contigs: DataFrame, features: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Feature sequences on their sense strand; 1-based inclusive coordinates, cut at the contig's ends."""
    f = features.where(F.col("type").isin(types)) if types else features
    c = contigs.select(F.col("name").alias("seqid"), F.col("bases").alias("__b"))
    piece = F.substring("__b", F.col("start").cast("int"), (F.col("stop") - F.col("start") + 1).cast("int"))
    return f.join(c, "seqid").withColumn("bases", F.when(F.col("strand") == "-", revcomp(piece)).otherwise(piece)).drop("__b")


def cut_primers(reads: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Bases between the end of the left hit and the start of the right one (hits: name, start, stop; 1-based)."""
    rows = reads.join(left.select("name", F.col("stop").alias("__a")), "name").join(right.select("name", F.col("start").alias("__b")), "name").where("__b > __a")
    return rows.withColumn("bases", F.substring("bases", (F.col("__a") + 1).cast("int"), (F.col("__b") - F.col("__a") - 1).cast("int"))).drop("__a", "__b")


def interval_join(a: DataFrame, b: DataFrame, key: str, bin_size: int = 1000) -> DataFrame:
    """Overlapping rows of two tables with (key, start, stop); b's start and stop get the suffix _b.

    Rows meet in bins, and a pair counts in the first bin that both reach, so no distinct is needed."""
    bins = lambda df: df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("stop") / bin_size))))
    right = b.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c != key}).withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start_b") / bin_size), F.floor(F.col("stop_b") / bin_size))))
    first = F.floor(F.greatest("start", "start_b") / bin_size) == F.col("__bin")
    return bins(a).join(right, [key, "__bin"]).where((F.col("start") <= F.col("stop_b")) & (F.col("start_b") <= F.col("stop")) & first).drop("__bin")


def variant_coverage(variants: DataFrame, depth: DataFrame) -> DataFrame:
    """variants (chrom, pos, ref, alt) with the mean depth (chrom, pos, depth) over their span; for insertions the
    mean of both sides, rounded up."""
    insertion = F.length("alt") > F.length("ref")
    span = F.when(insertion, F.sequence("pos", F.col("pos") + 1)).otherwise(F.sequence("pos", F.col("pos") + F.length("ref") - 1))
    rows = variants.distinct().withColumn("__p", F.explode(span)).join(depth.select("chrom", F.col("pos").alias("__p"), "depth"), ["chrom", "__p"], "left")
    mean = F.sum(F.coalesce("depth", F.lit(0))) / F.count("*")
    return rows.groupBy("chrom", "pos", "ref", "alt").agg(F.when(F.max(F.length("alt")) > F.max(F.length("ref")), F.ceil(mean).cast("double")).otherwise(mean).alias("coverage"))


def filter_sam_vars(read_vars: DataFrame, supported: DataFrame, most: int = 2, keys=("chrom", "pos", "alt"), border: int = 0) -> DataFrame:
    """Reads with more than most variants that are not supported. read_vars has read and the keys; with border also
    end_distance, and variants nearer to an end of their read do not count. pileup.filter_bad_reads works on alignments."""
    read_vars = read_vars.where(F.col("end_distance") >= border) if border else read_vars
    bad = read_vars.join(supported.select(*keys).distinct(), list(keys), "left_anti").groupBy("read").agg(F.count("*").alias("unsupported"))
    return bad.where(F.col("unsupported") > most)


def compare_sam(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """Reads placed right in a and not in b (each: read, rname, pos)."""
    right = lambda df: df.join(truth, ["read", "rname", "pos"], "left_semi").select("read")
    return right(a).join(right(b), "read", "left_anti").distinct()


def kmer_rows(df: DataFrame, id_col: str, k: int, bases: str = "bases", rcomp: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, pos, kmer, and the columns in keep): k-mers of ACGT only, canonical with rcomp, position from 0. They, and what is counted or selected
    of them, are joined by a shuffle: Spark would take them to be as small as the files they come from, and broadcast."""
    cut = df.select(id_col, *keep, F.regexp_replace(bases, "[^ACGT]", "N").alias("__c")).select(id_col, *keep, F.posexplode(pieces(F.col("__c"), k)).alias("__piece", "__c"))
    rows = cut.select(id_col, *keep, "__piece", F.posexplode(words(F.col("__c"), k, rcomp)).alias("pos", "kmer")).where(~F.contains("kmer", F.lit("N")))
    return rows.select(id_col, (F.col("__piece") * PIECE + F.col("pos")).alias("pos"), "kmer", *keep).hint("merge")


def same_sequence(reads: DataFrame, read_id: str) -> DataFrame:
    """(id, __rep): the least id that has the same bases, of ids on one row; ids on several rows stand for themselves."""
    each = reads.groupBy(read_id).agg(F.count("*").alias("__n"), F.first("bases").alias("__b"))
    single = each.where("__n = 1 and __b is not null")
    least = single.groupBy("__b").agg(F.min(read_id).alias("__rep"))
    return single.join(least.hint("merge"), "__b").select(read_id, "__rep").union(each.where("__n > 1").select(read_id, F.col(read_id).alias("__rep")))


def one_of_each(reads: DataFrame, read_id: str) -> tuple[DataFrame, DataFrame]:
    """(same, own): same_sequence, written and read again; and the reads that stand for others, with their number (__w)."""
    same = stored(same_sequence(reads, read_id))
    weight = same.groupBy(F.col("__rep").alias(read_id)).agg(F.count("*").alias("__w"))
    return same, reads.join(weight.hint("merge"), read_id)


def for_each_read(found: DataFrame, same: DataFrame, read_id: str) -> DataFrame:
    """What holds for a read of one_of_each, for all that it stands for."""
    rest = [c for c in found.columns if c != read_id]
    return found.withColumnRenamed(read_id, "__rep").join(same.hint("merge"), "__rep").select(read_id, *rest)


def seal(reads: DataFrame, refs: DataFrame, k: int = 31, min_hits: int = 1, min_fraction: float = 0.0, ambiguous: str = "random", read_id: str = "ordinal", ref_id: str = "name", hdist: int = 0, clearzone: int = 0, mask_middle: bool = False, seed: int = 1, edist: int = 0) -> DataFrame:
    """(read, ref, hits, kmers): the reference with the most k-mers of the read. References within clearzone hits of the
    best are ties: "random" takes one by a hash of read and reference, "first" the first name, "toss" none, "all" all.

    hdist lets a read's k-mer match a reference's with so many other bases, edist with so many bases more or less too;
    mask_middle ignores the middle base (two of an even k) on both sides. With hdist alone, the distinct k-mers of the
    side that has fewer grow to their neighbours, about 3 * k times in each round, and meet those of the other; else a
    reference's k-mers grow, in rounds on distinct rows. A read's equal k-mers are counted before they meet them, and of
    reads of one sequence only one meets them."""
    mid = slice((k - 1) // 2, k // 2 + 1)
    masked = lambda c: F.concat(F.left(c, F.lit(mid.start)), F.lit("N" * (mid.stop - mid.start)), F.substring(c, mid.stop + 1, k)) if mask_middle else F.col(c)
    # a masked k-mer is compared on the strand of its unmasked canonical form
    same = same_sequence(reads, read_id)
    own = reads.join(same.select(F.col("__rep").alias(read_id)).distinct().hint("merge"), read_id, "left_semi")
    r = kmer_rows(own, read_id, k).select(read_id, masked("kmer").alias("kmer")).groupBy(read_id, "kmer").agg(F.count("*").alias("__n"))
    total = r.groupBy(read_id).agg(F.sum("__n").alias("kmers"))
    keys = kmer_rows(refs.withColumnRenamed(ref_id, "__ref"), "__ref", k).select("__ref", "kmer")
    if hdist and not edist and not mask_middle:
        from strandlake.operators.sets import near_kmers

        near = near_kmers(r, keys, hdist).withColumnRenamed("kmer", "__own").withColumnRenamed("other", "kmer")
        keys = near.join(keys.distinct().hint("merge"), "kmer").select("__ref", F.col("__own").alias("kmer"))
    elif hdist or edist:
        from strandlake.operators.sets import kmer_neighbors

        if edist:  # what enters at an end depends on the strand
            keys = keys.select("__ref", F.explode(F.array("kmer", revcomp(F.col("kmer")))).alias("kmer"))
        grown = kmer_neighbors(keys, hdist, keep=("__ref",))
        for _ in range(edist):
            sub, ins, gone = (kmer_neighbors(grown, *x, keep=("__ref",)) for x in ((1, 0, 0), (0, 1, 0), (0, 0, 1)))
            grown = sub.union(ins).union(gone).distinct()
        keys = grown.select("__ref", canonical(F.col("kmer")).alias("kmer"))
    keys = keys.select("__ref", masked("kmer").alias("kmer")).distinct()
    hits = r.join(keys.hint("merge"), "kmer").groupBy(read_id, "__ref").agg(F.sum("__n").alias("hits")).join(total, read_id)
    hits = hits.where((F.col("hits") >= min_hits) & (F.col("hits") >= min_fraction * F.col("kmers")))
    w = Window.partitionBy(read_id)
    top = hits.withColumn("m", F.max("hits").over(w)).where(F.col("hits") >= F.col("m") - clearzone).withColumn("ties", F.count("*").over(w)).drop("m")
    every = lambda df: df.withColumnRenamed(read_id, "__rep").join(same.hint("merge"), "__rep").drop("__rep")
    order = {"first": [F.col("__ref")], "random": [F.xxhash64(read_id, "__ref", F.lit(seed)), F.col("__ref")]}
    if ambiguous == "random":  # each read draws for itself
        top = every(top)
    if ambiguous in order:
        top = top.withColumn("n", F.row_number().over(w.orderBy(*order[ambiguous]))).where("n = 1").drop("n")
    elif ambiguous == "toss":
        top = top.where("ties = 1")
    elif ambiguous != "all":
        raise ValueError(f"ambiguous is random, first, toss or all, not {ambiguous}")
    top = top if ambiguous == "random" else every(top)
    return top.select(F.col(read_id).alias("read"), F.col("__ref").alias("ref"), "hits", "kmers")


def split_ribo(df: DataFrame, refs: DataFrame, k: int = 31, read_id: str = "ordinal") -> DataFrame:
    """Rows with the ribosomal type (refs: type, bases) that shares most k-mers; "other" without any."""
    best = seal(df, refs.withColumnRenamed("type", "name"), k, read_id=read_id, ambiguous="first").select(F.col("read").alias(read_id), F.col("ref").alias("type"))
    return df.join(best, read_id, "left").withColumn("type", F.coalesce("type", F.lit("other")))


def read_positions(df: DataFrame, expected: DataFrame, max_hdist: int = 1) -> DataFrame:
    """(ordinal, x, y, distance): place on the flowcell and distance of the barcode to the nearest expected one."""
    from strandlake.functions.sequence import parse_header

    h = df.select("ordinal", "barcode", parse_header(F.col("name")).alias("h"))
    near = assign_barcodes(df, expected, max_hdist).select("barcode", "distance")
    return h.join(near, "barcode").select("ordinal", "h.x", "h.y", "distance")


def kmer_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two k-mer count tables (kmer, count) to a histogram of (depth_a, depth_b)."""
    x, y = a.select("kmer", F.col("count").alias("depth_a")), b.select("kmer", F.col("count").alias("depth_b"))
    both = x.join(y, "kmer", "full_outer").fillna(0, ["depth_a", "depth_b"])
    return both.groupBy("depth_a", "depth_b").agg(F.count("*").alias("kmers"))


def add_ssu(sketches: DataFrame, ssu: DataFrame) -> DataFrame:
    return sketches.join(ssu.select("taxid", F.col("bases").alias("ssu")).dropDuplicates(["taxid"]), "taxid", "left")


def pair_vectors(contigs: DataFrame, rate: float | None = 0.5, gc_step: float = 0.02, seed: int = 1, max_depth_ratio: float | None = None, max_distance: float | None = None) -> DataFrame:
    """Training rows for pairs of contigs (id, gc, vector, genome, and depth where its ratio is bounded) in neighbouring
    GC cells: differences and the label whether both are of one genome, sampled to the given share of ones (None: all).
    Pairs whose depths differ by a larger ratio, or whose vectors are further apart, are left out."""
    from strandlake.functions.sequence import vector_distance

    cell = F.floor(F.col("gc") / gc_step)
    a = contigs.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    b = contigs.withColumnsRenamed({c: f"{c}_b" for c in contigs.columns}).withColumn("cell_b", F.floor(F.col("gc_b") / gc_step))
    near = a.join(b, F.col("cell") == F.col("cell_b")).where((F.col("id") < F.col("id_b")) | ((F.floor(F.col("gc") / gc_step) != F.col("cell_b")) & (F.col("id") != F.col("id_b"))))
    if max_depth_ratio is not None:
        near = near.where(F.greatest("depth", "depth_b") <= max_depth_ratio * F.least("depth", "depth_b"))
    rows = near.select("id", "id_b", F.abs(F.col("gc") - F.col("gc_b")).alias("gc_difference"), vector_distance(F.col("vector"), F.col("vector_b")).alias("distance"), (F.col("genome") == F.col("genome_b")).cast("int").alias("label"))
    if max_distance is not None:
        rows = rows.where(F.col("distance") <= max_distance)
    if rate is None:
        return rows
    n = rows.groupBy("label").count().toPandas().set_index("label")["count"].to_dict()
    zeros, ones = n.get(0, 0), n.get(1, 0)
    if not zeros or not ones:
        return rows
    share = ones * (1 - rate) / (rate * zeros)
    return rows.sampleBy("label", {1: min(1.0, 1 / share), 0: min(1.0, share)}, seed)


def pair_counts(contigs: DataFrame, gc_step: float = 0.02) -> DataFrame:
    """(id, genome, pairs, same): of the pairs that pair_vectors lists (no bound on depth or distance) those in which a contig
    (unique id, gc, genome) comes first, and of them those of one genome. In its cell its partners are the contigs of
    greater id, in the next cell all: ranks and sums tell their number, so no pair is made. Contigs without pairs have no row."""
    rows = stored(contigs.select("id", "genome", F.floor(F.col("gc") / gc_step).alias("cell"))).where("id is not null and cell is not null")
    rows = stored(rows.repartitionByRange("cell", "id").withColumn("__part", F.spark_partition_id()))  # a cell is many parts in the order of ids

    def partners(keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        n = rows.groupBy(*keys, "__part").agg(F.count("*").alias("n"))
        behind = n.select(*keys, "__part", F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("__part"))).alias(f"__{name}"))
        return behind, n.groupBy(*keys).agg(F.sum("n").alias(f"__next_{name}")).withColumn("cell", F.col("cell") - 1)

    up = lambda *keys: F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("id"))
    each = rows.withColumn("__up_pairs", up("cell")).withColumn("__up_same", up("cell", "genome"))
    for keys, name in ((["cell"], "pairs"), (["cell", "genome"], "same")):
        behind, beyond = partners(keys, name)
        each = each.join(behind, [*keys, "__part"], "left").join(beyond, keys, "left").withColumn(name, F.coalesce(f"__{name}", F.col(f"__up_{name}")) - F.col(f"__up_{name}") + F.coalesce(f"__next_{name}", F.lit(0)))
    return each.where("pairs > 0").select("id", "genome", "pairs", F.when(F.col("genome").isNull(), 0).otherwise(F.col("same")).alias("same"))


def bloom_filter_reads(reads: DataFrame, ref: DataFrame, k: int = 31, min_hits: int = 3, read_id: str = "ordinal") -> DataFrame:
    """(read, longest): reads with min_hits or more consecutive k-mers on the reference."""
    keys = kmer_rows(ref.select(F.col("bases"), F.lit(0).alias("__r")), "__r", k).select("kmer").distinct()
    hit = kmer_rows(reads, read_id, k).join(keys, "kmer", "left_semi")
    island = F.col("pos") - F.row_number().over(Window.partitionBy(read_id).orderBy("pos"))
    runs = hit.withColumn("g", island).groupBy(read_id, "g").agg(F.count("*").alias("run"))
    return runs.groupBy(read_id).agg(F.max("run").alias("longest")).where(F.col("longest") >= min_hits).withColumnRenamed(read_id, "read")


def compare_gff(query: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true and false positives and false negatives of starts and stops. A stop is right if truth has a
    feature of that sequence, strand, type and true stop; then its start may be right as well."""
    ends = lambda df: df.select("seqid", "strand", "type", F.when(F.col("strand") == "-", F.col("start")).otherwise(F.col("stop")).alias("e"), F.when(F.col("strand") == "-", F.col("stop")).otherwise(F.col("start")).alias("s")).dropDuplicates(["seqid", "strand", "type", "e"])
    q, t = ends(query), ends(truth).withColumnRenamed("s", "t")
    both = q.join(t, ["seqid", "strand", "type", "e"], "full_outer")
    return both.agg(
        F.count_if(F.col("s").isNotNull() & F.col("t").isNotNull()).alias("tp_stop"), F.count_if(F.col("t").isNull()).alias("fp_stop"), F.count_if(F.col("s").isNull()).alias("fn_stop"),
        F.count_if(F.col("s") == F.col("t")).alias("tp_start"), F.count_if(F.col("s").isNotNull() & ~F.col("s").eqNullSafe(F.col("t"))).alias("fp_start"), F.count_if(F.col("t").isNotNull() & ~F.col("s").eqNullSafe(F.col("t"))).alias("fn_start"),
    )


def false_positives(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return predicted.join(truth, ["seqid", "start", "stop", "strand"], "left_anti")


def build_training_set(candidates: DataFrame, predictions: DataFrame, truth: DataFrame, keys=("seqid", "start", "stop", "strand")) -> DataFrame:
    """Candidates in truth with label 1; candidates in neither truth nor predictions with label 0."""
    k = list(keys)
    ones = candidates.join(truth.select(k).distinct(), k, "left_semi").withColumn("label", F.lit(1).cast("bigint"))
    known = truth.select(k).union(predictions.select(k)).distinct()
    return ones.unionByName(candidates.join(known, k, "left_anti").withColumn("label", F.lit(0).cast("bigint")))
