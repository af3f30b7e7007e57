"""Row filters over reads, alignments, variants, contigs and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import average_quality, cigar_ops, cigar_sum, count_of, gc, hamming, header_tag, parse_header, revcomp

#: Lookup lists of at most so many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The table, with a broadcast hint if a bounded count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def read_passes(bases: str = "bases", quals: str = "quals", minlen=0, maxlen=None, mingc=0.0, maxgc=1.0, maxns=None, mcb=0, maq=0.0) -> Column:
    b = F.col(bases)
    tests = [F.length(b) >= minlen]
    if maxlen is not None:
        tests.append(F.length(b) <= maxlen)
    if mingc > 0 or maxgc < 1:
        tests.append(gc(b).between(mingc, maxgc))
    if maxns is not None:
        tests.append(count_of(b, "Nn") <= maxns)
    if mcb:
        tests.append(b.rlike(f"[ACGTacgt]{{{mcb},}}"))
    if maq:
        tests.append(average_quality(F.col(quals)) >= maq)
    return reduce(lambda x, y: x & y, tests)


def filter_reads(df: DataFrame, invert: bool = False, **limits) -> DataFrame:
    keep = F.coalesce(read_passes(**limits), F.lit(False))
    return df.where(~keep if invert else keep)


def filter_pairs(df: DataFrame, require_both_bad: bool = True, **limits) -> DataFrame:
    """Rows with bases1/quals1 and bases2/quals2: a pair goes when both mates fail, or either."""
    a, b = read_passes("bases1", "quals1", **limits), read_passes("bases2", "quals2", **limits)
    return df.where(a | b if require_both_bad else a & b)


def filter_junk(df: DataFrame) -> DataFrame:
    """Invalid symbols, unequal lengths of bases and quals, chastity Y and barcodes with N go."""
    h = parse_header(F.col("name"))
    return df.where(~F.col("bases").rlike("[^A-Za-z*.-]") & (F.length("bases") == F.length("quals")) & ~F.coalesce(h["chastity"] == "Y", F.lit(False)) & ~F.coalesce(F.contains(h["barcode"], F.lit("N")), F.lit(False)))


def filter_surface(df: DataFrame, top: bool = True, bottom: bool = False) -> DataFrame:
    """Tiles 1xxx lie on the top surface, 2xxx on the bottom one."""
    side = F.floor(parse_header(F.col("name"))["tile"] / 1000)
    return df.where(((side == 1) & F.lit(top)) | ((side == 2) & F.lit(bottom)))


def filter_by_tag(df: DataFrame, tag: str, low=None, high=None, name: str = "name") -> DataFrame:
    v = header_tag(F.col(name), tag).try_cast("double")
    return df.where((v >= low if low is not None else F.lit(True)) & (v <= high if high is not None else F.lit(True)))


def filter_lines(df: DataFrame, names: DataFrame, mode: str = "exact", include: bool = True, ignore_case: bool = False, column: str = "value") -> DataFrame:
    """Lines that equal, start with, or contain a listed name. The last two compare with each name of a small list."""
    fold = F.lower if ignore_case else (lambda c: c)
    listed = names.select(fold(F.col(names.columns[0])).alias("__name")).distinct()
    line = fold(F.col(column))
    on = {"exact": line == F.col("__name"), "prefix": F.startswith(line, F.col("__name")), "contains": F.contains(line, F.col("__name"))}[mode]
    return df.join(small(listed), on, "left_semi" if include else "left_anti")


def clean_tsv(df: DataFrame, first: int = 10_000, column: str = "value") -> DataFrame:
    """Rows with as many columns as most of the first rows; line ends and trailing tabs are stripped."""
    v = df.withColumn(column, F.regexp_replace(column, "[\\t\\r]+$", "")).withColumn("__n", F.size(F.split(column, "\t")))
    usual = v.limit(first).groupBy("__n").count().orderBy(F.desc("count"), "__n").limit(1).select("__n")
    return v.join(F.broadcast(usual), "__n", "left_semi").drop("__n")


def get_reads(df: DataFrame, ids: DataFrame, column: str = "ordinal") -> DataFrame:
    return df.join(small(ids.select(F.col(ids.columns[0]).alias(column)).distinct()), column, "left_semi")


def filter_by_name(df: DataFrame, names: DataFrame, include: bool = False, mode: str = "exact", column: str = "name") -> DataFrame:
    """Default is to leave listed names out. exact also matches what stands before white space or a pair mark."""
    listed = small(names.select(F.col(names.columns[0]).alias("__name")).distinct())
    how = "left_semi" if include else "left_anti"
    if mode == "exact":
        short = F.regexp_replace(F.split_part(F.col(column), F.lit(" "), F.lit(1)), "/[12]$", "")
        return df.join(listed, (F.col(column) == F.col("__name")) | (short == F.col("__name")), how) if include is None else _two_keys(df, listed, column, short, include)
    on = F.contains(F.col(column), F.col("__name")) if mode == "substring" else F.startswith(F.col(column), F.col("__name"))
    return df.join(listed, on, how)


def _two_keys(df: DataFrame, listed: DataFrame, column: str, short: Column, include: bool) -> DataFrame:
    """Two equi-joins in place of one join with OR, which Spark could only run as a nested loop."""
    marked = df.withColumn("__short", short).join(listed.withColumn("__a", F.lit(True)), F.col(column) == F.col("__name"), "left").drop("__name")
    marked = marked.join(listed.withColumn("__b", F.lit(True)), F.col("__short") == F.col("__name"), "left").drop("__name")
    hit = F.coalesce("__a", "__b", F.lit(False))
    return marked.where(hit if include else ~hit).drop("__a", "__b", "__short")


def filter_by_sequence(df: DataFrame, reference: DataFrame, include: bool = True, subs: int = 0, rcomp: bool = True, bases: str = "bases") -> DataFrame:
    """Reads equal to a reference sequence or its reverse complement; with subs, up to so many substitutions among
    references of equal length that share one of subs + 1 blocks (pigeonhole)."""
    key = (lambda c: F.least(c, revcomp(c))) if rcomp else (lambda c: c)
    how = "left_semi" if include else "left_anti"
    if not subs:
        return df.join(reference.select(key(F.col(bases)).alias("__key")).distinct(), key(F.col(bases)) == F.col("__key"), how)
    ref = reference.select(F.col(bases).alias("__r"))
    ref = (ref.union(ref.select(revcomp(F.col("__r")).alias("__r"))) if rcomp else ref).distinct()
    size = lambda c: F.ceil(F.length(c) / (subs + 1)).cast("int")
    block = lambda c: F.transform(F.sequence(F.lit(0), F.lit(subs)), lambda i: F.struct(i.alias("i"), F.substring(c, i * size(c) + 1, size(c)).alias("s"), F.length(c).alias("n")))
    seeds = ref.select("__r", F.explode(block(F.col("__r"))).alias("__b"))
    reads = df.select(bases).distinct().select(bases, F.explode(block(F.col(bases))).alias("__b"))
    near = reads.join(seeds, "__b").where(hamming(F.col(bases), F.col("__r")) <= subs).select(bases).distinct()
    return df.join(near, bases, how)


def flag(column: str, bit: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(bit)) != 0


def filter_sam(df: DataFrame, mapped=None, primary=None, duplicate=None, min_mapq=0, max_mapq=255, required=0, forbidden=0, contigs=None, start=None, stop=None, min_identity=0.0, invert=False) -> DataFrame:
    """Flag bits of the alignment format (4 unmapped, 256 secondary, 1024 duplicate, 2048 supplementary)."""
    tests = [F.col("mapq").between(min_mapq, max_mapq), F.col("flag").bitwiseAND(F.lit(required)) == required, F.col("flag").bitwiseAND(F.lit(forbidden)) == 0]
    if mapped is not None:
        tests.append(~flag("flag", 4) if mapped else flag("flag", 4))
    if primary is not None:
        tests.append(~flag("flag", 256 | 2048) if primary else flag("flag", 256 | 2048))
    if duplicate is not None:
        tests.append(flag("flag", 1024) if duplicate else ~flag("flag", 1024))
    if contigs:
        tests.append(F.col("rname").isin(contigs))
    if start is not None:
        tests.append((F.col("pos") + cigar_sum(F.col("cigar"), "MDN=X") - 1 >= start) & (F.col("pos") <= stop))
    if min_identity:
        tests.append(F.try_divide(cigar_sum(F.col("cigar"), "="), cigar_sum(F.col("cigar"), "=XID")) >= min_identity)
    keep = F.coalesce(reduce(lambda x, y: x & y, tests), F.lit(False))
    return df.where(~keep if invert else keep)


def split_sam(df: DataFrame, ways: int = 3) -> DataFrame:
    """Adds the route: plus, minus, unmapped; with 4 also chimeric; with 6 mate and strand."""
    unmapped, minus, first = flag("flag", 4), flag("flag", 16), ~flag("flag", 128)
    strand = F.when(minus, "minus").otherwise("plus")
    if ways == 4:
        odd = ~flag("flag", 8) & ((~F.col("rnext").isin("=", "*") & (F.col("rnext") != F.col("rname"))) | (minus == flag("flag", 32))) & flag("flag", 1)
        whole = F.when(minus == first, "minus").otherwise("plus")
        route = F.when(unmapped, "unmapped").when(odd, "chimeric").otherwise(whole)
    elif ways == 6:
        route = F.concat(F.when(first, "r1_").otherwise("r2_"), F.when(unmapped, "unmapped").otherwise(strand))
    else:
        route = F.when(unmapped, "unmapped").otherwise(strand)
    return df.withColumn("route", route)


def edit_counts(df: DataFrame) -> DataFrame:
    """Adds subs, ins, dels, longest_ins, longest_del, clips and identity from the alignment code."""
    ops = cigar_ops(F.col("cigar"))
    longest = lambda op: F.coalesce(F.array_max(F.transform(F.filter(ops, lambda x: x["op"] == op), lambda x: x["n"])), F.lit(0).cast("bigint"))
    c = F.col("cigar")
    made = {"subs": cigar_sum(c, "X"), "ins": cigar_sum(c, "I"), "dels": cigar_sum(c, "D"), "longest_ins": longest("I"), "longest_del": longest("D"), "clips": cigar_sum(c, "SH")}
    return df.withColumns(made).withColumn("identity", F.try_divide(cigar_sum(c, "=M").cast("double"), cigar_sum(c, "=MXID").cast("double")))


def filter_edits(df: DataFrame, max_subs=None, max_indels=None, max_edits=None, max_clips=None, min_identity=None) -> DataFrame:
    e = edit_counts(df)
    tests = [F.lit(True)]
    for limit, value in ((max_subs, F.col("subs")), (max_indels, F.col("ins") + F.col("dels")), (max_edits, F.col("subs") + F.col("ins") + F.col("dels")), (max_clips, F.col("clips"))):
        if limit is not None:
            tests.append(value <= limit)
    if min_identity is not None:
        tests.append(F.col("identity") >= min_identity)
    return e.where(reduce(lambda x, y: x & y, tests)).select(df.columns)


def filter_subs(df: DataFrame, minq: int, maxq: int, minsubs: int = 1) -> DataFrame:
    """Alignments (ref_bases, bases, quals of one length) with substitutions whose quality lies in minq..maxq."""
    from strandlake.functions.sequence import letters, phred

    hits = F.filter(F.arrays_zip(letters(F.col("ref_bases")).alias("r"), letters(F.col("bases")).alias("b"), phred(F.col("quals")).alias("q")), lambda x: (x["r"] != x["b"]) & x["q"].between(minq, maxq))
    return df.where(F.size(hits) >= minsubs)


def filter_vcf(df: DataFrame, min_qual=None, max_qual=None, chrom=None, start=None, stop=None, types=("sub", "ins", "del")) -> DataFrame:
    kind = F.when(F.length("ref") == F.length("alt"), "sub").when(F.length("ref") > F.length("alt"), "del").otherwise("ins")
    tests = [kind.isin(*types), F.col("ref") != F.col("alt")]
    if chrom is not None:
        tests.append(F.col("chrom") == chrom)
    if start is not None:
        tests.append(F.col("pos").between(start, stop))
    if min_qual is not None:
        tests.append(F.col("qual") >= min_qual)
    if max_qual is not None:
        tests.append(F.col("qual") <= max_qual)
    return df.where(reduce(lambda x, y: x & y, tests))


def filter_homopolymer(df: DataFrame, symbols: str = "GC", at_least: int = 6, bases: str = "bases") -> DataFrame:
    return df.where(~F.col(bases).rlike("|".join(f"{s}{{{at_least},}}" for s in symbols)))


def read_entropy(df: DataFrame, k: int = 4, id_col: str = "ordinal") -> DataFrame:
    """(id, entropy): entropy of a sequence's k-mers (one strand) as a share of the most that so many can have; 1 with one
    k-mer. Sequences without a k-mer have no row."""
    from strandlake.operators.joins import kmer_rows

    n = kmer_rows(df, id_col, k, rcomp=False).groupBy(id_col, "kmer").agg(F.count("*").alias("c"))
    g = n.groupBy(id_col).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    most = F.log(F.least(F.col("n"), F.lit(4**k)).cast("double"))
    return g.select(id_col, F.when(F.col("n") == 1, 1.0).otherwise((F.log("n") - F.col("s") / F.col("n")) / most).alias("entropy"))


def filter_poly(df: DataFrame, symbols: str = "GC", k: int = 31, min_count: int = 2, min_polymer: int = 20, min_polymer2: int = 29, ldf: float = 0.24, ldf2: float = 1.1, entropy: float = 0.67, entropy2: float = 0.2, quality: float = 12.5, quality2: float = 7.5, entropy_k: int = 4, id_col: str = "ordinal", pair_col: str | None = None) -> DataFrame:
    """Reads without suspicious homopolymers of the symbols. A read goes if its longest run has min_polymer2 bases, its
    share of k-mers that occur fewer than min_count times in all reads is ldf2, its entropy is below entropy2 or its
    average quality below quality2; and if it has a run of min_polymer bases together with a share of ldf, an entropy
    below entropy or a quality below quality. With pair_col all reads of one pair go together.

    Depths are counts of k-mers over all reads; a k-mer of many reads is one row when it meets them, and of reads of one
    sequence only one meets the counts. A read without k-mers is not of low depth."""
    from strandlake.operators.joins import for_each_read, kmer_rows, one_of_each

    same, own = one_of_each(df, id_col)
    rows = kmer_rows(own, id_col, k, keep=("__w",)).groupBy(id_col, "kmer").agg(F.count("*").alias("c"), F.sum("__w").alias("w"))
    rare = rows.groupBy("kmer").agg(F.sum("w").alias("n")).where(F.col("n") < min_count).select("kmer", F.lit(1).alias("rare"))
    low = rows.join(rare, "kmer", "left").groupBy(id_col).agg((F.sum(F.when(F.col("rare") == 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("low"))
    runs = lambda n: F.col("bases").rlike("|".join(f"{s}{{{n},}}" for s in symbols))
    checks = df.select(id_col, *([F.col(pair_col).alias("__pair")] if pair_col else []), runs(min_polymer).alias("run"), runs(min_polymer2).alias("run2"), F.round(average_quality(F.col("quals")), 9).alias("q"))
    of_kmers = for_each_read(low.join(read_entropy(own, entropy_k, id_col), id_col, "full_outer"), same, id_col)
    rows = checks.join(of_kmers, id_col, "left")
    x, e, q = F.coalesce("low", F.lit(0.0)), F.coalesce(F.round("entropy", 9), F.lit(1.0)), F.coalesce("q", F.lit(float("inf")))
    bad = rows.where(F.coalesce("run2", F.lit(False)) | (x >= ldf2) | (e < entropy2) | (q < quality2) | (F.coalesce("run", F.lit(False)) & ((x >= ldf) | (e < entropy) | (q < quality))))
    if pair_col:
        return df.join(bad.select(F.col("__pair").alias(pair_col)).distinct(), pair_col, "left_anti")
    return df.join(bad.select(id_col).distinct(), id_col, "left_anti")


def filter_by_tile(df: DataFrame, metrics: list[str], xsize: int = 500, ysize: int = 500, deviations=None, fractions=None, absolutes=None, least_reads: int = 500, target: int = 0) -> DataFrame:
    """Reads (lane, tile, x, y and metric columns) outside bad micro-tiles. A tile is bad if a metric lies below the
    mean over tiles by more than d deviations and f times the mean and an absolute amount. Tiles with fewer reads
    than the lesser of least_reads and a quarter of the mean do not count in the statistics and stay. With a target,
    micro-tiles are widened, the shorter side first, until they hold so many reads on average (or a whole tile)."""
    d, f, a = deviations or [1.5] * len(metrics), fractions or [0.05] * len(metrics), absolutes or [0.0] * len(metrics)
    if target:
        reads, span_x, span_y = df.agg(F.count("*"), F.max("x"), F.max("y")).first()
        near = lambda: df.select("lane", "tile", F.floor(F.col("x") / xsize), F.floor(F.col("y") / ysize)).distinct().count()
        while reads and (xsize <= span_x or ysize <= span_y) and reads < target * near():
            xsize, ysize = (2 * xsize, ysize) if xsize <= ysize else (xsize, 2 * ysize)
    rows = df.withColumns({"bx": F.floor(F.col("x") / xsize), "by": F.floor(F.col("y") / ysize)})
    cell = ["lane", "tile", "bx", "by"]
    tiles = rows.groupBy(*cell).agg(F.count("*").alias("reads"), *[F.avg(m).alias(m) for m in metrics])
    usual = tiles.agg(F.avg("reads").alias("mean_reads"))
    tiles = tiles.crossJoin(F.broadcast(usual)).withColumn("counts", F.col("reads") >= F.least(F.lit(least_reads), F.col("mean_reads") / 4))
    stats = tiles.where("counts").agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"std_{m}") for m in metrics])
    bad = F.lit(False)
    for m, dev, frac, least in zip(metrics, d, f, a, strict=True):
        gap = F.col(f"avg_{m}") - F.col(m)
        bad = bad | ((gap > dev * F.col(f"std_{m}")) & (gap > frac * F.abs(F.col(f"avg_{m}"))) & (gap > least))
    drop = tiles.crossJoin(F.broadcast(stats)).where(F.col("counts") & bad).select(*cell)
    return rows.join(drop, cell, "left_anti").drop("bx", "by")


def filter_taxa(df: DataFrame, ids: list[int], closure: DataFrame, include: bool = True, column: str = "taxid") -> DataFrame:
    """Rows whose taxon is one of the ids or below one. closure has id and ancestor."""
    below = closure.where(F.col("ancestor").isin(ids)).select(F.col("id").alias(column)).distinct()
    return df.join(below, column, "left_semi" if include else "left_anti")


def filter_assembly_summary(df: DataFrame, ids: list[int], closure: DataFrame, include: bool = True) -> DataFrame:
    """Rows of an assembly summary table (taxid) by taxon."""
    return filter_taxa(df, ids, closure, include)


def filter_silva(df: DataFrame, taxa: DataFrame, eukaryota: int, closure: DataFrame, name: str = "name") -> DataFrame:
    """Headers whose last ";" part names a node; under eukaryotes, organelle and bacterial lineages go."""
    rows = df.withColumn("__leaf", F.trim(F.element_at(F.split(name, ";"), -1)))
    known = rows.join(taxa.select(F.col("name").alias("__leaf"), F.col("id").alias("taxid")), "__leaf")
    euk = closure.where(F.col("ancestor") == eukaryota).select(F.col("id").alias("taxid"), F.lit(True).alias("__euk")).distinct()
    odd = F.lower(F.col(name)).rlike("chloroplast|mitochondria|bacteria;|archaea;")
    return known.join(euk, "taxid", "left").where(~(F.coalesce("__euk", F.lit(False)) & odd)).drop("__leaf", "__euk")


def coverage_verdict(contigs: DataFrame, cov1: DataFrame, cov0: DataFrame | None = None, min_reads=5, min_length=1, min_percent=40.0, min_fold=2.0, max_ratio=1.2) -> DataFrame:
    """contigs (name, length) with dirty: coverage (name, reads, percent, fold) too low or missing."""
    rows = contigs.join(cov1.select("name", "reads", "percent", "fold"), "name", "left")
    bad = F.col("reads").isNull() | (F.col("reads") < min_reads) | (F.col("length") < min_length) | (F.col("percent") < min_percent) | (F.col("fold") < min_fold)
    if cov0 is not None:
        rows = rows.join(cov0.select("name", F.col("fold").alias("fold0")), "name", "left")
        bad = bad | F.coalesce(F.col("fold0") / F.greatest(F.col("fold"), F.lit(0.01)) > max_ratio, F.lit(False))
    return rows.withColumn("dirty", F.coalesce(bad, F.lit(True)))


def filter_hits(df: DataFrame, cutoff: float) -> DataFrame:
    return df.where(F.col("score") >= cutoff)


def net_filter(df: DataFrame, model, cutoff: float) -> DataFrame:
    """Rows whose probability of class 1 under a fitted Spark ML pipeline passes the cutoff."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).where(vector_to_array("probability")[1] >= cutoff).select(df.columns)


def first_of_group(df: DataFrame, keys: list, *order: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")
