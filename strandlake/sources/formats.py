"""Readers and writers of sequence formats, on Spark's own text and CSV sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GFF = ["seqid", "source", "type", "start", "stop", "score", "strand", "phase", "attribute"]
SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def _at(a: Column, i: int, kind: str = "string") -> Column:
    return F.get(a, F.lit(i)).try_cast(kind)


def read_fasta(spark: SparkSession, path, min_len: int = 0, break_len: int = 0) -> DataFrame:
    """(name, bases): splittable, one record for each ">" at a line start."""
    raw = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("v")).where("v <> ''")
    rows = raw.select(F.regexp_replace(F.substring_index("v", "\n", 1), "\r", "").alias("name"), F.when(F.instr("v", "\n") > 0, F.regexp_replace(F.substring("v", F.instr("v", "\n"), F.length("v")), "\\s", "")).otherwise("").alias("bases"))
    rows = rows.where(F.length("bases") >= min_len) if min_len else rows
    if break_len:
        from strandlake.operators.projections import break_long

        rows = break_long(rows, break_len)
    return rows


def read_fastq(spark: SparkSession, path, qin: int = 33, malformed: str = "raise") -> DataFrame:
    """(file, ordinal, name, pair, bases, quals) with offset 33; pair is 1 or 2 where the name says so ("/1", " 2:..."),
    ordinal counts the records of a file.

    Files split at "@" line starts. A quality line that begins with "@" splits its record: the piece that ends in the
    "+" line and the next piece, in the same block or first in the one after it, are put together. What is no record
    raises an error; with malformed="keep" it is a row whose name is null and whose bases hold its text."""
    raw = spark.read.text(path, lineSep="\n@").select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "\n+$", "").alias("v"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("size"))
    rows = raw.withColumn("at", F.monotonically_increasing_id())
    n_lines = F.size(F.split("v", "\n"))
    # the first record of a file keeps its "@"; a record without bases loses its empty last line
    rows = rows.withColumn("n", n_lines).withColumn("v", F.when(F.col("n") > 1, F.regexp_replace("v", "^@", "")).otherwise(F.col("v")))
    rows = rows.withColumns({"v": F.when(F.col("v").rlike("^[^\n]*\n\n\\+[^\n]*$"), F.concat("v", F.lit("\n"))).otherwise(F.col("v"))}).withColumn("n", n_lines)
    whole, odd = rows.where("n = 4"), rows.where("n <> 4")
    heads, tails = odd.where("n = 3"), odd.where("n = 1").select("file", "block", F.col("at").alias("at2"), F.col("v").alias("tail"))
    # the piece right behind a head in its block; else, as a block's last head may reach into the next one, the first there
    behind = tails.select("file", "block", (F.col("at2") - 1).alias("at"), F.struct("at2", "tail").alias("own"))
    first = tails.groupBy("file", F.col("block").alias("end")).agg(F.min(F.struct("at2", "tail")).alias("next"))
    joined = heads.withColumn("end", F.col("block") + F.col("size")).join(behind, ["file", "block", "at"], "left").join(first, ["file", "end"], "left")
    joined = joined.withColumn("t", F.coalesce("own", "next")).where("t is not null").select("file", "block", "at", "v", "t.at2", "t.tail")
    whole = whole.select("file", "block", "at", "v").union(joined.select("file", "block", "at", F.concat("v", F.lit("\n@"), "tail")))
    used = joined.select("file", F.col("at")).union(joined.select("file", "at2"))
    rest = odd.where("v <> ''").join(used, ["file", "at"], "left_anti").select("file", "block", "at", "v")
    p = F.split("v", "\n")
    fits = F.startswith(_at(p, 2), F.lit("+")) & (F.length(_at(p, 1)) == F.length(_at(p, 3)))
    every = whole.withColumn("ok", fits).union(rest.withColumn("ok", F.lit(False)))
    name = F.when(F.col("ok"), _at(p, 0))
    if malformed == "raise":
        name = F.when(F.col("ok"), _at(p, 0)).otherwise(F.raise_error(F.concat(F.lit("no FASTQ record: "), F.left("v", F.lit(200)))))
    out = every.select("file", "block", "at", name.alias("name"), F.when(F.col("ok"), _at(p, 1)).otherwise(F.col("v")).alias("bases"), F.when(F.col("ok"), _at(p, 3)).alias("quals"))
    if qin == 64:
        from strandlake.functions.sequence import letters

        out = out.withColumn("quals", F.array_join(F.transform(letters(F.col("quals")), lambda c: F.char(F.ascii(c) - 31)), ""))
    # ordinals: places in a block, after the counts of the blocks before it
    blocks = out.groupBy("file", "block").agg(F.count("*").alias("c"))
    before = blocks.select("file", "block", (F.sum("c").over(Window.partitionBy("file").orderBy("block")) - F.col("c")).alias("before"))
    # each block is there once: where ordinals are not asked for, Spark leaves this join and its sort out
    placed = out.join(before, ["file", "block"], "left").withColumn("ordinal", F.col("before") + F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1)
    mate = F.coalesce(F.regexp_extract("name", "(?:/| )([12])(?::.*)?$", 1), F.lit(""))
    return placed.select("file", "ordinal", "name", F.when(mate != "", mate.cast("int")).alias("pair"), "bases", "quals")


def _places(df: DataFrame) -> DataFrame:
    """Reads of files with the ordinal counted over all files."""
    files = df.groupBy("file").agg(F.count("*").alias("__c"))
    before = files.select("file", (F.sum("__c").over(Window.orderBy("file")) - F.col("__c")).alias("__before"))
    return df.join(before, "file").withColumn("ordinal", F.col("__before") + F.col("ordinal")).drop("__before")


def pair_reads(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Two reads tables by position, or one interleaved one: name, bases1, quals1, bases2, quals2. Positions of a table that
    was read from several files go on from file to file, by the files' names."""
    a, b = (d if d is None or "file" not in d.columns else _places(d) for d in (a, b))
    if b is None:
        even = F.col("ordinal") % 2
        a, b = a.where(even == 0).withColumn("ordinal", (F.col("ordinal") / 2).cast("bigint")), a.where(even == 1).withColumn("ordinal", ((F.col("ordinal") - 1) / 2).cast("bigint"))
    mate = lambda d, n: d.select("ordinal", *([F.col("name")] if n == 1 else []), F.col("bases").alias(f"bases{n}"), F.col("quals").alias(f"quals{n}"))
    return mate(a, 1).join(mate(b, 2), "ordinal")


def read_fasta_qual(spark: SparkSession, fasta, qual) -> DataFrame:
    b = read_fasta(spark, fasta)
    q = spark.read.text(qual, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("v")).where("v <> ''")
    q = q.select(F.substring_index("v", "\n", 1).alias("name"), F.transform(F.filter(F.split(F.substring("v", F.instr("v", "\n"), F.length("v")), "\\s+"), lambda x: x != ""), lambda x: F.char(x.cast("int") + 33)).alias("q"))
    return b.join(q, "name").select("name", "bases", F.array_join("q", "").alias("quals"))


def read_oneline(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, bases string", quote="")


def read_scarf(spark: SparkSession, path) -> DataFrame:
    """Colon-separated rows: the last two fields are bases and qualities."""
    p = F.split("value", ":")
    n = F.size("p")
    rows = spark.read.text(path).where("value <> ''").select(p.alias("p"))
    return rows.select(F.array_join(F.slice("p", F.lit(1), n - 2), ":").alias("name"), F.element_at("p", -2).alias("bases"), F.element_at("p", -1).alias("quals"))


def read_sam(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(header lines, alignments with tags as a map)."""
    lines = spark.read.text(path).where("value <> ''")
    p = F.split("value", "\t")
    kinds = {"flag": "int", "pos": "bigint", "mapq": "int", "pnext": "bigint", "tlen": "bigint"}
    tags = F.map_from_entries(F.transform(F.slice("p", F.lit(12), F.greatest(F.size("p") - 11, F.lit(0))), lambda t: F.struct(F.left(t, F.lit(2)), F.substring(t, F.lit(6), F.length(t)))))
    rows = lines.where(~F.startswith("value", F.lit("@"))).select(p.alias("p"))
    return lines.where(F.startswith("value", F.lit("@"))).select("value"), rows.select(*[_at(F.col("p"), i, kinds.get(c, "string")).alias(c) for i, c in enumerate(SAM)], tags.alias("tags"))


def read_vcf(spark: SparkSession, path) -> tuple[DataFrame, list[str], DataFrame]:
    """(header lines, sample names, variants); of rows with one key the last counts."""
    lines = spark.read.text(path).where("value <> ''").withColumn("n", F.monotonically_increasing_id())
    head = lines.where(F.startswith("value", F.lit("#"))).select("value")
    names = head.where(F.startswith("value", F.lit("#CHROM"))).first()
    samples = names["value"].split("\t")[9:] if names else []
    p = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#"))).select("n", p.alias("p"))
    rows = rows.select("n", *[_at(F.col("p"), i, k).alias(c) for i, (c, k) in enumerate((("chrom", "string"), ("pos", "bigint"), ("id", "string"), ("ref", "string"), ("alt", "string"), ("qual", "double"), ("filter", "string")))], F.expr("str_to_map(get(p, 7), ';', '=')").alias("info"), F.slice("p", F.lit(10), F.greatest(F.size("p") - 9, F.lit(0))).alias("samples"))
    last = F.row_number().over(Window.partitionBy("chrom", "pos", "ref", "alt").orderBy(F.desc("n")))
    return head, samples, rows.withColumn("k", last).where("k = 1").drop("k", "n")


def read_gff(spark: SparkSession, path) -> DataFrame:
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select(p.alias("p"))
    kinds = {"start": "bigint", "stop": "bigint", "score": "double"}
    out = rows.select(*[_at(F.col("p"), i, kinds.get(c, "string")).alias(c) for i, c in enumerate(GFF)])
    return out.withColumn("attributes", F.expr("""str_to_map(replace(regexp_replace(attribute, '; *([A-Za-z_]+) "([^"]*)"', ';$1=$2'), '"', ''), ';', '=')"""))


def read_gbff(spark: SparkSession, path) -> DataFrame:
    """Features of GenBank and EMBL flat files, one row for each interval of a location (join and order have several):
    seqid, feature (its number in the record), part, type, start, stop, strand, attributes (a map; bare ones are
    empty)."""
    loci = spark.read.text(path, lineSep="\n//").where("value rlike '\\S'")
    # an EMBL feature line is a GenBank one with FT before it
    plain = F.regexp_replace("value", "(?m)^FT   ", "     ")
    named = F.coalesce(F.nullif(F.regexp_extract("value", "LOCUS +(\\S+)", 1), F.lit("")), F.regexp_extract("value", "(?m)^ID +([^\\s;]+)", 1))
    feature = F.regexp_extract_all("v", F.lit("(?m)^ {5}([A-Za-z_][^\\n]*(?:\\n {21}[^\\n]*)*)"), 1)
    rows = loci.select(named.alias("seqid"), plain.alias("v")).select("seqid", F.posexplode(feature).alias("feature", "f"))
    where = F.regexp_replace(F.regexp_extract("f", "(?s)^[A-Za-z_']+\\s+(.*?)(?=\\n {21}/|$)", 1), "\\s", "")
    tags = F.regexp_extract_all("f", F.lit('(?m)^ {21}/([A-Za-z_]+(?:=(?:"[^"]*"|[^\\n]*))?)'), 1)
    value = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_extract(t, "(?s)=(.*)", 1), '^"|"$', ""), "\\s*\\n\\s*", " ")
    attributes = F.map_from_arrays(F.transform(F.array_distinct(F.transform(tags, lambda t: F.substring_index(t, "=", 1))), lambda k: k), F.transform(F.array_distinct(F.transform(tags, lambda t: F.substring_index(t, "=", 1))), lambda k: value(F.element_at(F.filter(tags, lambda t: F.substring_index(t, "=", 1) == k), 1))))
    rows = rows.select("seqid", "feature", F.regexp_extract("f", "^[A-Za-z_']+", 0).alias("type"), where.alias("w"), attributes.alias("attributes"))
    # inside complement( ) up to its closing bracket every interval is on the minus strand
    parts = F.regexp_extract_all("w", F.lit("(complement\\((?:[^()]|\\([^()]*\\))*\\)|[<>]?[0-9]+(?:\\.\\.[<>]?[0-9]+)?)"), 1)
    strand = lambda p: F.when(F.startswith(p, F.lit("c")), "-").otherwise("+")
    each = lambda p: F.transform(F.regexp_extract_all(p, F.lit("([0-9]+(?:\\.\\.[<>]?[0-9]+)?)"), 1), lambda i: F.struct(strand(p).alias("strand"), i.alias("i")))
    spans = rows.select("seqid", "feature", "type", "attributes", F.posexplode(F.flatten(F.transform(parts, each))).alias("part", "s"))
    ends = [F.regexp_extract("s.i", f"{p}", 1).cast("bigint").alias(c) for p, c in (("^([0-9]+)", "start"), ("([0-9]+)$", "stop"))]
    return spans.select("seqid", F.col("feature").cast("bigint").alias("feature"), (F.col("part") + 1).cast("bigint").alias("part"), "type", *ends, "s.strand", "attributes")


def read_phylip(spark: SparkSession, path) -> DataFrame:
    """Interleaved PHYLIP: the first block has names; a file is one alignment."""
    raw = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    n = F.regexp_extract(F.get("l", F.lit(0)), "([0-9]+)", 1).cast("int")
    rows = raw.select(lines.alias("l")).select(n.alias("n"), F.posexplode(F.slice("l", F.lit(2), F.size("l"))).alias("i", "v"))
    rows = rows.withColumn("row", F.pmod("i", "n")).withColumn("name", F.when(F.col("i") < F.col("n"), F.split_part(F.trim("v"), F.lit(" "), F.lit(1))))
    rows = rows.withColumn("b", F.regexp_replace(F.when(F.col("i") < F.col("n"), F.regexp_replace(F.trim("v"), "^\\S+", "")).otherwise(F.col("v")), "\\s", ""))
    return rows.groupBy("row").agg(F.max("name").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]), "").alias("bases")).select("name", "bases")


def read_covstats(spark: SparkSession, path) -> DataFrame:
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select(*[F.col(f"`{c}`").alias(c.lstrip("#").lower()) if c.lstrip("#") == "ID" else F.col(f"`{c}`").try_cast("double").alias(c.lstrip("#").lower()) for c in df.columns])


def read_hmm(spark: SparkSession, path) -> DataFrame:
    p = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(p.alias("p"))
    return rows.select(_at(F.col("p"), 0).alias("protein"), _at(F.col("p"), 2, "bigint").alias("length"), _at(F.col("p"), 3).alias("model"), _at(F.col("p"), 6, "double").alias("evalue"), _at(F.col("p"), 7, "double").alias("score"))


def read_sketch_results(spark: SparkSession, path) -> DataFrame:
    """Blocks of "Query: name" and tab rows "WKID KID ANI ... name" to (query, ani, ref)."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.regexp_extract("value", "Query: *([^\t\n]+)", 1).alias("query"), F.explode(F.split("value", "\n")).alias("v"))
    p = F.split("v", "\t")
    return blocks.where("v rlike '^[0-9.]+%'").select("query", F.regexp_replace(_at(p, 2), "%", "").try_cast("double").alias("ani"), F.element_at(p, -1).alias("ref"))


# -- writers ----------------------------------------------------------------------------------------------------


def fasta_text(wrap: int = 0) -> Column:
    b = F.regexp_replace("bases", f"(.{{{wrap}}})(?=.)", "$1\n") if wrap else F.col("bases")
    return F.concat(F.lit(">"), "name", F.lit("\n"), b)


def fastq_text() -> Column:
    return F.concat(F.lit("@"), "name", F.lit("\n"), "bases", F.lit("\n+\n"), "quals")


def sam_text() -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in SAM])


def write_reads(df: DataFrame, path: str, kind: str = "fastq", order: str | None = None, compression: str = "none", wrap: int = 0) -> None:
    """fasta, fastq, sam or header lines; with an order, files and lines follow it."""
    text = {"fasta": fasta_text(wrap), "fastq": fastq_text(), "sam": sam_text(), "header": F.col("name")}[kind] if kind != "sam" else sam_text()
    rows = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    rows.select(text.alias("value")).write.text(path, compression=compression)


def demux(df: DataFrame, key: Column, names: DataFrame | None = None) -> DataFrame:
    """Adds route: the key, or "unmatched" where names are given and do not have it."""
    rows = df.withColumn("route", key)
    if names is None:
        return rows
    n = names.select(F.col(names.columns[0]).alias("route"), F.lit(True).alias("__k")).distinct()
    return rows.join(n, "route", "left").withColumn("route", F.when(F.col("__k"), F.col("route")).otherwise("unmatched")).drop("__k")


def write_demux(df: DataFrame, path: str) -> None:
    df.write.partitionBy("route").parquet(path)


def partition_evenly(df: DataFrame, n: int, order: str = "ordinal") -> DataFrame:
    """Adds part: rows dealt by ordinal."""
    return df.withColumn("part", F.pmod(F.col(order), F.lit(n)).cast("bigint"))


def to_json_report(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def convert(spark: SparkSession, source: str, target: str, kind_in: str, kind_out: str, keep=None, mates: str | None = None, rate: float = 1.0, seed: int = 1) -> None:
    """Reader to writer in one stage, with an optional filter and share of the rows (by a hash of the name). With mates, a
    second FASTQ file of the first one's mates, pairs are filtered and drawn as one (a row with bases1 and bases2) and
    written interleaved."""
    from strandlake.operators.windows import sample

    if mates is not None:
        pairs = pair_reads(read_fastq(spark, source), read_fastq(spark, mates))
        pairs = sample(pairs.where(keep) if keep is not None else pairs, rate, seed, "name")
        rows = pairs.select("ordinal", "name", F.explode(F.array(*[F.struct(F.lit(n).alias("mate"), F.col(f"bases{n}").alias("bases"), F.col(f"quals{n}").alias("quals")) for n in (1, 2)])).alias("r"))
        rows = rows.select((2 * F.col("ordinal") + F.col("r.mate") - 1).alias("ordinal"), "name", "r.bases", "r.quals")
        write_reads(rows, target, kind_out, order="ordinal")
        return
    df = read_sam(spark, source)[1].withColumnsRenamed({"qname": "name", "seq": "bases", "qual": "quals"}) if kind_in == "sam" else {"fasta": read_fasta, "fastq": read_fastq}[kind_in](spark, source)
    write_reads(sample(df.where(keep) if keep is not None else df, rate, seed, "name"), target, kind_out)
