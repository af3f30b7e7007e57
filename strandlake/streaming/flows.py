"""Structured Streaming forms. Each takes a streaming (or batch) DataFrame and returns one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_source(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Lines of text files as they arrive in a directory."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)


def stream_fastq(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Records of FASTQ files as they arrive; a file is split at record starts, one row for each record."""
    lines = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(path)
    record = F.explode(F.regexp_extract_all("value", F.lit("(?m)^(@[^\n]*\n[^\n]*\n\\+[^\n]*\n[^\n]*)"), 1))
    p = F.split("r", "\n")
    return lines.select(record.alias("r")).select(F.substring(F.get(p, F.lit(0)), F.lit(2), F.length("r")).alias("name"), F.get(p, F.lit(1)).alias("bases"), F.get(p, F.lit(3)).alias("quals"))


def follow_fastq(spark: SparkSession, path: str, sink, malformed: str = "keep", max_files: int = 100):
    """A writer that reads FASTQ files as they arrive and hands their records to sink(batch, number), each batch a table of
    formats.read_fastq: files split at record starts, so a large one is many tasks, and what is no record is reported
    (a row without a name, or an error) and never dropped. The stream itself carries paths only."""
    from strandlake.sources.formats import read_fastq

    def each(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # max_files at most
        if paths:
            sink(read_fastq(spark, paths, malformed=malformed), number)

    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", max_files).load(path).select("path")
    return files.writeStream.foreachBatch(each)


def stream_counts(sdf: DataFrame, key: str) -> DataFrame:
    return sdf.groupBy(key).agg(F.count("*").alias("n"))


def stream_pileup(sdf: DataFrame, contig: str = "rname", start: str = "pos", length: str = "ref_len") -> DataFrame:
    """Depth changes by (contig, position): state holds positions with an event. depth_segments() of a snapshot's
    events gives coverage while mapping runs."""
    ends = F.array(F.struct(F.col(start).alias("p"), F.lit(1).alias("d")), F.struct((F.col(start) + F.col(length)).alias("p"), F.lit(-1).alias("d")))
    return sdf.select(F.col(contig).alias("contig"), F.explode(ends).alias("e")).groupBy("contig", F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d"))


def stream_dedupe(sdf: DataFrame, keys: list[str], event_time: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """First rows of each key; with an event time, state is dropped behind the watermark."""
    if event_time:
        return sdf.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)
    return sdf.dropDuplicates(keys)


def webcheck_windows(sdf: DataFrame, size: str = "1 hour", slide: str | None = None, lateness: str = "1 hour", ts: str = "ts", status: str = "status") -> DataFrame:
    """Rows by window and status: count, mean latency. Rows behind the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = sdf.withWatermark(ts, lateness) if sdf.isStreaming else sdf
    out = g.groupBy(w.alias("w"), status).agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("mean_latency"))
    return out.select(F.col("w.start").alias("window_start"), status, "n", "mean_latency")


def kmer_limit(df: DataFrame, k: int, limit: int, order: str = "ordinal") -> DataFrame:
    """Batch form of stopping at a number of distinct k-mers: reads up to the one that first reaches the limit.

    First-seen ordinals are counted, and the counts summed in ordinal order."""
    from pyspark.sql import Window

    from strandlake.operators.joins import kmer_rows

    first = kmer_rows(df, order, k).groupBy("kmer").agg(F.min(order).alias("o"))
    per = first.groupBy("o").agg(F.count("*").alias("fresh"))
    block = per.groupBy(F.floor(F.col("o") / 4096).alias("blk")).agg(F.sum("fresh").alias("s"))
    before = block.withColumn("before", F.sum("s").over(Window.orderBy("blk")) - F.col("s")).select("blk", "before")
    run = per.withColumn("blk", F.floor(F.col("o") / 4096)).join(before, "blk").withColumn("c", F.sum("fresh").over(Window.partitionBy("blk").orderBy("o")) + F.col("before"))
    last = run.where(F.col("c") >= limit).agg(F.min("o").alias("last"))
    return df.crossJoin(F.broadcast(last)).where(F.col("last").isNull() | (F.col(order) <= F.col("last"))).drop("last")


def limit_stream(sdf: DataFrame, k: int, limit: int, state_path: str, sink):
    """Writes micro-batches to sink(batch) until a sketch of distinct k-mers passes the limit. Under state_path each batch
    stores the sketch of all up to it, made of the one before and its own rows, so a batch reads one row however long the
    stream has run, and a restarted query goes on from there."""
    from strandlake.functions.sequence import canonical, kmers

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        rows = batch.select(F.explode(kmers(F.col("bases"), k)).alias("x"))
        own = rows.agg(F.hll_sketch_agg(F.xxhash64(canonical(F.col("x"))), F.lit(14)).alias("s"))
        before = spark.read.parquet(f"{state_path}/batch={number - 1}").select("s") if number else own.where("false")
        seen = before.agg(F.max(F.hll_sketch_estimate("s"))).first()[0]
        before.union(own).agg(F.hll_union_agg("s").alias("s")).write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        if (seen or 0) < limit:
            sink(batch)
        batch.unpersist()

    return sdf.writeStream.foreachBatch(each)


def stateful(sdf: DataFrame, key: str, fn, output: str, state: str) -> DataFrame:
    """A user function with state for each key: fn(key, pandas frames, GroupState) yields pandas frames."""
    return sdf.groupBy(key).applyInPandasWithState(fn, output, state, "append", "NoTimeout")
