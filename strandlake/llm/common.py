"""Helpers that the corpus operators share: reading, scratch tables, distributed filters, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.shared import swept

#: White space of all word and line rules here: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset: a folder of our own in the
    warehouse, which executors share too; a machine-local folder only in local mode, where there is one machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            import tempfile

            found = tempfile.mkdtemp(prefix="strandlake-")
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/strandlake-{uuid.uuid4().hex}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage: rows go to the shared checkpoint folder, so a lost executor costs no recomputation."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like settled(), as a Parquet table in the shared folder: for what is read again by column."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("table-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does just that where all is ASCII, and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def bit_at(n: Column) -> Column:
    """A long with bit n set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


#: Bits of a membership filter: 2 MB on the driver and each executor, whatever the data.
FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS):
    """A fixed-size bit set over the ids, for dropping rows before a shuffle. It may pass ids it has not
    seen (all, once it is full), never the other way, so an exact join has to follow.
    Nulls are not entered. Returns (bits, numpy uint64 words); made by Spark, only the words reach the driver."""
    import numpy as np

    bit = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (
        ids.where(F.col(column).isNotNull())
        .select(F.shiftright(bit, 6).alias("w"), bit_at(bit.bitwiseAND(F.lit(63))).alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def in_filter(words, ids):
    """Which of the ids (numpy int64) the filter passes."""
    import numpy as np

    bit = ids & (len(words) * 64 - 1)
    return (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


def drop_ids(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in bad (one column of longs). Rows that a fixed-size filter over bad lets go
    are kept where they are scanned; only suspects meet bad in a join, so texts are not shuffled. Null ids stay."""
    import pyarrow as pa

    bad = stored(bad.toDF("__bad").where("__bad is not null").distinct())
    words = id_filter(bad, "__bad")
    at = docs.columns.index(id_col)

    def suspects(batch):
        import numpy as np

        ids = batch.column(at).cast("int64")
        return in_filter(words, ids.fill_null(0).to_numpy().astype(np.int64)) & ids.is_valid().to_numpy(zero_copy_only=False)

    def clean(batches):
        for batch in batches:
            yield batch.filter(pa.array(~suspects(batch)))

    def maybe(batches):
        for batch in batches:
            yield batch.filter(pa.array(suspects(batch)))

    near = docs.mapInArrow(maybe, docs.schema)
    return docs.mapInArrow(clean, docs.schema).union(near.join(bad, near[id_col].cast("long") == bad["__bad"], "left_anti"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links, as rows (node, component): component is the least node reached.

    Each round joins every node with its neighbours' least label (a partial aggregate, so a hub does not gather
    its links in one task) and then follows its label's own label; rounds grow with the log of the diameter for
    chains and are two or three for stars. Nodes without links are not returned; null ends and self links are
    dropped."""
    spark = links.sparkSession
    e = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = settled(e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = settled(e.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")))
    while True:
        near = e.join(labels.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = labels.join(near, "x").select("x", "l", F.least("l", "m").alias("n"))
        jump = step.select(F.col("x").alias("n"), F.col("n").alias("j"))
        nxt = settled(step.join(jump, "n", "left").select("x", F.col("l").alias("old"), F.least("n", F.coalesce("j", "n")).alias("l")))
        if nxt.where("l <> old").isEmpty():
            return nxt.select(F.col("x").alias("node"), F.col("l").alias("component"))
        labels = nxt.select("x", "l")
