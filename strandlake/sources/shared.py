"""The folder that all executors share, for what has to be written and read again."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset: one of our own in the warehouse, which executors
    share too; a machine-local one only in local mode, where there is one machine."""
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


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query when it ends. Else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Shuffle files of the queries inside go when these end: for what is whole in a table, or with the driver, by then. Over
    many steps the files of all of them would be on the disks together."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage, and Spark's guess of the size with it, by a table in the shared folder.

    A checkpoint keeps the guess of the plan it replaces, and a join multiplies those of its sides: over rounds that number
    gets more digits than the driver can multiply. The table meets others by a shuffle: its files are smaller than its rows."""
    return stored(df).hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder, for what is read again by column."""
    path = fresh_path(df.sparkSession, "table")
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
