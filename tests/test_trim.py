"""The best run of a read where runs of equal gains in another order compete."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.operators import projections
from strandlake.plans import derived, queries_rows


@pytest.fixture(scope="module")
def reads():
    """Reads whose two best runs have the same gains (of 2.1 million events; found by their sums)."""
    c = duckdb.connect()
    c.execute("create view events as select unnest([29922, 68737, 267630, 517935, 525442]) as event_id")
    rows = c.execute(derived.duck("dv_reads") + "select ordinal, bases, quals from dv_reads").fetchall()
    want = c.execute(derived.duck("dv_reads") + f", {queries_rows.TRIM} select ordinal, a, b from a").fetchall()
    return rows, {o: (a, b) for o, a, b in want}


def test_runs_of_equal_gains(spark, reads):
    rows, want = reads
    df = spark.createDataFrame(rows, "ordinal long, bases string, quals string")
    q = projections.quality_trim(F.col("bases"), F.col("quals"), 12.0)
    text = {o: (x, y) for o, x, y in rows}
    for r in df.select("ordinal", q.alias("t")).select("ordinal", "t.*").collect():
        a, b = want[r.ordinal]
        assert (r.bases, r.quals, r.trimmed) == (text[r.ordinal][0][a - 1 : b], text[r.ordinal][1][a - 1 : b], 96 - (b - a + 1))


def test_reads_without_a_run(spark):
    df = spark.createDataFrame([(1, "ACGT", "!!!!"), (2, "", ""), (3, None, None), (4, "ACGTA", "!II!I")], "ordinal long, bases string, quals string")
    cut = lambda mode: projections.quality_trim(F.col("bases"), F.col("quals"), 12.0, mode=mode)["bases"]
    got = {r.ordinal: (r.b, r.l, r.r) for r in df.select("ordinal", cut("both").alias("b"), cut("left").alias("l"), cut("right").alias("r")).collect()}
    assert got == {1: ("", "ACGT", ""), 2: ("", "", ""), 3: (None, None, None), 4: ("CG", "CGTA", "ACG")}
