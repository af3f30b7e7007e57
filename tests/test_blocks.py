"""Rows that meet in blocks: many tasks whatever their bytes, and the results of all pairs."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import aligner, graphs, similarity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_pairs_of_blocks_are_many_tasks(spark):
    rows = spark.range(3000).select(F.col("id").alias("b"))
    met = similarity.in_blocks(spark.range(300).select(F.col("id").alias("a")), rows, "a", "b", 100)
    assert met.count() == 900_000
    assert met.rdd.getNumPartitions() >= 90  # 3 blocks and 30


def test_blocks_meet_without_copies(spark):
    q, r = spark.range(300).select(F.col("id").alias("a")), spark.range(3000).select(F.col("id").alias("b"))
    met = similarity.block_pairs(q, r, "a", "b", 100)
    assert met.agg(F.sum(F.size("q_rows") * F.size("r_rows"))).first()[0] == 900_000
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "Join" not in plan
    own = similarity.block_pairs(r, r, "b", "b", 100, same=True)
    assert own.agg(F.sum(F.when(F.col("q") == F.col("r"), 1).otherwise(2) * F.size("q_rows") * F.size("r_rows"))).first()[0] == 9_000_000


def test_identity_matrix_has_all_pairs(spark):
    draw = random.Random(8)
    text = lambda n: "".join(draw.choice("ACGTN") for _ in range(n))
    rows = [(f"c{i}", text(draw.choice([5, 63, 64, 70, 128]))) for i in range(70)] + [("e", ""), ("m", None), ("twice", "ACGT"), ("twice", "ACGA")]
    got = similarity.identity_matrix(spark.createDataFrame(rows, "name string, bases string")).collect()
    share = lambda x, y: None if x is None or y is None else float(np.floor((1 - edits(x, y) / max(len(x), len(y), 1)) * 1e6 + 0.5)) / 1e6
    want = [(a, b, share(x, y)) for a, x in rows for b, y in rows if a != b]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_all_to_all_takes_every_row(spark):
    from strandlake.plans import registry
    from tests.conftest import SF

    n = spark.read.parquet(f"{SF}/part.parquet").count()
    got = registry.QUERIES["all_to_all_identity"](spark, SF)
    assert got.count() == n * (n - 1) and got.select("a").distinct().count() == n


def test_all_edits_are_those_of_the_table():
    draw = random.Random(3)
    one, two = (["".join(draw.choice("ACGTN") for _ in range(draw.choice([0, 1, 9, 63, 64, 65, 90, 128, 129]))) for _ in range(n)] for n in (25, 30))
    got = aligner.all_edits(one, two)
    assert all(got[i, j] == edits(a, b) for i, a in enumerate(one) for j, b in enumerate(two))


def test_identity_of_missing_sequences(spark):
    q = spark.createDataFrame([("q", "ACGT"), ("n", None)], "name string, bases string")
    r = spark.createDataFrame([("x", "ACCT"), ("q", "ACGT"), ("e", ""), ("m", None)], "name string, bases string")
    got = {tuple(x) for x in similarity.identity_search(q, r).collect()}
    assert {g for g in got if g[0] == "q"} == {("q", "x", 0.75), ("q", "e", 0.0), ("q", "m", None)}
    assert {g for g in got if g[0] == "n"} == {("n", x, None) for x in "xqem"}


def test_vectors_without_a_distance(spark):
    rows = [(20, [1.0, 0.0]), (1, [0.5, 2.0]), (2, None), (3, [1.0]), (4, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.b: (r["abs"], r["cosine"]) for r in similarity.vector_pairs(df.where("id = 20"), df, "id", "id", "v").collect()}
    assert got[1][0] == 2.5 and abs(got[1][1] - (1 - 0.5 / 4.25**0.5)) < 1e-12
    assert {b: x for b, x in got.items() if b != 1} == {2: (None, None), 3: (None, None), 4: (None, None)}


def test_bins_are_components_of_all_links(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, 0.4 + draw.random() * 0.1, 1.0 + draw.randrange(4), [draw.random() for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame([*rows, (900, 0.4, 1.0, None), (901, None, 1.0, [0.0] * 3)], "id long, gc double, depth double, vector array<double>")
    monkeypatch.setattr(similarity.cells_dealt, "__defaults__", (30,))  # cells are several blocks
    got = {r.id: r.bin for r in graphs.bin_contigs(df, 0.12).collect()}
    cell = lambda r: (int(np.floor(r[1] / 0.02)), int(np.floor(np.log2(r[2] + 0.01) / 0.5)))
    own = {r[0]: r[0] for r in rows} | {900: 900, 901: 901}

    def top(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if all(abs(x - y) <= 1 for x, y in zip(cell(a), cell(b), strict=True)) and sum(abs(x - y) for x, y in zip(a[3], b[3], strict=True)) <= 0.12:
            x, y = sorted((top(a[0]), top(b[0])))
            own[y] = x
    assert got == {x: top(x) for x in own}
    assert len(set(got.values())) < 395


def test_short_queries_face_every_place(spark):
    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("ACGTN") for _ in range(n))
    refs = [(f"r{i}", text(n)) for i, n in enumerate([3, 40, 60, 4005, 0])] + [("none", None)]
    long = refs[3][1][1980:2030]  # over the end of a piece, found by its seeds
    queries = [("a", text(10)), ("b", text(6)), ("c", refs[3][1][1996:2008]), ("d", "AC"), ("e", long[:20] + "T" + long[21:])]
    frame = lambda rows: spark.createDataFrame(rows, "name string, bases string")
    got = {tuple(r) for r in similarity.seeded_search(frame(queries), frame(refs), 3).collect()}
    want = set()
    for q, x in queries:
        for r, y in refs:
            places = [(sum(a != b for a, b in zip(x, y[i : i + len(x)], strict=True)), i) for i in range(len(y) - len(x) + 1)] if y and len(x) > 3 else []
            if places and min(places)[0] <= 3:
                want.add((q, r, min(places)[1], min(places)[0]))
    assert got == want
    assert {("c", "r3", 1996, 0)} <= got and any(g[:2] == ("e", "r3") for g in got)


def test_short_copies_with_edits_are_found_without_sending_places(spark):
    from strandlake.operators import sets

    draw = random.Random(12)
    text = lambda n: "".join(draw.choice("ACGTN") for _ in range(n))
    long = [(f"l{i}", text(n)) for i, n in enumerate([60, 90, 4100])]
    big = long[2][1]
    parts = [("a", big[1985:2015]), ("b", big[1990:2000] + "T" + big[2000:2019]), ("c", long[0][1][3:15] + long[0][1][16:34]), ("d", text(30)), ("e", big[4075:]), ("f", big[1985:2015])]
    df = spark.createDataFrame([*long, *parts, ("none", None)], "name string, bases string")
    asked = df.where("length(bases) < 40").select(F.col("name").alias("s"), F.col("bases").alias("q"), F.length("bases").alias("n"), F.floor(F.length("bases") * 0.1).cast("int").alias("e"))
    faced = sets.faced_near(asked, df, "name")
    got = {(r.s, r.l) for r in faced.collect()}
    want = set()
    for s, x in parts:
        for name, y in [*long, *parts]:
            most = len(x) // 10
            near = min(edits(x, y[i : i + k]) for i in range(len(y)) for k in range(max(len(x) - most, 1), len(x) + most + 1)) if abs(len(y)) < 200 else (0 if x in y else 1 if s == "b" else 9)
            if s != name and (len(y) > len(x) or (len(y) == len(x) and name < s)) and near <= most:
                want.add((s, name))
    assert got == want and {("a", "l2"), ("b", "l2"), ("c", "l0"), ("e", "l2"), ("f", "a")} <= got
    plan = faced._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Join" not in plan


def test_cells_send_as_many_rows_as_blocks(spark):
    rows = spark.range(4000).select("id", F.lit(3).cast("bigint").alias("size"), (F.col("id") % 2).alias("cell"))
    left, right = similarity.cells_dealt(rows, "id", ["size", "cell"], [(0, 0), (0, 1)], 50)  # 40 blocks in each cell
    assert left.count() < 4 * 4000 and right.count() < 4 * 4000
    met = similarity.cell_pairs(rows.where("id < 100"), rows, "id", ["size", "cell"], 50)
    assert met.agg(F.sum(F.size("own") * F.size("others"))).first()[0] == 400_000
