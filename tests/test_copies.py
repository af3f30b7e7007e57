"""Rows that repeat: what is worked out of a text or of equal reads is worked out once."""

import random
import time

from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import aggregates, filters, graphs, joins, projections, sets
from strandlake.plans import derived
from strandlake.sources import formats

FIELDS = "ordinal long, bases string"


def within(seconds, df):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < seconds
    return rows


def test_copies_at_one_place_do_not_meet_each_other(spark):
    text = "ACGTTGCAAGTCCTAG" + "ACGT" * 20
    rows = [(i, f"M1:7:FC1:1:1101:{10 + i % 3}:{20}", text) for i in range(9000)]
    rows += [(9001, "M1:7:FC1:1:1101:900:20", text), (9002, "M1:7:FC1:1:1101:905:20", text[:-1] + "A"), (9003, "x", text), (9004, "x", text), (9005, "M1:7:FC1:1:1101:10:20", None)]
    df = spark.createDataFrame(rows, "ordinal long, name string, bases string")
    got = within(60, sets.dedupe_optical(df, 50))
    assert {r.ordinal for r in got} == {0, 9001, 9003, 9004, 9005}
    assert {r.ordinal for r in sets.dedupe_optical(df.where("ordinal < 6"), 0).collect()} == {0, 1, 2}


def test_a_text_is_worked_out_once_for_all_its_places(spark):
    draw = random.Random(2)
    text = "".join(draw.choice("ACGTN") for _ in range(90_000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "AC"), (4, None)], FIELDS)
    codes = {a + b + c: S.AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    want = "".join(codes.get(text[i : i + 3], "X") for i in range(1, len(text) - 2, 3))
    got = within(40, df.select("ordinal", S.translate_frame(F.col("bases"), 1).alias("amino")))
    assert {r.ordinal: r.amino for r in got} == {1: want, 2: "", 3: "", 4: ""}
    shares = {r.ordinal: r.v for r in within(40, df.select("ordinal", projections.spectrum(F.col("bases"), 2).alias("v")))}
    pairs = [text[i : i + 2] for i in range(len(text) - 1) if "N" not in text[i : i + 2]]
    assert abs(shares[1][0] - pairs.count("AA") / len(pairs)) < 1e-12 and shares[2] == [0.0] * 16


def test_versions_of_a_read_agree_place_by_place(spark):
    draw = random.Random(4)
    text = "".join(draw.choice("ACGT") for _ in range(60_000))
    frame = lambda *rows: spark.createDataFrame(rows, FIELDS)
    a = frame((1, text), (2, "AAAA"), (3, "AAAA"), (4, None), (5, "AAAA"))
    b = frame((1, text.replace("A", "C")), (2, "CCNCCC"), (3, "CC"), (4, "CC"), (5, None))
    c = frame((1, text.replace("A", "C")), (2, "CGNCCC"), (3, "CCCC"), (4, "CC"), (5, "CCCC"))
    got = {r.ordinal: r.bases for r in within(40, aggregates.consect(a, [b, c]))}
    assert got == {1: text.replace("A", "C"), 2: "CAAC", 3: "CCAA", 4: None, 5: "AAAA"}


def test_versions_without_a_valid_base_do_not_vote_and_quality_is_the_highest(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "ordinal long, bases string, quals string")
    a = frame((1, "AAAAA", "55555"), (2, "AA", None), (3, "AA", "55"))
    b = frame((1, "CCCCN", "+I?I+"), (2, "CC", "II"), (3, "uN", "??"))
    c = frame((1, "CNGCN", "?III+"), (2, "CC", "II"), (3, "TN", "I+"))
    d = frame((1, "NCCC", "IIII"), (2, "CC", "II"), (3, "NC", "II"))
    got = {r.ordinal: (r.bases, r.quals) for r in aggregates.consect(a, [b, c, d]).collect()}
    assert got == {1: ("CCACA", "?I5I5"), 2: ("CC", None), 3: ("TA", "I5")}
    assert [(r.bases, r.quals) for r in aggregates.consect(a, [b]).where("ordinal = 1").collect()] == [("AAAAA", "55555")]
    bare = [x.drop("quals") for x in (b, c, d)]
    assert {r.ordinal: r.quals for r in aggregates.consect(a, bare).collect()} == {1: "!!5!5", 2: None, 3: "!5"}


def test_equal_reads_meet_the_counts_once(spark, monkeypatch):
    draw = random.Random(6)
    texts = ["".join(draw.choice("ACGT") for _ in range(40)) for _ in range(5)]
    rows = [(i, texts[i % 5] if i % 50 else texts[0][:20] + "A" + texts[0][21:]) for i in range(400)] + [(7, texts[3][:30]), (900, None), (901, "AC")]
    df = spark.createDataFrame(rows, FIELDS).withColumn("quals", F.repeat(F.lit("I"), F.length("bases")))
    given, cut = [], joins.kmer_rows

    def spied(reads, *a, **b):
        given.append(reads.count())
        return cut(reads, *a, **b)

    monkeypatch.setattr(joins, "kmer_rows", spied)
    monkeypatch.setattr(aggregates, "kmer_rows", spied)
    canonical = lambda x: min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA")))
    own = {}
    for i, x in rows:
        own.setdefault(i, []).extend(canonical(x[j : j + 9]) for j in range(len(x or "") - 8))
    depth = {}
    for x in (x for each in own.values() for x in each):
        depth[x] = depth.get(x, 0) + 1
    mid = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    want = {i: (len(x), mid([depth[y] for y in x])) for i, x in own.items() if x}
    assert {r.ordinal: (r.kmers, r.median_depth) for r in aggregates.kmer_depth(df, 9).collect()} == want
    assert {r.ordinal for r in aggregates.normalize(df, 9, 12, 5).collect()} == set(want)
    weak = {i for i, x in own.items() if x and sum(depth[y] <= 2 for y in x) / len(x) > 0.01}
    assert {r.ordinal for r in aggregates.discard_weak(df, 9, most=0.01).collect()} == {i for i, _ in rows} - weak
    aggregates.ecc_by_depth(df, 9).collect()
    assert {r.ordinal for r in filters.filter_poly(df, "GC", 9, 9, 20, 20, quality=0.0, quality2=0.0, ldf2=0.01, entropy2=0.0).collect()} >= {900, 901}
    assert given and max(given) <= 11


def test_equal_values_go_by_the_least_id(spark):
    # 0.1 + 0.2 is more than 0.3 in doubles
    nodes = spark.createDataFrame([(i, 2) for i in (1, 2, 3, 5, 6)], "id long, size int")
    edges = spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.3), (2, 5, 0.1), (2, 6, 0.2)], "a long, b long, w double")
    assert {r.id for r in graphs.representatives(edges, nodes).collect()} == {1, 5, 6}


def test_edges_that_are_given_are_not_made_again(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "ACGTACGGTT"), ("b", "ACGGTTCCCC"), ("c", "GGGGGGAAAA")], "name string, bases string")
    edges = sets.overlap_edges(rows, 5)
    monkeypatch.setattr(sets, "overlap_edges", None)
    assert {tuple(r) for r in sets.overlap_clusters(rows, edges=edges).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_near_kmers_are_all_found(spark):
    draw = random.Random(8)
    turn = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    some = lambda n: {min(x, turn(x)) for x in ("".join(draw.choice("ACGT") for _ in range(5)) for _ in range(n))}
    one, two = some(30), some(90)
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "kmer string")
    far = lambda x, y: min(sum(a != b for a, b in zip(x, z, strict=True)) for z in (y, turn(y)))
    for a, b in ((one, two), (two, one)):
        for subs in (1, 2):
            got = {tuple(r) for r in sets.near_kmers(frame(a), frame(b), subs).collect()}
            assert got == {(x, y) for x in a for y in b if far(x, y) <= subs}


def test_kmers_grow_in_many_tasks_and_as_numbers(spark):
    draw = random.Random(18)
    turn = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for k in (21, 31, 32):
        one = [min(x, turn(x)) for x in ("".join(draw.choice("ACGT") for _ in range(k)) for _ in range(50))] + ["A" * k]
        two = [x[:i] + draw.choice("ACGT") + x[i + 1 :] for i, x in enumerate(one[:20])] + ["A" * (k - 1) + "C"]
        two = [min(x, turn(x)) for x in two] + [min(x, turn(x)) for x in ("".join(draw.choice("ACGT") for _ in range(k)) for _ in range(60))]
        frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "kmer string")
        far = lambda x, y: min(sum(a != b for a, b in zip(x, z, strict=True)) for z in (y, turn(y)))
        got = {tuple(r) for r in sets.near_kmers(frame(one), frame(two), 1).collect()}
        assert got == {(x, y) for x in one for y in two if far(x, y) <= 1} and len(got) >= 20
    many = spark.range(9000).select(F.translate(F.lpad(F.conv(F.col("id").cast("string"), 10, 4), 21, "0"), "0123", "ACGT").alias("kmer"))
    plan = sets.near_kmers(many, many.withColumn("kmer", F.col("kmer")), 1)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_references_do_not_grow_for_fewer_kmers_of_reads(spark, monkeypatch):
    grown, near = [], sets.near_kmers
    monkeypatch.setattr(sets, "near_kmers", lambda *a: grown.append(1) or near(*a))
    reads = spark.createDataFrame([(1, "ACGTTGCA"), (2, "ACGATGCA"), (3, "CCCCCCCC")], FIELDS)
    refs = spark.createDataFrame([("r", "TTACGTTGCATT")], "name string, bases string")
    got = {tuple(r) for r in joins.seal(reads, refs, 8, ambiguous="all", hdist=1).collect()}
    assert got == {(1, "r", 1, 1), (2, "r", 1, 1)} and grown


def test_few_kmers_are_taken_as_in_rounds(spark, monkeypatch):
    draw = random.Random(12)
    rows = [(i, "".join(draw.choice("ACGT") for _ in range(3))) for i in range(300) for _ in range(draw.randrange(1, 9))]
    df = spark.createDataFrame(rows, "ordinal long, kmer string")
    held = {}
    for i, x in rows:
        held.setdefault(i, set()).add(x)
    want = []
    while held:
        n = {}
        for x in (x for each in held.values() for x in each):
            n[x] = n.get(x, 0) + 1
        m, x = min((-m, x) for x, m in n.items())
        want.append((x, -m))
        held = {i: each for i, each in held.items() if x not in each}
    rounds, taken = graphs.settled, []
    monkeypatch.setattr(graphs, "settled", lambda d: taken.append(1) or rounds(d))
    assert sorted(tuple(r) for r in graphs.kmer_filter_set(df).collect()) == sorted(want)
    assert len(taken) <= 2 + len(want) // 16  # a table for many picks
    monkeypatch.setattr(graphs, "FEW_KMERS", 0)
    assert sorted(tuple(r) for r in graphs.kmer_filter_set(df).collect()) == sorted(want)


def test_rows_of_a_task_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(derived, "SPREAD_ROWS", 10)
    assert derived.spread(spark.range(0, 10_000, 1, 1)).rdd.getNumPartitions() == 1000


def test_mates_of_several_files_are_paired_by_place(spark, tmp_path):
    for folder, sizes in (("a", (3, 4, 1)), ("b", (1, 2, 5))):
        (tmp_path / folder).mkdir()
        at = 0
        for i, n in enumerate(sizes):
            (tmp_path / folder / f"part-{i}.fq").write_text("".join(f"@r{j}\n{'ACGT' * (j + 1)}{'A' if folder == 'a' else 'C'}\n+\n{'I' * (4 * j + 5)}\n" for j in range(at, at + n)))
            at += n
    a, b = (formats.read_fastq(spark, str(tmp_path / x)) for x in "ab")
    got = {r.name: (r.bases1, r.bases2) for r in formats.pair_reads(a, b).collect()}
    assert got == {f"r{j}": ("ACGT" * (j + 1) + "A", "ACGT" * (j + 1) + "C") for j in range(8)}
    formats.convert(spark, str(tmp_path / "a"), str(tmp_path / "out"), "fastq", "fastq", mates=str(tmp_path / "b"))
    assert formats.read_fastq(spark, str(tmp_path / "out")).count() == 16


def test_only_sequences_that_are_asked_for_are_cut_to_seeds(spark, monkeypatch):
    draw = random.Random(14)
    long = "".join(draw.choice("ACGT") for _ in range(80))
    rows = [("a", long), ("b", long[10:40]), ("c", long[:20] + "T" * 12), ("d", long[1:79])]
    df = spark.createDataFrame(rows, "name string, bases string")
    kept, cut = [], sets.stored
    monkeypatch.setattr(sets, "stored", lambda d: kept.append(cut(d)) or kept[-1])
    got = sets.dedupe_containment(df, min_identity=90, ask="length(bases) < 40").collect()
    assert {r.name for r in got} == {"c"}
    assert {r.s for r in kept[0].select("s").distinct().collect()} == {"b", "c"}
