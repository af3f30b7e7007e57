"""Plans and results that hold as tables grow: no broadcast of what k-mers make of small files, ids and texts that meet."""

import random

from pyspark.sql import functions as F

from strandlake.operators import aggregates, joins, pileup, sets
from strandlake.plans import derived, queries_io, queries_sets, registry
from strandlake.sources import formats, shared
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_kmers_of_small_files_are_not_broadcast(spark):
    a, b = derived.tables(spark, SF, "dv_reads", "dv_contigs")
    met = joins.kmer_rows(a, "ordinal", 9).join(joins.kmer_rows(b, "name", 9).select("name", "kmer").distinct(), "kmer")
    assert "BroadcastHashJoin" not in plan(met)
    for name in ("kmer_classify", "split_ribo", "split_by_reference"):
        assert "BroadcastHashJoin" not in plan(registry.QUERIES[name](spark, SF))


def test_texts_of_a_small_file_are_many_tasks(spark):
    contigs, = derived.tables(spark, "/root/testdata/sf0.1", "dv_contigs")
    assert contigs.rdd.getNumPartitions() >= 4


def test_equal_reads_are_classified_once(spark):
    refs = spark.createDataFrame([("r1", "ACGTACGGATTT"), ("r2", "TTGACCATGGAA")], "name string, bases string")
    reads = spark.createDataFrame([(1, "ACGTACGGAT"), (2, "ACGTACGGAT"), (3, None), (4, "ACGTAC"), (4, "CATGGAA"), (5, "TTGACCATG")], "ordinal long, bases string")
    assert joins.same_sequence(reads, "ordinal").groupBy("ordinal", "__rep").count().orderBy("ordinal").collect() == [(1, 1, 1), (2, 1, 1), (4, 4, 1), (5, 5, 1)]
    for ambiguous in ("first", "random", "all", "toss"):
        got = {tuple(r) for r in joins.seal(reads, refs, 5, ambiguous=ambiguous).select("read", "ref", "hits", "kmers").collect()}
        assert {(1, "r1", 6, 6), (2, "r1", 6, 6), (4, "r2", 3, 5), (5, "r2", 5, 5)} <= got
        assert {r[0] for r in got} == {1, 2, 4, 5}


def test_a_kmer_histogram_has_every_depth(spark):
    counts = spark.createDataFrame([("A", 100_000), ("C", 100_001), ("G", 7_000_000), ("T", 7_000_000)], "kmer string, count long")
    assert {tuple(r) for r in aggregates.kmer_hist(counts).collect()} == {(100_000, 1), (100_001, 1), (7_000_000, 2)}
    assert {tuple(r) for r in aggregates.kmer_hist(counts, 100_000).collect()} == {(100_000, 4)}


def test_places_come_from_one_sort(spark):
    draw = F.udf(lambda: random.random(), "double").asNondeterministic()  # a sort that no second run repeats
    ordered = spark.range(0, 2000, 1, 8).withColumn("r", draw()).orderBy("r")
    assert sorted(r.place for r in queries_io.placed(ordered, "id").collect()) == list(range(2000))


def test_equal_numbers_of_other_sequences(spark):
    df = spark.createDataFrame([(1, "ACGTT"), (1, "GGGAC"), (2, "GGGAC"), (3, None), (4, None)], "ordinal long, bases string")
    assert [tuple(r) for r in sets.dedupe(df, unique_only=True).collect()] == [(1, "ACGTT")]
    assert sorted(r.ordinal for r in sets.dedupe(df).collect()) == [1, 1, 3]


def test_overlaps_and_containment_are_not_broadcast(spark):
    rows = queries_sets.overlapping(*derived.tables(spark, SF, "dv_contigs"))
    assert "BroadcastHashJoin" not in plan(sets.overlap_edges(rows, 15))
    assert "BroadcastHashJoin" not in plan(sets.dedupe_containment(rows, 15))


def test_pieces_of_fastq_records_meet_on_their_places(spark, tmp_path):
    records = [f"@r{i}\nACGT\n+\n{'@' if i % 3 == 0 else 'I'}III" for i in range(3000)]
    (tmp_path / "x.fq").write_text("\n".join(records) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4001)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = formats.read_fastq(spark, str(tmp_path / "x.fq"))
        joins_ = [x for x in plan(got).splitlines() if "Join" in x]
        assert joins_ and all("," in x[x.index("[") : x.index("]")] for x in joins_)  # never by the file alone
        rows = got.orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.name, r.bases, r.quals) for r in rows] == [(f"r{i}", "ACGT", ("@" if i % 3 == 0 else "I") + "III") for i in range(3000)]


def test_rounds_do_not_multiply_guessed_sizes(spark):
    rows = shared.settled(spark.range(4))
    for _ in range(6):  # a guess that lasts squares each round
        rows = shared.settled(rows.join(rows.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1e6
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2, 3]
    assert "BroadcastHashJoin" not in plan(rows.join(spark.range(4), "id"))


def test_pairs_are_counted_without_listing_them(spark):
    some = random.Random(3)
    rows = [(i, some.choice([0.3, 0.31, 0.325, 0.33, 0.5, 0.52]), some.choice([1, 2, 3, None])) for i in some.sample(range(10_000), 300)] + [(20_000, 0.9, 1), (20_001, None, 1)]
    contigs = spark.createDataFrame(rows, "id long, gc double, genome long").repartition(5)
    listed = joins.pair_vectors(contigs.withColumn("vector", F.array("gc")), rate=None)
    first = listed.groupBy("id").agg(F.count("*").alias("pairs"), F.count_if(F.col("label") == 1).alias("same"))
    assert sorted(map(tuple, joins.pair_counts(contigs).select("id", "pairs", "same").collect())) == sorted(map(tuple, first.collect()))
    many = spark.range(0, 300_000, 1, 8).select("id", F.lit(0.5).alias("gc"), (F.col("id") % 2).alias("genome"))  # 45 billion pairs
    assert joins.pair_counts(many).agg(F.sum("pairs"), F.sum("same")).first() == (300_000 * 299_999 // 2, 150_000 * 149_999)


def test_alignments_are_read_without_what_is_not_asked_for(spark):
    ref = spark.createDataFrame([("c", "ACGTACGTACGTACGTACGT")], "name string, bases string")
    rows = [(i, "c", 3, "6M", "GTACTT" if i < 3 else "GTACGT", 0, 30) for i in range(4)] + [(9, "c", 1, "2M2M1I3=", "ACGCTACG", 1, 30)]
    aln = spark.createDataFrame(rows, "aln_id long, rname string, pos long, cigar string, seq string, strand long, mapq long")
    unread = aln.withColumn("quals", F.raise_error(F.lit("qualities were read")).cast("string"))
    assert dict(pileup.exact_codes(unread, ref, tile=4).collect()) == {0: "4=1X1=", 1: "4=1X1=", 2: "4=1X1=", 3: "6=", 9: "3=1X1I3="}
    assert pileup.consensus_alignments(unread, ref, tile=4).first()["bases"] == "ACGTACTTACGTACGTACGT"
    assert sorted(map(tuple, pileup.filter_bad_reads(unread, ref, 0, 1, border=0, tile=4).collect())) == [(9, 2)]
    called = pileup.call_alignments(unread, ref, min_count=3, tile=4, quality=False).drop("end_mean").first()
    assert (called["start"], called["allele"], called["count"], called["depth"]) == (7, "T", 3, 5.0)


def test_qualities_are_counted_without_a_row_for_each_base(spark):
    a, c = derived.tables(spark, SF, "dv_sam", "dv_contigs")
    assert "Generate" not in plan(pileup.quality_accuracy(a, c))
    far = spark.createDataFrame([("c", "ACéTAC")], "name string, bases string")
    aln = spark.createDataFrame([(1, "c", 1, "8M", "ACGTACGT", "IIIIIIII", 0, 30)], "aln_id long, rname string, pos long, cigar string, seq string, quals string, strand long, mapq long")
    assert [tuple(r)[:3] for r in pileup.quality_accuracy(aln, far).collect()] == [(40, 5, 0)]
    assert pileup.exact_codes(aln, far).first()["cigar"] == "2=1X3=2X"
