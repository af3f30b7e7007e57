"""Readers, writers, hooks, streams and operators on small made files."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.functions import hooks
from strandlake.functions import sequence as S
from strandlake.operators import aggregates as ag
from strandlake.operators import graphs as gr
from strandlake.operators import joins as jo
from strandlake.operators import projections as pr
from strandlake.operators import sets as st
from strandlake.operators import similarity as si
from strandlake.operators import windows as wi
from strandlake.sources import formats as fm
from strandlake.streaming import flows


def put(path, text):
    path.write_text(text)
    return str(path)


def one(spark, *cols, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(*cols).first()


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">one with spaces\nACGT\nacgt\n>two\nNNNNNNNNNNNN\n>empty\n>iupac\nACGRYK\n")
    got = {r["name"]: r["bases"] for r in fm.read_fasta(spark, p).collect()}
    assert got == {"one with spaces": "ACGTacgt", "two": "N" * 12, "empty": "", "iupac": "ACGRYK"}
    assert fm.read_fasta(spark, p, min_len=7).count() == 2
    assert fm.read_fasta(spark, p, break_len=5).where("name = 'two'").count() == 3


def test_fastq(spark, tmp_path):
    text = "@r1/1\nACGT\n+\n@III\n@r1/2\nTTTT\n+\nIIII\n@r2/1\nGG\n+r2\nI@\n"
    p = put(tmp_path / "a.fq", text)
    rows = [tuple(r) for r in fm.read_fastq(spark, p).orderBy("ordinal").select("name", "bases", "quals").collect()]
    assert rows == [("r1/1", "ACGT", "@III"), ("r1/2", "TTTT", "IIII"), ("r2/1", "GG", "I@")]
    out = str(tmp_path / "out")
    fm.write_reads(fm.read_fastq(spark, p), out, "fastq", order="ordinal")
    again = fm.read_fastq(spark, out)
    assert sorted(r["name"] for r in again.collect()) == ["r1/1", "r1/2", "r2/1"]
    pairs = fm.pair_reads(fm.read_fastq(spark, p)).collect()
    assert len(pairs) == 1 and pairs[0]["bases2"] == "TTTT"


def test_other_readers(spark, tmp_path):
    fa, q = put(tmp_path / "b.fa", ">x\nAC\n"), put(tmp_path / "b.qual", ">x\n40 2\n")
    assert fm.read_fasta_qual(spark, fa, q).first()["quals"] == "I#"
    assert fm.read_oneline(spark, put(tmp_path / "o.txt", "n\tACGT\n")).first()["bases"] == "ACGT"
    assert tuple(fm.read_scarf(spark, put(tmp_path / "s.txt", "M:1:2:ACGT:IIII\n")).first()) == ("M:1:2", "ACGT", "IIII")
    sam = put(tmp_path / "a.sam", "@HD\tVN:1\nq\t16\tc1\t5\t30\t3=1X\t*\t0\t0\tACGT\tIIII\tNM:i:1\tMD:Z:3A\n")
    head, rows = fm.read_sam(spark, sam)
    r = rows.first()
    assert head.count() == 1 and r["pos"] == 5 and r["tags"] == {"NM": "1", "MD": "3A"}
    vcf = put(tmp_path / "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\nc\t3\t.\tA\tC\t5\tPASS\tDP=3;AF=1\tGT\t1\nc\t3\t.\tA\tC\t9\tPASS\tDP=4\tGT\t1\n")
    _, samples, v = fm.read_vcf(spark, vcf)
    assert samples == ["s1"] and [(x["qual"], x["info"]["DP"]) for x in v.collect()] == [(9.0, "4")]
    gff = put(tmp_path / "a.gff", "#x\nc\ts\tCDS\t1\t9\t.\t+\t0\tID=a;Name=b\n")
    assert fm.read_gff(spark, gff).first()["attributes"]["Name"] == "b"
    gb = put(tmp_path / "a.gb", "LOCUS       L1 100 bp\nFEATURES\n     CDS             complement(3..20)\n     gene            1..30\n//\n")
    assert sorted((r["seqid"], r["type"], r["start"], r["stop"], r["strand"]) for r in fm.read_gbff(spark, gb).collect()) == [("L1", "CDS", 3, 20, "-"), ("L1", "gene", 1, 30, "+")]
    phy = put(tmp_path / "a.phy", "2 8\nA ACGT\nB TTTT\n\nCCCC\nGGGG\n")
    assert sorted(map(tuple, fm.read_phylip(spark, phy).collect())) == [("A", "ACGTCCCC"), ("B", "TTTTGGGG")]
    assert fm.read_covstats(spark, put(tmp_path / "c.tsv", "#ID\tAvg_fold\nx\t2.5\n")).first()["avg_fold"] == 2.5
    assert fm.read_hmm(spark, put(tmp_path / "h.txt", "# c\np1 - 120 m1 - 50 1e-9 33.2\n")).first()["length"] == 120
    assert fm.read_sketch_results(spark, put(tmp_path / "k.txt", "Query: q1\n90%\t80%\t99.5%\tref1\n\nQuery: q2\n")).first()["ani"] == 99.5
    fm.convert(spark, sam, str(tmp_path / "conv"), "sam", "fasta")
    assert fm.read_fasta(spark, str(tmp_path / "conv")).first()["bases"] == "ACGT"
    fm.write_demux(fm.demux(fm.read_fasta(spark, fa), F.col("name")), str(tmp_path / "dm"))
    assert (tmp_path / "dm" / "route=x").exists()
    assert jo.mux(spark, [fa]).first()["value"].startswith("b.fa_")
    assert st.concat_text(spark, [sam, put(tmp_path / "b.sam", "@HD\tVN:2\nrow\n")]).count() == 3


def test_cigars_and_alleles(spark):
    r = one(spark, S.cigar_to_m(F.col("c")).alias("m"), S.cigar_sum(F.col("c"), "ID").alias("n"), c="3=1X2I4=2D3S")
    assert tuple(r) == ("4M2I4M2D3S", 4)
    aln = spark.createDataFrame([("ref", 2, "4M1I2M", "CGTACTA")], "rname string, pos int, cigar string, seq string")
    ref = spark.createDataFrame([("ref", "ACGTTTC")], "name string, bases string")
    assert pr.sam_to_new(aln, ref).first()["cigar"] == "3=1X1I1=1X"
    v = spark.createDataFrame([("c", 10, "CAG", "CTG"), ("c", 5, "ATT", "AT"), ("c", 7, "A", "AT")], "chrom string, pos int, ref string, alt string")
    assert sorted(tuple(x) for x in pr.canonize(v).collect()) == [("c", 5, "AT", "A"), ("c", 7, "A", "AT"), ("c", 11, "A", "T")]


def test_masks_and_trims(spark):
    df = spark.createDataFrame([("s", "A" * 40 + "ACGTTGCATCGGATCCTAGGCATTACGGAC")], "name string, bases string")
    out = pr.mask_entropy(df, "name", 20, 3, 0.6).first()["bases"]
    assert out.startswith("N" * 40) and out.endswith("ATTACGGAC")
    t = one(spark, pr.quality_trim(F.col("b"), F.col("q"), 10.0).alias("t"), b="ACGTACGT", q="##IIII##")["t"]
    assert (t["bases"], t["trimmed"]) == ("GTAC", 4)
    assert one(spark, pr.adjust_homopolymers(F.col("b"), 1).alias("x"), b="AACGGG")["x"] == "AAACGGGG"


def test_variants_and_consensus(spark):
    ref = spark.createDataFrame([("c", "AAAAAAAAAA")], "name string, bases string")
    v = spark.createDataFrame([("c", 2, "AA", "G", 5), ("c", 3, "A", "T", 9), ("c", 8, "A", "ACC", 1)], "chrom string, pos int, ref string, alt string, count int")
    assert ag.apply_variants(ref, v).first()["bases"] == "AATAAAAACCAA"
    assert one(spark, ag.recalibrate(F.col("q"), {40: 30}).alias("x"), q="I5")["x"] == "?5"


def test_orfs_unitigs_crispr(spark):
    c = spark.createDataFrame([("s", "CCATGAAACCCGGGTAGCC")], "name string, bases string")
    o = si.find_orfs(c, 15).where("frame = 2").first()
    assert o["amino"] == "MKPG*"
    k = spark.createDataFrame([(x,) for x in ("ACGT", "CGTT", "GTTA", "TTTT")], "kmer string")
    assert "ACGTTA" in {r["bases"] for r in gr.unitigs(k, 4).collect()}
    rep = "ACGGTCATTGCAAGGCTTACGATC"
    s = spark.createDataFrame([("s", f"TT{rep}GATTACAGATTACAGACG{rep}CC")], "name string, bases string")
    r = wi.find_crisprs(s, 20).first()
    assert (r["start"], r["repeat_length"], r["spacer_length"]) == (2, 24, 18)


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (4, 5, 1.0)], "a long, b long, w double")
    n = spark.createDataFrame([(i, 2, i) for i in range(1, 7)], "id long, size int, rank int")
    assert {r["id"] for r in gr.representatives(e, n).collect()} == {2, 4, 6}
    assert {r["id"] for r in gr.pick_subset(e, n, 0.9).collect()} == {1, 3, 4, 6}
    assert {r["node"]: r["component"] for r in gr.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    p = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.1), (2, 3, 0.2)], "a long, b long, identity double")
    assert gr.id_tree(p, gr.connected_components(p)).first()["newick"] == "((1,2),3);"
    k = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "ordinal long, kmer string")
    assert sorted(map(tuple, gr.kmer_filter_set(k).collect())) == [("A", 2), ("B", 1)]


def test_hooks(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "x long, k long")
    assert hooks.map_reads(df, lambda b: b[b["x"] > 6]).count() == 3
    got = hooks.udaf(df, ["k"], lambda p: int(p["x"].sum()), sum, lambda s: {"total": s}, "total long").collect()
    assert {r["k"]: r["total"] for r in got} == {0: 20, 1: 25}
    assert hooks.flat_map(df, lambda r: [{"y": r["x"]}] * 2, "y long").count() == 20


def run_stream(df, mode):
    q = df.writeStream.format("memory").queryName(f"q{abs(hash(str(df.schema))) % 10**9}").outputMode(mode).start()
    q.processAllAvailable()
    name = q.name
    q.stop()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("x\ny\nx\n")
    assert {r["value"]: r["n"] for r in run_stream(flows.stream_counts(flows.stream_source(spark, str(src)), "value"), "complete").collect()} == {"x": 2, "y": 1}
    assert run_stream(flows.stream_dedupe(flows.stream_source(spark, str(src)), ["value"]), "append").count() == 2
    fq = tmp_path / "fq"
    fq.mkdir()
    (fq / "a.fq").write_text("@a\nAC\n+\nII\n@b\nGG\n+\n@I\n")
    assert sorted(r["name"] for r in run_stream(flows.stream_fastq(spark, str(fq)), "append").collect()) == ["a", "b"]
    aln = spark.createDataFrame([("c", 1, 4), ("c", 3, 4)], "rname string, pos long, ref_len long")
    aln.write.parquet(str(tmp_path / "aln"))
    s = spark.readStream.schema(aln.schema).parquet(str(tmp_path / "aln"))
    assert sorted(map(tuple, run_stream(flows.stream_pileup(s), "complete").collect())) == [("c", 1, 1), ("c", 3, 1), ("c", 5, -1), ("c", 7, -1)]


def test_late_rows_and_state(spark, tmp_path):
    log = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:50", "2024-01-01 05:00"]), "status": ["200", "500", "200"], "latency": [1.0, 2.0, 3.0]})
    df = spark.createDataFrame(log)
    df.write.parquet(str(tmp_path / "log"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    assert run_stream(flows.webcheck_windows(s), "update").count() == 3

    def count(key, frames, state):
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({"status": [key[0]], "n": [n]})

    assert {r["status"]: r["n"] for r in run_stream(flows.stateful(s, "status", count, "status string, n long", "n long"), "append").collect()} == {"200": 2, "500": 1}


def test_limit_stream(spark, tmp_path):
    src = tmp_path / "reads"
    for i, b in enumerate(("ACGTACGTAA", "GGGTTTACGA")):
        spark.createDataFrame([(b,)], "bases string").coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema("bases string").option("maxFilesPerTrigger", 1).parquet(str(src))
    seen = []
    q = flows.limit_stream(s, 4, 3, str(tmp_path / "state"), lambda b: seen.append(b.count())).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [1]


@pytest.mark.parametrize("bases,want", [("ACGTN", "NACGT"), ("acgu", "acgt"), ("", ""), ("RYKM", "KMRY")])
def test_revcomp(spark, bases, want):
    assert one(spark, S.revcomp(F.col("b")).alias("x"), b=bases)["x"] == want


def test_fastq_that_splits(spark, tmp_path):
    """Blocks end anywhere, also in a quality line that begins like a record."""
    import random

    r, text, want = random.Random(2), [], []
    for i in range(700):
        n = r.randrange(1, 60)
        bases, quals = "".join(r.choice("ACGTN") for _ in range(n)), "".join(r.choice("@@+I!") for _ in range(n))
        want.append((i, f"r{i} {1 + i % 2}:N:0:AC", 1 + i % 2, bases, quals))
        text.append(f"@{want[-1][1]}\n{bases}\n+\n{quals}\n")
    p = tmp_path / "x.fq"
    p.write_text("".join(text))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in ("701b", "1499b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = fm.read_fastq(spark, str(p)).select("ordinal", "name", "pair", "bases", "quals").collect()
            assert sorted(map(tuple, rows)) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_malformed_fastq(spark, tmp_path):
    import pytest

    p = tmp_path / "x.fq"
    p.write_text("@a\nACGT\n+\nIIII\n@b\nACGT\n+\nIII\n@c\nAC\n")
    with pytest.raises(Exception, match="no FASTQ record"):
        fm.read_fastq(spark, str(p)).collect()
    rows = fm.read_fastq(spark, str(p), malformed="keep").collect()
    assert sorted(str(r["name"]) for r in rows) == ["None", "None", "a"]


def test_joined_locations_and_embl(spark, tmp_path):
    g = tmp_path / "x.gb"
    g.write_text('LOCUS       L1  9 bp\n     CDS             complement(join(5..9,\n                     20..<30))\n                     /gene="x"\n                     /pseudo\n     gene            7\n//\n')
    rows = [tuple(r)[2:7] for r in fm.read_gbff(spark, str(g)).orderBy("feature", "part").collect()]
    assert rows == [(1, "CDS", 5, 9, "-"), (2, "CDS", 20, 30, "-"), (1, "gene", 7, 7, "+")]
    e = tmp_path / "x.embl"
    e.write_text('ID   E1; SV 1;\nFT   CDS             join(1..2,4..6)\nFT                   /gene="y z"\n//\n')
    got = fm.read_gbff(spark, str(e)).orderBy("part").collect()
    assert [(r["seqid"], r["start"], r["stop"], r["attributes"]) for r in got] == [("E1", 1, 2, {"gene": "y z"}), ("E1", 4, 6, {"gene": "y z"})]


def test_cycles_of_kmers(spark):
    whole = "ACGTTAGC"
    ring = whole + whole[:3]
    k = spark.createDataFrame([(ring[i : i + 4],) for i in range(8)] + [("TTTT",), ("GGGA",), ("GGAC",)], "kmer string")
    got = {(r["bases"], r["kmers"]) for r in gr.unitigs(k, 4).collect()}
    assert got == {("ACGTTAGCACG", 8), ("TTTT", 1), ("GGGAC", 2)}


def test_communities_raise_modularity(spark):
    clique = lambda a, n: [(a + i, a + j, 1.0) for i in range(n) for j in range(i)]
    e = spark.createDataFrame(clique(0, 6) + clique(10, 5) + clique(20, 7) + [(0, 10, 1.0), (11, 20, 1.0)], "a long, b long, w double")
    got = {r["node"]: r["community"] for r in gr.communities(e).collect()}
    assert {frozenset(n for n in got if got[n] == c) for c in set(got.values())} == {frozenset(range(6)), frozenset(range(10, 15)), frozenset(range(20, 27))}
    m = 15 + 10 + 21 + 2
    want = (15 + 10 + 21) / m - sum((d / (2 * m)) ** 2 for d in (31, 22, 43))
    labels = spark.createDataFrame(list(got.items()), "node long, l long")
    assert abs(gr.modularity(e, labels) - want) < 1e-9


def test_kmer_cover_is_the_greedy_one(spark):
    import random
    from collections import Counter

    r = random.Random(5)
    rows = {(i, r.choice("ABCDEFGHIJ")) for i in range(60) for _ in range(3)}
    left, want = set(rows), []
    while left:
        n = Counter(k for _, k in left)
        k = min(n, key=lambda x: (-n[x], x))
        want.append((k, n[k]))
        done = {i for i, x in left if x == k}
        left = {(i, x) for i, x in left if i not in done}
    got = gr.kmer_filter_set(spark.createDataFrame(sorted(rows), "ordinal long, kmer string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_records_without_ordinals_are_not_sorted(spark, tmp_path):
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(50)))
    got = fm.read_fastq(spark, str(tmp_path / "a.fq"))
    assert [r.ordinal for r in got.orderBy("ordinal").collect()] == list(range(50))
    bare = got.select("name", "bases", "quals")
    plan = bare._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and bare.count() == 50
