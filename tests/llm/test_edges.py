"""Odd rows, empty tables and names that clash, for every operator."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import decontaminate, importance, jaccard_join, line_dedup, piece_sampling, pii, quality_rules, substring_dedup, token_binary, url_filter
from tests.conftest import SF
from tests.llm.conftest import PASSAGE, WORDS

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1), (5, 1), (7, 1), (9, 0), (9, None), (None, 1)], "doc_id long, quality int")


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (None, "x y z"), (3, ""), (4, "one two")], "item_id long, text string")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_importance(odd, empty, labels):
    out = importance.classify(odd, labels)
    assert out.count() == odd.count()
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["log_weight"] == got[2]["log_weight"] == got[3]["log_weight"] == 0.0
    assert importance.classify(empty, labels).count() == 0
    assert importance.classify(odd, labels.where("false")).where("accepted").count() == odd.count()
    assert importance.keep_accepted(odd, labels).columns == odd.columns


def test_piece_sampling(odd, empty):
    out = piece_sampling.encode(odd, PIECES, 2)
    got = out.collect()
    assert all(r["decoded_ok"] for r in got)
    assert {r["doc_id"] for r in got} == {None, *range(1, 13)}
    assert [r["n_pieces"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["sample"]), set()).add(r["ids_crc32"])
    assert all(len(v) == 1 for v in by.values())  # a repeated row has the same samples
    assert piece_sampling.encode(empty, PIECES).count() == 0


def test_decontaminate(odd, empty, items):
    hit = {r["doc_id"]: r for r in decontaminate.contaminated(odd, items).collect()}
    assert set(hit) == {7, 8, 9, 10} and hit[7]["item_id"] == 1 and hit[9]["item_id"] == 4
    assert decontaminate.decontaminate(odd, items).count() == odd.count() - 4
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.where("false")).count() == 0


def test_jaccard_join(odd, empty):
    got = rows(jaccard_join.join(odd), "doc_id", "n_shingles", "component_id")
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (None, None, None) in got
    assert [g[2] for g in got if g[0] in (5, 6)] == [5, 5, 5]
    assert [g[2] for g in got if g[0] in (9, 10)] == [9, 9] or [g[2] for g in got if g[0] in (10, 9)] == [9, 9]
    assert jaccard_join.join(empty).count() == 0
    kept = {r["doc_id"] for r in jaccard_join.keep_first(odd).collect()}
    assert 6 not in kept and 10 not in kept and {None, 1, 2, 3, 5, 9} <= kept


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://a.net/fr/2#t", None, "no scheme", "://", "http://spam-farm.org/", "http://x.org", "http://casinospamfarm.org/de", "http://b.example.com/en", "ftp://com/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(None, "http://q.org/", 1)], "page_id long, url string, verdict int")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[1]["rule"], got[1]["verdict"]) == ("net/fr/", "block")
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"]) == ("", "", None) for i in (2, 3, 4))
    assert got[5]["verdict"] == "block" and "casino spam farm" in got[7]["words"] and got[7]["verdict"] == "block"
    assert got[8]["rule"] == "com/" and got[9]["rule"] == "com/" and got[6]["path"] == ""
    assert url_filter.judge(pages.where("false")).count() == 0


def test_line_dedup(spark, odd, empty):
    line = "This line is on many documents."
    docs = spark.createDataFrame([(1, f"{line}\nown one"), (2, f"  {line.upper()}\t\nown two\n{line}"), (3, f"{line}\n{line}"), (4, "short\nshort"), (5, "short"), (6, "short"), (None, line)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1]["line_kept"] == "own one" and got[2]["line_kept"] == "own two" and got[3]["line_drops"] == 0 and got[4]["line_drops"] == 0
    assert got[None]["line_kept"] == line
    out = line_dedup.dedup_lines(odd, prefix="cut")
    assert out.count() == odd.count() and {r["cut_count"] for r in out.where("doc_id in (1, 2)").collect()} == {1}
    assert {r["line_kept"] for r in out.collect()} == {"k"}
    assert line_dedup.dedup_lines(empty, prefix="cut").count() == 0


def test_pii(odd, empty):
    docs = odd.select("doc_id", "text")
    got = {r["doc_id"]: r for r in pii.find_pii(docs, pii.fit(docs)).collect()}
    r = got[11]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert got[1]["spans"] == "" and got[2]["spans"] == ""
    assert r["base_spans"].startswith("email:27:42,ip:") and all(s in r["spans"].split(",") for s in r["base_spans"].split(","))
    assert pii.find_pii(empty, {}).count() == 0


def test_substring_dedup(odd, empty):
    got = {r["doc_id"]: r for r in substring_dedup.dedup(odd).collect()}
    assert got[8]["n_removed"] == 70 and got[8]["kept"] == "other words first" and got[7]["n_removed"] == 0
    assert got[6]["n_removed"] == got[6]["n_words"] == len(WORDS.split()) and got[5]["n_removed"] == 0
    assert got[1]["n_words"] == got[2]["n_words"] == 0 and got[None]["n_removed"] == 0
    assert substring_dedup.dedup(odd).count() == odd.count() - 1 + 1
    assert substring_dedup.dedup(empty).count() == 0


def test_token_binary(odd, empty):
    got = token_binary.read_segments(token_binary.write_segments(odd, WORD_BPE)).orderBy("start").collect()
    assert len(got) == odd.count() and got[0]["doc_id"] is None and got[0]["start"] == 0
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got[:-1], got[1:], strict=True))
    assert [r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert token_binary.read_segments(token_binary.write_segments(empty, WORD_BPE)).count() == 0


def test_quality_rules(odd, empty, labels):
    m = quality_rules.metrics(odd)
    out = quality_rules.judge(m, quality_rules.fit_cutoffs(m, labels))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd.count() and got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert quality_rules.judge(quality_rules.metrics(empty), quality_rules.fit_cutoffs(m, labels)).count() == 0
    assert quality_rules.fit_cutoffs(m, labels.where("false")).count() == 0


def test_hash_is_hex(odd):
    d = odd.where("doc_id = 9").select(F.sha2("text", 256).alias("h")).first()["h"]
    assert d == hashlib.sha256(b"one two").hexdigest()


def test_pipeline_stages(spark, odd, empty):
    """Odd rows, an empty table and columns with names that the operators use inside."""
    stages = dict(corpus_pipeline.STAGES)
    clash = {"line_count": "a", "line_map": "b", "__bad": "c", "rank": "d"}
    odd, empty = (df.withColumns({k: F.lit(v) for k, v in clash.items()}) for df in (odd, empty))
    rest = [c for c in odd.columns if c not in ("text", "n_chars")]
    before = sorted((tuple(r[c] for c in rest) for r in odd.collect()), key=str)
    for name in ("quality", "line_dedup", "near_copies", "decontaminate"):
        out = stages[name](spark, empty, SF)
        assert out.columns == empty.columns and out.count() == 0
        out = stages[name](spark, odd, SF)
        assert out.columns == odd.columns
        got = sorted((tuple(r[c] for c in rest) for r in out.collect()), key=str)
        assert set(got) <= set(before) and all(r[rest.index(k)] == v for r in got for k, v in clash.items())
        if name != "quality":
            ids = {r[0] for r in got}
            gone = {6, 8, 10} if name == "near_copies" else set()  # the texts of 5 and 9 but for capitals, and most of 7
            assert ids == {r[0] for r in before} - gone
    assert stages["encode"](spark, empty, SF).count() == 0
    assert all(r["decoded_ok"] for r in stages["encode"](spark, odd, SF).collect())


def test_line_dedup_names(odd):
    with pytest.raises(ValueError, match="line_kept"):
        line_dedup.dedup_lines(odd)
    assert line_dedup.dedup_lines(odd, prefix="cut").columns == [*odd.columns, "cut_count", "cut_drops", "cut_kept", "cut_map"]


def test_urls(spark):
    """Very long, repeated and broken URLs, names of one letter and of marks only."""
    long = "x" * 300_000
    urls = [None, "", "no host", "://", "http://", f"http://{long}.org/{long}", "http://a.org/", "http://a.org/", "HTTP://WWW.Example.COM/en/", "http://--.--/--", "http://ünï.org/ß"]
    df = spark.createDataFrame([(i if i else None, u, "k") for i, u in enumerate(urls)], "page_id long, url string, words string")
    got = url_filter.judge(df).collect()
    assert len(got) == len(urls) and {r["verdict"] for r in got} == {"allow"}
    by = {r["page_id"]: r for r in got}
    assert by[6]["score"] == by[7]["score"] and by[8]["rule"] == "www.example.com/en/" and len(by[5]["path"]) == 300_001
    assert [by[i]["host"] for i in (1, 2, 3, 4)] == [""] * 4 and by[1]["score"] is None
    assert url_filter.judge(df.where("false")).count() == 0
