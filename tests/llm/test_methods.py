"""Methods against brute force, exact round trips and DuckDB."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from strandlake.llm import decontaminate, importance, jaccard_join, kernels, piece_sampling, pii, quality_rules, substring_dedup, token_binary, url_filter
from strandlake.llm.common import in_filter, read
from tests.conftest import SF

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SPACE = "\x20\x09-\x0d"


def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.mark.parametrize("name", ["op4_jaccard_join", "op6_line_dedup", "op8_substring_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda d: d.sort_values("doc_id").reset_index(drop=True).astype(str)
    pd.testing.assert_frame_equal(key(got), key(want))


def test_word_hashes_follow_words():
    t = ["a b", "", None, "b  a\tab", "é\x0bb", "b"]
    h, at = kernels.words_of(pa.array(t))
    words = [w for x in t for w in re.findall(f"[^{SPACE}]+", x or "")]
    assert at.tolist() == [0, 2, 2, 2, 5, 7, 8]
    assert all((a == b) == (x == y) for (a, x), (b, y) in itertools.combinations(zip(h.tolist(), words, strict=True), 2))


def test_rolling_ranges():
    r = np.random.default_rng(1).integers(0, 3, 200).astype(np.uint64)
    roll = kernels.Rolling(kernels.mix(r + np.uint64(9)))
    got = {}
    for a in range(190):
        h = int(roll.ranges(np.array([a]), np.array([a + 7]))[0])
        assert got.setdefault(tuple(r[a : a + 7]), h) == h
    assert len(set(got.values())) == len(got)


# -- sampled segmentations --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lattices():
    return piece_sampling.Lattices(piece_sampling.Vocabulary(PIECES))


def all_segmentations(v, s):
    if not s:
        return [((), 0.0)]
    out = []
    for n in range(1, v.longest + 1):
        if n <= len(s) and s[:n] in v.pieces:
            i = v.pieces[s[:n]]
            out += [((i, *r), v.log[i] + w) for r, w in all_segmentations(v, s[n:])]
    if s[0] not in v.pieces:
        b = s[0].encode()
        out += [((*(int(v.byte_id[x]) for x in b), *r), len(b) * v.byte_log + w) for r, w in all_segmentations(v, s[1:])]
    return out


def test_samples_follow_the_lattice(lattices):
    text, n = "of ☃\nhat", 6000
    every = all_segmentations(lattices.v, " " + text)
    z = math.log(sum(math.exp(w) for _, w in every))
    p = {i: math.exp(w - z) for i, w in every}
    got = piece_sampling.sample(lattices, [text] * n, np.arange(n), 3)
    first, second, weighed = Counter(), Counter(), Counter()
    for rows in got:
        ids = [tuple(piece_sampling.row_ids(lattices, [r[0]])[0].tolist()) for r in rows]
        assert len(set(ids)) == 3 and all(abs(math.log(p[i]) - r[1]) < 1e-6 for i, r in zip(ids, rows, strict=True))
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        first[ids[0]] += 1
        second[ids[0], ids[1]] += 1
        for i, r in zip(ids, rows, strict=True):
            weighed[i] += math.exp(-r[3])
    (a, pa_), (b, pb) = sorted(p.items(), key=lambda x: -x[1])[:2]
    assert abs(first[a] / n - pa_) < 0.02 and abs(second[a, b] / n - pa_ * pb / (1 - pa_)) < 0.03
    assert abs(weighed[a] / n - 1) < 0.05 and abs(weighed[b] / n - 1) < 0.1  # inclusion scores: Horvitz-Thompson


def test_few_segmentations_and_long_chunks(lattices):
    got = piece_sampling.sample(lattices, ["a", ""], np.arange(2), 5)
    assert [len(x) for x in got] == [2, 1] and all(r[3] == 0.0 for r in got[0])


@pytest.mark.parametrize("chars", [4095, 4096, 5000, 150_000])
def test_long_chunks_are_one_lattice(lattices, chars, monkeypatch):
    """Ranges give the lattice of the whole chunk, masses and all."""
    text = ("thereofthe" * (chars // 10 + 1))[:chars]
    got = piece_sampling.sample(lattices, [text], np.arange(1), 2)[0]
    assert [piece_sampling.decode(lattices.v, piece_sampling.row_ids(lattices, [r[0]])[0].tolist()).decode() for r in got] == [text] * 2
    monkeypatch.setattr(piece_sampling, "RANGE_CHARS", 1 << 20 if chars > 10_000 else 700)
    other = piece_sampling.Lattices(lattices.v)
    again = piece_sampling.sample(other, [text], np.arange(1), 2)[0]
    assert all((piece_sampling.row_ids(lattices, [a[0]])[0] == piece_sampling.row_ids(other, [b[0]])[0]).all() and a[1:] == b[1:] for a, b in zip(got, again, strict=True))


def test_samples_do_not_depend_on_the_rows_around(lattices):
    many = [f"the {i} of there thing and {i * 7} ☃" * (1 + i % 5) for i in range(200)]
    whole = piece_sampling.sample(lattices, many, np.arange(200), 2)
    for i in (0, 7, 199):
        alone = piece_sampling.sample(lattices, many[i : i + 1], np.arange(i, i + 1), 2)[0]
        assert [r[1:] for r in alone] == [r[1:] for r in whole[i]]


# -- tiling -----------------------------------------------------------------------------------------------------


def tile_brute(doc, item, n):
    """Greedy string tiling on tokens, by definition."""
    md, mi, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                m = 0
                while a + m < len(item) and b + m < len(doc) and item[a + m] == doc[b + m] and not mi[a + m] and not md[b + m]:
                    m += 1
                if m >= n and (-m, a, b) < (-best[0], best[1], best[2]):
                    best = (m, a, b)
        if not best[0]:
            return sum(mi), len(tiles), max(tiles, default=0)
        m, a, b = best
        tiles.append(m)
        mi[a : a + m] = [True] * m
        md[b : b + m] = [True] * m


def only_shared(doc, item, n):
    """The document's tokens under n-token runs that the item has too, each gap replaced by one token of its own: matches
    of n tokens and more are the same."""
    runs, keep = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}, set()
    for k in range(len(doc) - n + 1):
        if tuple(doc[k : k + n]) in runs:
            keep.update(range(k, k + n))
    out, last = [], -1
    for k in sorted(keep):
        out += [doc[k]] if k == last + 1 else [("gap", k), doc[k]]
        last = k
    return out


@pytest.mark.parametrize("seed", range(25))
def test_tiling(seed):
    r = random.Random(seed)
    doc, item = [r.choice("abc") for _ in range(40)], [r.choice("abc") for _ in range(14)]
    n = 3
    pairs = [(d, i) for d in range(len(doc) - n + 1) for i in range(len(item) - n + 1) if doc[d : d + n] == item[i : i + n]]
    got = decontaminate.tile(np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int), len(item), n)
    assert got == tile_brute(doc, item, n)


def test_phrases_that_both_repeat(spark):
    """A row for each diagonal, not for each pair of places."""
    docs = spark.createDataFrame([(1, "a b c d e " * 300), (2, "a b c d e " * 3)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e " * 20), (8, "one two"), (9, "e")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["covered"], r["tiles"]) for r in decontaminate.overlaps(docs, items).collect()}
    short = {(1, 9): (1, 1), (2, 9): (1, 1)}  # an item of fewer tokens than a seed counts wherever it stands
    assert got == short | {(1, 7): (100, 1), (2, 7): tile_brute(["a", "b", "c", "d", "e"] * 3, ["a", "b", "c", "d", "e"] * 20, 4)[:2]}


def test_reordered_passage_is_caught(spark):
    words = [f"t{i}" for i in range(40)]
    text = " ".join(["lead", *words[20:], "gap", *words[:20]])
    docs = spark.createDataFrame([(1, text.upper()), (2, " ".join(words[:10]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.overlaps(docs, items).collect()}
    assert got[1]["coverage"] == 1.0 and got[1]["tiles"] == 2 and got[2]["coverage"] == 0.25


# -- importance -------------------------------------------------------------------------------------------------


def importance_brute(docs, labels, fits):
    """The accepted and the sampled ids, one document at a time."""
    grams = {i: importance.ngrams(pa.array([t]))[0].reshape(-1) for i, t in docs.items()}
    good = {i for i in fits if labels[i] == 1}
    raw, goal = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if i in good:
            np.add.at(goal, g, 1)
    ratio = np.log(goal / goal.sum()) - np.log(raw / raw.sum())
    weight = {i: importance.SHARPNESS * ratio[g].sum() / max(1, len(g) // 4) for i, g in grams.items()}
    ids = np.array(list(docs))
    noise = dict(zip(docs, importance.gumbel(ids, np.ones(len(ids), bool), 17), strict=True))
    known = [i for i in labels if i in docs and i not in fits]
    cutoff = importance.best_cutoff(np.array([weight[i] for i in known]), np.array([labels[i] == 1 for i in known]))
    k = sum(w >= cutoff for w in weight.values())
    order = sorted(docs, key=lambda i: -(weight[i] + noise[i]))
    return set(order[:k]), set(order[: k // 2]), set(sorted(docs, key=lambda i: -weight[i])[: k // 2])


def test_importance(spark):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    fits = {r["doc_id"] for r in importance.fit_part(read(spark, SF, "labels")).where("in_fit").collect()}
    assert 0.3 < len(fits) / len(labels) < 0.7  # the rest sets the cutoff
    accepted, sampled, heaviest = importance_brute(texts(), dict(zip(labels["doc_id"].tolist(), labels["quality"].tolist(), strict=True)), fits)
    out = importance.classify(read(spark, SF, "documents"), read(spark, SF, "labels")).toPandas()
    assert set(out[out["accepted"]]["doc_id"]) == accepted
    assert set(out[out["sampled"]]["doc_id"]) == sampled
    assert len(sampled - heaviest) > len(sampled) / 10  # the draw decides, not the weights alone
    labelled = out.merge(labels, on="doc_id")
    assert (labelled["accepted"] == (labelled["quality"] == 1)).mean() > 0.97


def test_gumbel_keys_draw_in_proportion_to_weights():
    weight, ids = np.log([5.0, 3.0, 1.0, 1.0]), np.arange(4)
    first, pairs, n = Counter(), Counter(), 20_000
    for seed in range(n):
        order = np.argsort(-(weight + importance.gumbel(ids, np.ones(4, bool), seed * 1000)))
        first[int(order[0])] += 1
        pairs[int(order[0]), int(order[1])] += 1
    assert all(abs(first[i] / n - w) < 0.015 for i, w in enumerate((0.5, 0.3, 0.1, 0.1)))
    assert abs(pairs[0, 1] / n - 0.5 * 0.3 / 0.5) < 0.015 and abs(pairs[2, 0] / n - 0.1 * 0.5 / 0.9) < 0.015


def test_kth_largest(spark):
    v = [3, 3, -5, 2**62, -(2**63), 7, 7, 7]
    df = spark.createDataFrame([(x,) for x in v], "x long")
    assert [importance.kth_largest(df, "x", k) for k in range(0, 10)] == [None, *sorted(v, reverse=True), None]


# -- personal data, rules, ids ----------------------------------------------------------------------------------


def test_base_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(0)
    for _ in range(8000):
        t = "".join(r.choice("ab@@..-+12 90(") for _ in range(r.randrange(40)))
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in pii.IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in pii.CARD.finditer(t) if 13 <= len(re.findall("[0-9]", m[0])) <= 19 and pii.luhn("".join(re.findall("[0-9]", m[0])))]
        want += [("phone", *m.span()) for m in pii.PHONE.finditer(t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
        assert pii.base_spans(t) == want


def test_field_finds_what_patterns_miss():
    base = [f"word call +1 ({a}) 555-{b} thanks a lot" for a, b in zip(range(200, 260), range(1000, 1060), strict=True)]
    base += [f"card 40128888888818{i:02d} ok version 2.{i} of it" for i in range(81, 82)] * 10 + [f"see version {i}.0 there" for i in range(30)]
    w = pii.train(base)
    got = pii.field_spans("please call (302) 555-1768 today or version 3.0", w, [])
    assert got == [("phone", 12, 26)]


def test_best_segments_match_enumeration():
    r = random.Random(3)
    n = 5
    scored = {(i, j, k): r.uniform(-2, 2) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) for k in ("x", "y")}

    def every(i):
        return [[]] if i == n else [[(i, j, k), *rest] for (a, j, k) in scored if a == i for rest in every(j)]

    totals = {tuple(s): sum(scored[x] for x in s) for s in every(0)}
    assert tuple(pii.best_segments(n, scored)) == max(totals, key=totals.get)
    ahead, back = pii.log_sums(n, scored)
    assert abs(back[0] - math.log(sum(map(math.exp, totals.values())))) < 1e-9 and abs(ahead[n] - back[0]) < 1e-9


def test_quality_metrics(spark):
    got = {r["doc_id"]: r for r in quality_rules.metrics(read(spark, SF, "documents")).collect()}
    for i, t in texts().items():
        w = re.findall(f"[^{SPACE}]+", t or "")
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n, cover = Counter(grams), set()
        for k, g in enumerate(grams):
            if n[g] > 1:
                cover.update(range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if re.search(f"[^{SPACE}]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want


def test_allowed_errors(spark):
    cases = [(n, 0.01) for n in (0, 10, 300, 600, 1000, 20000)]
    df = spark.createDataFrame(cases, "n long, d double").withColumn("k", quality_rules.allowed_errors(F.col("n"), 0.02, F.col("d")))
    for r in df.collect():
        cdf, k = 0.0, -1
        for i in range(r["n"] + 1):
            cdf += math.exp(math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(0.02) + (r["n"] - i) * math.log(0.98))
            if cdf > r["d"]:
                break
            k = i
        assert r["k"] == k


def test_ids_are_the_library_s(spark):
    docs = texts()
    odd = ["it's DON'T we'LL x'S '' 'tis l'été ÀÉÎ ß ẞ", "<|endoftext|>a b<|startoftext|>", "\x85 a　b\x1c c\x00d İ ΣΑΣ é", "日本語 a_b--c 12345 ~`^|\\", "ª º µ × ÷ ¿qué? ½ ﬁ"]
    t = Tokenizer.from_file(WORD_BPE)
    every = [*(x or "" for x in docs.values()), *odd]
    flat, sizes = token_binary.Words(WORD_BPE).encode(pa.array(every))
    ends = np.cumsum(sizes)
    for i, e in enumerate(t.encode_batch(every, add_special_tokens=False)):
        assert flat[ends[i] - sizes[i] : ends[i]].tolist() == [*e.ids, 1]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 70000, 200001])
def test_coder(n):
    x = (np.random.default_rng(n).zipf(1.3, n) % 49000).astype(np.uint32)
    data = token_binary.encode(x)
    assert (token_binary.decode(data) == x).all()
    if n > 100000:
        steps = int.from_bytes(data[18:22], "little")
        part = token_binary.decode(data, slice(1, 3))  # blocks decode alone
        assert (part == x[steps * 64 : 3 * steps * 64]).all()
        bad = bytearray(data)
        bad[-9] ^= 4
        with pytest.raises(ValueError):
            token_binary.decode(bytes(bad))


# -- joins and the pipeline -------------------------------------------------------------------------------------


def shingle_sets(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in docs.items():
        w = re.findall(f"[^{SPACE}]+", (t or "").translate(low))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def components_brute(docs):
    s = shingle_sets(docs)
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        both = len(s[a] & s[b])
        if both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in docs}


def test_chains_of_near_copies(spark):
    """A group of near copies, each a little further from the first: links join them all, far ends are not alike."""
    base = [f"w{i}" for i in range(60)]
    docs = {j: " ".join([*(f"x{j}_{i}" for i in range(0)), *(f"y{i}" if i < j else base[i] for i in range(60))]) for j in range(0, 40)}
    docs |= {100 + j: " ".join(f"z{(i * 7 + j) % 50}" for i in range(60)) for j in range(12)}
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == components_brute(docs)


def test_dense_tiles_meet_in_bundles(spark, monkeypatch):
    """All tiles dense and blocks of a few rows: the same components."""
    r, docs = random.Random(9), {}
    words = [f"w{i}" for i in range(400)]
    for g in range(6):
        base = [r.choice(words) for _ in range(60)]
        for m in range(9):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                own[r.randrange(60)] = r.choice(words)
            docs[100 * g + m] = " ".join(own)
    docs |= {i: t for i, t in texts().items() if i % 3 == 0 and i not in docs}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 4)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.join(df).collect()}
    assert got == components_brute(docs)


def test_an_id_with_several_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, one), (5, two), (7, two), (9, one), (3, "other words here")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df).collect())
    assert got == [(3, 1, 3), (5, 26, 5), (5, 26, 5), (7, 26, 5), (9, 26, 5)]


def test_signatures_bound_overlaps():
    r = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sa, sb = (np.frombuffer(jaccard_join.bitmap(x), np.uint8) for x in (a, b))
        size = min(len(sa), len(sb))
        if jaccard_join.links(a, b):
            assert jaccard_join.may_link(len(a), len(b), jaccard_join.fold(sa, size), jaccard_join.fold(sb, size))


def test_filter_passes_what_it_has_seen(spark):
    from strandlake.llm.common import id_filter

    ids = np.array([0, -1, 5, 2**62, -(2**63)])
    words = id_filter(spark.createDataFrame([(int(i),) for i in ids] + [(None,)], "i long"), "i", 1 << 12)
    assert in_filter(words, ids).all() and not in_filter(words, np.arange(6, 4000)).any()


def test_window_paths():
    words = substring_dedup.Words(pa.array([" ".join(f"a{i}" for i in range(130)), "x y", "  ".join(f"a{i}" for i in range(30, 130))]))
    text, start, n, anchor = substring_dedup.text_paths(words)
    assert [int(n[text == t].sum()) for t in range(3)] == [81, 0, 51]
    x = words.at[:-1][text] + start
    for hashes in (words.roll.ranges(x, x + n + 49), words.digests(x, x + n + 49)):
        assert set(hashes[text == 2].tolist()) & set(hashes[text == 0].tolist())
    assert words.digests(np.array([0]), np.array([2]))[0] == int.from_bytes(hashlib.blake2b(b"a0 a1", digest_size=8).digest(), "little")


def test_unitigs(spark):
    """Chains are compacted, branches end them, cycles stay single."""
    chain = [(k, k % 7 + 1, 100 + k, 101 + k) for k in range(1, 40)]
    branch = [(50, 2, 140, 300), (51, 3, 140, 301), (52, 4, 300, 302), (53, 1, 400, 300)]  # 39 leads to two edges, 300 is entered twice
    cycle = [(60, 5, 500, 501), (61, 5, 501, 502), (62, 5, 502, 500)]
    got = {r["k"]: (r["u"], r["o"]) for r in substring_dedup.unitigs(spark.createDataFrame(chain + branch + cycle, "k long, n int, `from` long, `to` long")).collect()}
    at = 0
    for k, n, _, _ in chain:
        assert got[k] == (1, at)
        at += n
    assert all(got[k] == (k, 0) for k in (50, 51, 52, 53, 60, 61, 62))


def test_spans_have_their_source(spark):
    """Every span's words stand at its source coordinates in a smaller document."""
    docs = read(spark, SF, "documents")
    words = {i: re.findall(f"[^{SPACE}]+", t or "") for i, t in texts().items()}
    spans = substring_dedup.sourced_spans(docs).collect()
    assert len(spans) > 20
    for r in spans:
        assert r["fi"] < r["i"] and r["e"] - r["s"] >= substring_dedup.WINDOW
        assert words[r["i"]][r["s"] : r["e"]] == words[r["fi"]][r["fs"] : r["fs"] + r["e"] - r["s"]]


def test_pipeline(spark):
    docs = texts()
    stage = dict(corpus_pipeline.STAGES)
    names = read(spark, SF, "documents").columns
    one = stage["quality"](spark, read(spark, SF, "documents"), SF)
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    fits = {r["doc_id"] for r in importance.fit_part(read(spark, SF, "labels")).where("in_fit").collect()}
    drawn = importance_brute(docs, dict(zip(labels["doc_id"].tolist(), labels["quality"].tolist(), strict=True)), fits)[0]
    assert one.columns == names and {r["doc_id"] for r in one.select("doc_id").collect()} == drawn
    kept = {i: docs[i] or "" for i in drawn}
    holders = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in kept.items():
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)])
    cut = {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in kept.items()}
    cut = {i: t for i, t in cut.items() if t or not kept[i]}
    two = stage["line_dedup"](spark, one, SF)
    assert two.columns == names and {r["doc_id"]: r["text"] for r in two.collect()} == cut
    first = {i for i, c in components_brute(cut).items() if i == c}
    three = stage["near_copies"](spark, two, SF)
    assert {r["doc_id"] for r in three.collect()} == first
    bench = [t for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()]
    token = lambda t: [w for w in (re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", x.lower()) for x in t.split()) if w]
    four = stage["decontaminate"](spark, three, SF)
    left = {r["doc_id"] for r in four.collect()}
    items = [token(t) for t in bench]
    for i in first:
        d = token(cut[i])
        hit = any(tile_brute(only_shared(d, x, 4), x, 4)[0] >= len(x) / 2 for x in items if len(x) >= 4)
        assert (i not in left) == hit
    five = stage["encode"](spark, four, SF).toPandas()
    assert set(five["doc_id"]) == left and five["decoded_ok"].all()


def test_windows_of_a_passage_repeated_in_one_document(spark):
    rnd = random.Random(3)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    c, d = new(60), new(75)
    q = new(70) + c + new(70)
    docs = {1: c, 2: q + new(5) + q + q, 3: new(9) + d + q[40:190], 4: q + d + new(60) + q + d, -(2**63): d[:55] + new(3), 6: new(200)}
    first, want = {}, {}
    for i in sorted(docs):
        w, gone = docs[i], set()
        for s in range(len(w) - 49):
            if first.setdefault(tuple(w[s : s + 50]), i) < i:
                gone.update(range(s, s + 50))
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    got = substring_dedup.dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    assert want[2][1] == 180 and {r[0]: tuple(r[1:]) for r in got} == want


def test_field_takes_numbers_of_many_groups_and_long_stretches():
    whole = lambda t: pii.tokens_near(t)[0]
    for number in ("06 12 34 56 78", "33 6 12 34 56 78", "4012 8888 8888 1882 123", " ".join("4012888888881882123"), "(0) 6 - 12 - 34 - 56 - 78"):
        t = f'tel "{number}". now'
        tokens = whole(t)
        scored = pii.segments(t, tokens, {}, pii.KINDS)
        assert any(k == "phone" and pii.trim(t, tokens[i][0], tokens[j - 1][1]) == (5, 5 + len(number)) for i, j, k in scored)
    t = "x +33 6 12 34 56 78 or card 4 0 1 2 8 8 8 8 8 8 8 8 1 8 8 1 end"
    tokens = whole(t)
    assert [(t[tokens[i][0] : tokens[j - 1][1]], k) for i, j, k in pii.gold(t, tokens, pii.base_spans(t)) if k != pii.OUTSIDE] == [("+33 6 12 34 56 78", "phone"), ("4 0 1 2 8 8 8 8 8 8 8 8 1 8 8 1", "card")]
    # a run of numbers in which nothing else stands: without it there is nothing to learn from
    dense = " ".join(f"call +1 302 555 {i:04d} or {i}" for i in range(60))
    tokens = whole(dense)
    truth = pii.gold(dense, tokens, pii.base_spans(dense))
    cases = pii.cases_of(dense, tokens, truth)
    at = {x: i for i, x in enumerate(tokens)}
    again = [[(at[c[i]], at[c[j - 1]] + 1, k) for i, j, k in g] for _, c, g in cases]
    assert len(tokens) > 300 and max(len(c) for _, c, _ in cases) <= 40
    assert sorted(set().union(*again)) == truth and all(set(x) & set(y) for x, y in itertools.pairwise(again))
    w = pii.train([dense])
    assert w and [x[0] for x in pii.field_spans("please call 06 12 34 56 78 today", pii.train([f"please call +33 6 12 34 {i} 78 today and buy" for i in range(10, 60)]), [])] == ["phone"]


def test_url_words_all_count_and_names_stay_whole(spark):
    rnd = random.Random(1)
    new = lambda n: "".join(rnd.choice("bcdfghjk") for _ in range(n))
    many = [f"http://h{i}.org/{' '.join(f'a{i}x{j}' for j in range(500))}" for i in range(101)]  # over 50,000 words, each seen once or twice
    many = many + many
    rare, long = "zebrafarm", new(40)
    urls = [*many, f"http://casino-x.org/{rare}", f"http://q.org/{long}", f"http://{new(2100)}{rare}casino.org/", f"http://x{long}.org/{long}"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).where(F.col("page_id") >= len(many)).collect()}
    a, b, c, d = (got[len(many) + i] for i in range(4))
    assert a["words"] == f"casino x {rare}" and b["words"] == f"q {long}"
    assert c["words"].endswith(f" {rare} casino") and len(c["words"].replace(" ", "")) == 2100 + len(rare) + 6
    assert d["words"].split()[-1] == long and "".join(d["words"].split()) == f"x{long}{long}"
    # exact log odds of the rare word from the segments of all URLs
    count, bad = Counter(), Counter()
    for r in url_filter.judge(pages).select("words").collect():  # casino stands in hosts only
        count.update(r["words"].split())
        bad.update(r["words"].split() if "casino" in r["words"].split() else [])
    nb, ng = sum(bad.values()) + len(count) + 1, sum(count.values()) - sum(bad.values()) + len(count) + 1
    want = math.log(3 / (len(urls) - 1)) + sum(math.log((bad[x] + 1) / nb) - math.log((count[x] - bad[x] + 1) / ng) for x in ("casino", "x", rare))
    assert a["score"] == pytest.approx(want, abs=1e-6)


def viterbi_brute(name, cost, unknown):
    """The least cost over all splits of a name."""
    if not name:
        return 0.0
    price = lambda w: cost.get(w, unknown + 2.5 * len(w))
    return min(price(name[:i]) + viterbi_brute(name[i:], cost, unknown) for i in range(1, len(name) + 1))


def test_names_are_split_at_the_least_cost():
    r = random.Random(4)
    for _ in range(60):
        cost = {"".join(r.choice("ab") for _ in range(r.randrange(1, 5))): r.uniform(0.5, 9) for _ in range(8)}
        name = "".join(r.choice("ab") for _ in range(r.randrange(1, 11)))
        got = url_filter.split(name, cost, 9.0)
        assert "".join(got) == name
        assert sum(cost.get(w, 9.0 + 2.5 * len(w)) for w in got) == pytest.approx(viterbi_brute(name, cost, 9.0))


def test_url_model_agrees_on_hosts_it_has_not_seen(spark):
    r = random.Random(8)
    good, bad, seeds = ["garden", "library", "weather", "music", "travel"], ["jackpot", "bonus", "spins", "roulette"], ["casino", "poker"]
    rows = []
    for i in range(1200):
        if r.random() < 0.4:
            rows.append((1, f"http://{r.choice(seeds)}-{r.choice(bad)}{i}.org/{r.choice(bad)}/{r.choice(bad)}"))
        else:
            rows.append((0, f"http://{r.choice(good)}-{r.choice(good)}{i}.org/{r.choice(good)}/{r.choice(good)}"))
    # held out: no seed word, names run together
    for i in range(200):
        is_bad = i % 2
        own = bad if is_bad else good
        rows.append((2 + is_bad, f"http://{r.choice(own)}{r.choice(own)}.org/{r.choice(own)}"))
    df = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(rows)], "page_id long, url string")
    got = {x["page_id"]: x["verdict"] for x in url_filter.judge(df).collect()}
    right = [got[i] == ("block" if k in (1, 3) else "allow") for i, (k, _) in enumerate(rows)]
    held = [x for x, (k, _) in zip(right, rows, strict=True) if k >= 2]
    assert sum(held) / len(held) >= 0.95 and sum(right) / len(right) >= 0.95


def test_url_columns(spark):
    """The contract's columns of the query, by Python on every URL."""
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    urls = {r["page_id"]: r["url"] for r in read(spark, SF, "pages").select("page_id", "url").collect()}
    for r in entry.queries()["op5_url_filter"](spark, SF).collect():
        url = urls[r["page_id"]] or ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2], re.DOTALL) if "://" in url else None
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = max((x for x in rules if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])), key=lambda x: len(x[1] + x[2]), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, fit and fit[1] + fit[2])
        assert r["verdict"] == (fit[0] if fit else "block" if (r["score"] or 0) > 0 else "allow")


def test_cutoffs_by_brute_force(spark):
    """Enough labelled rows that the tests decide: cutoffs and verdicts as exact tail sums over all counts give them."""
    r = random.Random(6)
    rows, labels = [], []
    for i in range(9000):
        stratum, good = r.choice(["en", "en", "de", "fr"]), r.random() < 0.7
        worse = 0.0 if good else 0.35
        shares = [round(max(0.0, r.gauss(worse, 0.05 if good else 0.2)), 3) for _ in quality_rules.RULES]
        n = r.choice([15, 40, 300])
        rows.append((i, stratum, n, 5 * n, 0, 0, r.choice([0, 0, 0, n // 2]), *shares))
        if stratum != "fr" or r.random() < 0.05:  # fr has too few labels for any cutoff
            labels.append((i, int(good)))
    names = ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kinds = ", ".join(f"{x} {'string' if x == 'stratum' else 'long'}" for x in names) + "".join(f", {x} double" for x in quality_rules.RULES)
    measured = spark.createDataFrame(rows, kinds)
    alpha, delta = 0.05, 0.05
    known, by = dict(labels), {}
    for row in rows:
        if row[0] in known:
            by.setdefault(row[1], []).append(row)
    want = {}
    for stratum, own in by.items():
        good, bad = ([x for x in own if known[x[0]] == q] for q in (1, 0))
        rate, level = alpha / len(quality_rules.RULES), delta / (len(by) * len(quality_rules.RULES))
        tail = lambda k: sum(math.exp(math.lgamma(len(good) + 1) - math.lgamma(i + 1) - math.lgamma(len(good) - i + 1) + i * math.log(rate) + (len(good) - i) * math.log1p(-rate)) for i in range(k + 1))  # noqa: B023, E731
        for at, rule in enumerate(quality_rules.RULES, len(names)):
            fits = []
            for c in sorted(quality_rules.CUTOFFS, reverse=True):
                lost, caught = sum(x[at] > c for x in good), sum(x[at] > c for x in bad)
                if tail(lost) > level:
                    break
                if caught:
                    fits.append((caught / len(bad) - 5 * lost / len(good), c))
            if fits:
                want[stratum, rule] = max(fits)[1]
    cutoffs = quality_rules.fit_cutoffs(measured, spark.createDataFrame(labels, "doc_id long, quality int"), alpha, delta)
    assert {(x["stratum"], x["rule"]): x["cutoff"] for x in cutoffs.collect()} == want
    assert {"en", "de"} == {s for s, _ in want}
    kept = {x["doc_id"]: (x["base_failed"], x["kept"]) for x in quality_rules.judge(measured, cutoffs).collect()}
    for row in rows:
        failed = row[2] < 20 or 100 * row[6] > 30 * row[2]
        over = any(v > want[row[1], rule] for rule, v in zip(quality_rules.RULES, row[len(names) :], strict=True) if (row[1], rule) in want)
        assert kept[row[0]] == (failed, not failed and not over)
    assert any(not k and not f for f, k in kept.values())


def test_echoes_of_words_of_any_length(spark):
    for n in (1, 200, 201, 5000):
        df = spark.createDataFrame([(1, f"{'a' * n} {'a' * n} other words", "en")], "doc_id long, text string, lang string")
        assert quality_rules.metrics(df).first()["same_as_last_share"] == 0.25


def test_line_hashes_do_not_determine_each_other(spark):
    """A second hash that starts from the first one's result is the same for lines of one first hash."""
    df = spark.range(50).select(F.concat(F.lit("line number "), "id").alias("k"))
    got = df.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"), F.xxhash64("k", F.lit(7)).alias("chained")).collect()
    seeded = lambda seed, x: int.from_bytes((xxhash.xxh64_intdigest(x, seed & (2**64 - 1))).to_bytes(8, "big"), "big", signed=True)
    after = lambda h: seeded(h, (7).to_bytes(4, "little"))
    assert all(r["chained"] == after(r["h1"]) for r in got) and all(r["h2"] != after(r["h1"]) for r in got)


def test_field_recall_on_held_out_spans(spark):
    """Rewritten spans of documents that took no part in the fit are found, and texts as they are gain next to none."""
    docs = read(spark, "/root/testdata/sf0.1", "documents")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    field = pii.fit(docs.where(part != 0))
    held = [r["text"] for r in docs.where(part == 0).select("text").collect() if r["text"]]
    want, found, extra = Counter(), Counter(), 0
    for text, missed, base in pii.planted(held, 77):
        got = set(pii.field_spans(text, field.weights, base, field.least))
        want.update(k for k, _, _ in missed)
        found.update(x[0] for x in missed if x in got)
    for t in held:
        extra += len(pii.field_spans(t, field.weights, pii.base_spans(t), field.least))
    assert set(want) == set(pii.KINDS) and sum(found.values()) >= 0.9 * sum(want.values())
    assert extra <= 0.02 * len(held)


def test_tokens_of_any_length():
    long = "x" * 300 + "7"
    for t in (f"a b {long} c d e f", f"mail {'q' * 400}@example.org now", "1 " * 500):
        tokens = [x for s in pii.tokens_near(t) for x in s]
        every = [m.span() for m in re.finditer(r"\S+", t)]
        near = {i for j, (a, b) in enumerate(every) if pii.PLACE.search(t, a, b) for i in range(max(0, j - pii.AROUND), min(len(every), j + pii.AROUND + 1))}
        assert tokens == [every[i] for i in sorted(near)]


def test_pii_query(spark):
    for r in entry.queries()["op7_pii"](spark, SF).collect():
        base = pii.base_spans(texts()[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.digest(base).encode()).hexdigest()
        every = [x for x in r["spans"].split(",") if x]
        assert set(x for x in pii.digest(base).split(",") if x) <= set(every)


def test_token_query(spark):
    """The query's rows by the library, document by document."""
    library, start = Tokenizer.from_file(WORD_BPE), 0
    got = {r["doc_id"]: r for r in entry.queries()["op9_token_binary"](spark, SF).collect()}
    for i, t in sorted(texts().items()):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(texts())


def test_segments_check_their_documents():
    ids, lengths = np.array([3, token_binary.NO_ID, 9]), np.array([2, 1, 4])
    data = token_binary.pack(ids, ids != token_binary.NO_ID, lengths, np.arange(7, dtype=np.uint32))
    got = token_binary.unpack(data)
    assert all((a == b).all() for a, b in zip(got, (ids, ids != token_binary.NO_ID, lengths, np.arange(7)), strict=True))
    for at in (20, 30, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_binary.unpack(bytes(bad))
