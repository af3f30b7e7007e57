"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased words without marks around them. Every run of MIN_MATCH tokens is a seed with a rolling
Karp-Rabin hash; seeds of documents are dropped at the scan unless a fixed-size filter over the benchmark's seeds
passes them, and the rest joins the benchmark's seeds. An item of fewer tokens is one seed as a whole; documents have
seeds of such a length too if the benchmark has items of it. Matches of a
document and an item are maximal runs of seeds on a diagonal, found by a window, so that a phrase that both repeat is a
row for each diagonal. Greedy string tiling then marks the longest match again and again, none overlapping another, and the share
of the item's tokens under tiles is its coverage: a reordered passage is covered in pieces.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import FILTER_BITS, drop_ids, id_filter, in_filter, read, stored
from strandlake.llm.kernels import LOW, Rolling, chunks, raw, window_starts, word_bounds, word_hashes

MIN_MATCH = 4
MIN_COVERAGE = 0.5

_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, where each text's tokens begin). Marks inside a word stay, marks around it go; a word of
    marks alone is no token."""
    data, offsets = raw(texts)
    data = LOW[data]
    starts, ends, at = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), at
    inner = np.flatnonzero(~_EDGE[data])
    a, b = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
    real = a < b
    first, last = inner[a[real]], inner[b[real] - 1] + 1
    return word_hashes(data, first, last), np.concatenate([[0], np.cumsum(real)])[at]


def seeds(texts: pa.Array, n: int = MIN_MATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, token position) of all n-token windows. A shorter text with tokens is one window."""
    words, at = tokens(texts)
    start, text = window_starts(at, n)
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < n))
    roll = Rolling(words)
    h = np.concatenate([roll.ranges(start, start + n), roll.ranges(at[short], at[short + 1])])
    return h.view(np.int64), np.concatenate([text, short]), np.concatenate([start - at[text], np.zeros(len(short), np.int64)])


def windows(texts: pa.Array, n: int, short: list[int] | tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, token position) of all windows of n tokens, and of the first of each kind in a text of those
    with a length in short: an item of so few tokens is covered by one."""
    words, at = tokens(texts)
    roll, found = Rolling(words), []
    for k in [n, *short]:
        start, text = window_starts(at, k)
        h = roll.ranges(start, start + k).view(np.int64)
        if k != n:
            order = np.lexsort((start, h, text))
            new = np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(text[order]) != 0)])[: len(order)]
            start, text, h = (x[order[new]] for x in (start, text, h))
        found.append((h, text, start - at[text]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def benchmark_seeds(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = MIN_MATCH) -> DataFrame:
    """item_id, item_pos, item_tokens, seed. Null ids and texts without tokens are left out."""

    def run(batches):
        for batch in batches:
            h, text, pos = seeds(batch["t"], n)
            size = np.diff(tokens(batch["t"])[1])
            yield pa.RecordBatch.from_arrays([batch["i"].take(pa.array(text)), pa.array(pos), pa.array(size[text]), pa.array(h)], names=["item_id", "item_pos", "item_tokens", "seed"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "item_id long, item_pos long, item_tokens long, seed long")


def document_seeds(docs: DataFrame, words: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = MIN_MATCH, short: list[int] | tuple = ()) -> DataFrame:
    """doc_id, doc_pos, seed of the windows of n tokens, and of the lengths in short, that the filter passes."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "t"):
                h, text, pos = windows(part["t"], n, short)
                some = np.flatnonzero(in_filter(words, h))
                yield pa.RecordBatch.from_arrays([part["i"].take(pa.array(text[some])), pa.array(pos[some]), pa.array(h[some])], names=["doc_id", "doc_pos", "seed"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, doc_pos long, seed long")


def tile(doc_pos: np.ndarray, item_pos: np.ndarray, item_tokens: int, n: int) -> tuple[int, int, int]:
    """tile_runs() of seed pairs (n tokens each)."""
    order = np.lexsort((doc_pos, doc_pos - item_pos))
    d, i = doc_pos[order], item_pos[order]
    if not len(d):
        return 0, 0, 0
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 1) | (np.diff(i) != 1)]))
    return tile_runs(d[begin], i[begin], np.diff(np.concatenate([begin, [len(d)]])), item_tokens, n)


def tile_runs(doc_pos: np.ndarray, item_pos: np.ndarray, length: np.ndarray, item_tokens: int, n: int) -> tuple[int, int, int]:
    """(tokens of the item under tiles, tiles, longest tile) by greedy string tiling over runs of seeds on diagonals.

    In each round the longest match of unmarked tokens is marked, ties to the least item then document position;
    what is left of a match that a tile cuts counts again while it has n tokens."""
    n = min(n, item_tokens)
    matches = [(-int(m) - n + 1, int(a), int(b)) for m, a, b in zip(length, item_pos, doc_pos, strict=True)]
    heapq.heapify(matches)
    item_marked, doc_marked, tiles, longest = np.zeros(item_tokens, bool), set(), 0, 0
    while matches:
        m, a, b = heapq.heappop(matches)
        m = -m
        free = ~item_marked[a : a + m]
        free &= np.fromiter((x not in doc_marked for x in range(b, b + m)), bool, m)
        if free.all():
            item_marked[a : a + m] = True
            doc_marked.update(range(b, b + m))
            tiles, longest = tiles + 1, max(longest, m)
            if item_marked.all():
                break
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if y - x >= n:
                heapq.heappush(matches, (-(y - x), a + x, b + x))
    return int(item_marked.sum()), tiles, longest


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = MIN_MATCH) -> DataFrame:
    """Per document and item that share a seed: doc_id, item_id, item_tokens, covered, tiles, longest, coverage.

    A document id that is repeated with one text counts once; with several texts, their seeds count together."""
    bench = stored(benchmark_seeds(items, item_col, item_text, n))
    words = id_filter(bench.select("seed"), "seed", FILTER_BITS)
    short = [r[0] for r in bench.where(F.col("item_tokens") < n).select("item_tokens").distinct().collect()]  # below n
    found = document_seeds(docs, words, id_col, text_col, n, short).join(bench, "seed")
    by = ["doc_id", "item_id", "item_tokens", "shift"]
    placed = found.select(*by[:3], (F.col("doc_pos") - F.col("item_pos")).alias("shift"), "doc_pos", "item_pos").dropDuplicates([*by, "doc_pos"])
    placed = placed.withColumn("run", F.col("doc_pos") - F.row_number().over(Window.partitionBy(*by).orderBy("doc_pos")))
    runs = placed.groupBy(*by, "run").agg(F.min("doc_pos").alias("doc_pos"), F.min("item_pos").alias("item_pos"), F.count("*").alias("n")).drop("run", "shift")

    def tiles(rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["item_tokens"].iloc[0])
        covered, count, longest = tile_runs(rows["doc_pos"].to_numpy(), rows["item_pos"].to_numpy(), rows["n"].to_numpy(), size, n)
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "item_id": [rows["item_id"].iloc[0]], "item_tokens": [size], "covered": [covered], "tiles": [count], "longest": [longest]})

    # a number of its own: the rows are few, but each group is work
    dealt = runs.repartition(docs.sparkSession.sparkContext.defaultParallelism * 2, "doc_id", "item_id")
    out = dealt.groupBy("doc_id", "item_id").applyInPandas(tiles, "doc_id long, item_id long, item_tokens long, covered long, tiles long, longest long")
    return out.withColumn("coverage", F.col("covered") / F.col("item_tokens"))


def contaminated(docs: DataFrame, items: DataFrame, least: float = MIN_COVERAGE, **names) -> DataFrame:
    """Per contaminated document: doc_id, item_id (of the highest coverage, least id among equals), coverage, tiles,
    items (how many items it covers enough)."""
    hits = overlaps(docs, items, **names).where(F.col("coverage") >= least)
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("i"), "tiles")).alias("b")
    return hits.groupBy("doc_id").agg(best, F.count("*").alias("items")).select("doc_id", (-F.col("b.i")).alias("item_id"), "b.coverage", "b.tiles", "items")


def decontaminate(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The rows of docs whose id is not contaminated, with all their columns. Null ids and null texts stay."""
    return drop_ids(docs, contaminated(docs, items, **names).select("doc_id"), names.get("id_col", "doc_id"))


def op3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = contaminated(docs, read(spark, sf_dir, "benchmark"))
    out = docs.select("doc_id").join(hits, "doc_id", "left")
    return out.select("doc_id", F.col("coverage").isNotNull().alias("contaminated"), "item_id", F.round("coverage", 6).alias("coverage"), "tiles", F.coalesce("items", F.lit(0)).cast("long").alias("items"))
