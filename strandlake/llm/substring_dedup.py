"""Substring dedup by a compacted de Bruijn graph over token k-mers.

Nodes are (k - 1)-word runs and edges the k-word windows (k = 50) of all documents. Sending every window through a
shuffle would move the corpus many times over, so edges are made in bundles where they are read:

1. A window's anchor is the least hash of the 16-word k-mers in it. Equal windows have equal anchors. Along a document,
   consecutive windows with one anchor form a path, one edge from the node before it to the node after it (its first
   and last 49 words). Its key is its anchor, a rolling hash of its words and a digest of its bytes: equal keys have
   equal words by two hashes of which one does not build on the other. Edges of a single document are dropped by partial
   aggregates on the anchor.
2. Edges that several documents hold are the repeated part of the graph. In- and out-degrees come from aggregates; where
   a node has one edge in and one out, a join makes the second edge follow the first. Pointer doubling over these joins
   compacts nonbranching paths to unitigs, each edge with its offset in words. Edges on a cycle stay single.
3. Documents walk through unitigs: each occurrence of an edge is a place (unitig, offset). A place has one source, the
   smallest document that walks through it; other documents are covered there. Neighbouring places of a unitig with the
   same source are one span, with its source coordinates.
4. Anchors with more than one key are where paths branch: windows of different edges may still be equal. Only there the
   first occurrence of each edge is opened into single windows, which join on their own hash and digest. What is found
   in it holds as well for later occurrences of the edge in the same document, moved by their distance.
5. Source coordinates verify the spans: the words of each span and those at its source are read once more and compared
   by a digest of their bytes. The words under verified spans go.

Texts are told apart by id and a hash of the text, so rows that share an id may differ; they are one document then.

A window is removed from a document exactly if its word sequence also starts in a document with a smaller id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import discard, id_filter, in_filter, read, stored
from strandlake.llm.kernels import Rolling, chunks, long_array, raw, sliding_min, window_starts, word_bounds, word_hashes

WINDOW = 50
ANCHOR = 16


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.select("i", F.xxhash64("t").alias("r"), "t")


class Words:
    """The words of a string array: their hashes, where each text's begin, and their bytes with one space between."""

    def __init__(self, texts: pa.Array):
        data, offsets = raw(texts)
        starts, ends, self.at = word_bounds(data, offsets)
        self.hashes = word_hashes(data, starts, ends)
        self.roll = Rolling(self.hashes)
        flat = data.tobytes()
        self.bytes = b" ".join([flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        self.ends = np.cumsum(ends - starts + 1) - 1
        self.starts = self.ends - (ends - starts)

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits of a digest of the bytes of each word range (not empty)."""
        held = memoryview(self.bytes)
        cut = zip(self.starts[start].tolist(), self.ends[end - 1].tolist(), strict=True)
        return np.frombuffer(b"".join(hashlib.blake2b(held[a:b], digest_size=8).digest() for a, b in cut), np.uint64)


def text_paths(words: Words, window: int = WINDOW, anchor: int = ANCHOR):
    """(text, start, windows, anchor) of the paths of all texts: maximal runs of windows with one anchor."""
    start, text = window_starts(words.at, window)
    empty = np.zeros(0, np.int64)
    if not len(start):
        return empty, empty, empty, empty.view(np.uint64)
    k = np.arange(len(words.hashes) - anchor + 1)
    least = sliding_min(words.roll.ranges(k, k + anchor), window - anchor + 1)[start]
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.concatenate([first, [len(start)]]))
    return text[first], start[first] - words.at[:-1][text[first]], n, least[first]


PATHS = ["i long", "r long", "s int", "n int", "a long", "k long", "v long", "from long", "to long"]


def paths(rows: DataFrame) -> DataFrame:
    """(i, r, s, n, a, k, v, from, to): document, its text, first window, number of windows, anchor, hash and digest of the
    words, nodes."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "t"):
                words = Words(part["t"])
                text, s, n, a = text_paths(words)
                x = words.at[:-1][text] + s
                end = x + n + WINDOW - 1
                long = [words.roll.ranges(x, end), words.digests(x, end), words.roll.ranges(x, x + WINDOW - 1), words.roll.ranges(x + n, end)]
                yield pa.RecordBatch.from_arrays([*(part[c].take(pa.array(text)) for c in "ir"), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), long_array(a), *map(long_array, long)], names=[c.split()[0] for c in PATHS])

    return rows.mapInArrow(run, ", ".join(f"`{c.split()[0]}` {c.split()[1]}" for c in PATHS))


def unitigs(edges: DataFrame) -> DataFrame:
    """(k, u, o): each edge's unitig (the key of its first edge) and its offset there in words. edges has k, n (windows),
    from and to, one row each."""
    e = stored(edges)
    once = lambda node: e.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("c")).where("c = 1").select("node")
    plain = stored(once("from").join(once("to"), "node"))
    before = e.select(F.col("to").alias("node"), F.col("k").alias("p"), F.col("n").alias("o")).join(plain, "node")
    after = e.select(F.col("from").alias("node"), "k").join(plain, "node")
    follows = after.join(before, "node").where("k <> p").select("k", "p", F.col("o").cast("long"))
    state = e.select("k").join(follows, "k", "left")
    state = stored(state.select("k", F.coalesce("p", "k").alias("u"), F.coalesce("o", F.lit(0)).cast("long").alias("o"), F.col("p").isNull().alias("done")))
    left, rounds = state.where("not done").count(), 0

    def jumped(some: DataFrame) -> DataFrame:
        ahead = some.select(F.col("k").alias("u"), F.col("u").alias("p"), F.col("o").alias("d"), F.col("done").alias("over"))
        further = some.where("not done").join(ahead, "u").select("k", F.col("p").alias("u"), (F.col("o") + F.col("d")).alias("o"), F.col("over").alias("done"))
        return some.where("done").union(further)

    # after r jumps an edge knows the one 2**r before it; edges of a cycle never reach a first one
    while left:
        state = stored(jumped(jumped(state)))
        still, rounds = state.where("not done").count(), rounds + 2
        if still == left and 2**rounds > 2 * left:
            break
        left = still
    alone = ~F.col("done")
    out = stored(state.select("k", F.when(alone, F.col("k")).otherwise(F.col("u")).alias("u"), F.when(alone, 0).otherwise(F.col("o")).cast("long").alias("o")))
    discard(e, plain)
    return out


def _near(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts (i, r, t), each once, of documents with an id in ids (column i); a filter may let a few more through."""
    words = id_filter(ids, "i")

    def near(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_filter(words, batch["i"].to_numpy())))

    return rows.mapInArrow(near, "i long, r long, t string").groupBy("i", "r").agg(F.first("t").alias("t"))


def _flat(column: pa.Array, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many structs each row's list has, and their fields."""
    flat = column.flatten()
    return np.diff(column.offsets.to_numpy()), [flat.field(x).to_numpy() for x in range(fields)]


def open_windows(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Windows (i, r, s, f, a, h, v) of the paths in spans (i, r, s, n, a), f being a path's s; the documents are dropped
    at the scan by a filter unless they have such a path."""
    per_doc = spans.groupBy("i", "r").agg(F.collect_list(F.struct("s", "n", "a")).alias("p"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "t"):
                own = Words(part["t"])
                per, (s, n, a) = _flat(part["p"], 3)
                base = np.repeat(own.at[:-1], per)
                at_doc = np.repeat(np.arange(len(per)), per)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = np.repeat(s, n) + step
                begin = np.repeat(base, n) + pos
                hashes = [own.roll.ranges(begin, begin + WINDOW), own.digests(begin, begin + WINDOW)]
                at = pa.array(np.repeat(at_doc, n))
                yield pa.RecordBatch.from_arrays([part["i"].take(at), part["r"].take(at), pa.array(pos.astype(np.int32)), pa.array(np.repeat(s, n)), pa.array(np.repeat(a, n)), *map(long_array, hashes)], names=["i", "r", "s", "f", "a", "h", "v"])

    joined = _near(rows, spans).join(per_doc.hint("shuffle_hash"), ["i", "r"])
    return joined.select("i", "r", "t", "p").mapInArrow(run, "i long, r long, s int, f int, a long, h long, v long")


def runs(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (i, r, s, e, fi, fr, fs) of hits (i, r, s, n, fi, fr, fs and keys): windows s to s + n in text (i, r), of the
    words at fs in text (fi, fr). Hits of one key that follow each other without a gap are one span."""
    keys = ["i", "r", "fi", "fr", "shift", *keys]
    before = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = hits.withColumn("shift", F.col("s") - F.col("fs")).dropDuplicates([*keys, "s"])
    placed = placed.withColumn("run", F.col("s") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    merged = placed.groupBy(*keys, "run").agg(F.min("s").alias("s"), F.sum("n").alias("n"), F.min("fs").alias("fs"))
    return merged.select("i", "r", "s", (F.col("s") + F.col("n") + WINDOW - 1).cast("int").alias("e"), "fi", "fr", "fs")


def range_digests(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """(i, r, s, e, d): a digest of the words [s, e) of each range (i, r, s, e); null where a text has fewer words."""
    per_doc = ranges.groupBy("i", "r").agg(F.collect_set(F.struct("s", "e")).alias("p"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "t"):
                own = Words(part["t"])
                per, (s, e) = _flat(part["p"], 2)
                base, top = np.repeat(own.at[:-1], per), np.repeat(own.at[1:], per)
                fits = (base + e <= top) & (s < e)
                d = np.zeros(len(s), np.int64)
                d[fits] = own.digests((base + s)[fits], (base + e)[fits]).view(np.int64)
                at = pa.array(np.repeat(np.arange(len(per)), per))
                yield pa.RecordBatch.from_arrays([part["i"].take(at), part["r"].take(at), pa.array(s), pa.array(e), pa.array(d, mask=~fits)], names=["i", "r", "s", "e", "d"])

    joined = _near(rows, ranges).join(per_doc.hint("shuffle_hash"), ["i", "r"])
    return joined.select("i", "r", "t", "p").mapInArrow(run, "i long, r long, s int, e int, d long")


def verified(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans whose words are those at their source."""
    ends = F.col("fs") + F.col("e") - F.col("s")
    there = spans.select(F.col("fi").alias("i"), F.col("fr").alias("r"), F.col("fs").alias("s"), ends.cast("int").alias("e"))
    read = stored(range_digests(rows, stored(spans.select("i", "r", "s", "e").union(there).distinct())))
    source = read.select(F.col("i").alias("fi"), F.col("r").alias("fr"), F.col("s").alias("fs"), F.col("e").alias("fe"), F.col("d").alias("fd"))
    out = spans.withColumn("fe", ends.cast("int")).join(read, ["i", "r", "s", "e"]).join(source, ["fi", "fr", "fs", "fe"])
    return out.where("d = fd").select("i", "r", "s", "e", "fi", "fr", "fs")


def sourced_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, r, s, e, fi, fr, fs): word ranges [s, e) of texts to remove, each with the place fs in the text (fi, fr) of a
    smaller document that has the same words. Ranges of one text may overlap. A text is a document's id and a hash."""
    rows = _rows(docs, id_col, text_col)
    found = paths(rows)
    anchors = found.groupBy("a").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.min("k").alias("k0"), F.max("k").alias("k1"))
    shared = stored(anchors.where("lo <> hi").select("a", (F.col("k0") != F.col("k1")).alias("branch")))
    near = stored(found.join(shared, "a"))
    key = ["a", "k", "v"]
    first = near.groupBy(*key).agg(
        F.min(F.struct("i", "r", "s")).alias("f"), F.max(F.struct(F.bitwise_not("i"), "r", "s")).alias("l"), F.max("i").alias("last"), *[F.first(c).alias(c) for c in ("n", "branch", "from", "to")]
    )
    again = (F.col("f.r") != F.col("l.r")) | (F.col("f.s") != F.col("l.s"))  # occurs again in its first document
    first = stored(first.select(*key, F.col("f.i").alias("fi"), F.col("f.r").alias("fr"), F.col("f.s").alias("fs"), again.alias("again"), "last", "n", "branch", "from", "to"))
    edges = first.where("fi <> last")
    # one row for each k: keys of one rolling hash and several digests, should there be any, stay single
    compact = unitigs(edges.groupBy("k").agg(*[F.first(c).alias(c) for c in ("n", "from", "to")], F.count("*").alias("c")).where("c = 1").drop("c"))
    placed = edges.join(compact, "k", "left").select(*key, F.coalesce("u", F.xxhash64("k", "v")).alias("u"), F.coalesce("o", F.lit(0)).cast("long").alias("o"))
    walks = stored(near.join(placed, key).select("i", "r", "s", "n", "u", "o"))
    # stored, so that the join stands alone and Spark can split a place that many documents walk through
    source = walks.groupBy("u", "o").agg(F.min(F.struct("i", "r", "s")).alias("f")).select("u", "o", F.col("f.i").alias("fi"), F.col("f.r").alias("fr"), F.col("f.s").alias("fs"))
    source = stored(source)
    whole = runs(walks.join(source, ["u", "o"]).where("i > fi").select("i", "r", "s", "n", "fi", "fr", "fs", "u"), ["u"])
    windows = stored(open_windows(rows, first.where("branch").select(F.col("fi").alias("i"), F.col("fr").alias("r"), F.col("fs").alias("s"), "n", "a")))
    earliest = windows.groupBy("a", "h", "v").agg(F.min(F.struct("i", "r", "s")).alias("w"), F.max("i").alias("last"))
    earliest = stored(earliest.where("w.i <> last").select("a", "h", "v", F.col("w.i").alias("fi"), F.col("w.r").alias("fr"), F.col("w.s").alias("fs")))
    part = stored(windows.join(earliest, ["a", "h", "v"]).where("i > fi").select("i", "r", "s", "f", "a", "fi", "fr", "fs"))
    more = near.join(first.where("branch and again").select(*key, "fi", F.col("fr").alias("r0"), F.col("fs").alias("f")), key).where("i = fi and (r <> r0 or s <> f)")
    more = more.select("i", "r0", F.col("r").alias("to"), "a", "f", (F.col("s") - F.col("f")).alias("d"))
    moved = part.withColumnRenamed("r", "r0").join(more, ["i", "r0", "a", "f"]).select("i", F.col("to").alias("r"), (F.col("s") + F.col("d")).alias("s"), "fi", "fr", "fs")
    single = runs(part.select("i", "r", "s", "fi", "fr", "fs").union(moved).withColumn("n", F.lit(1)), [])
    spans = stored(whole.union(single))
    out = stored(verified(rows, spans))
    discard(shared, near, first, compact, walks, source, windows, earliest, part, spans)
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, r, spans): per text with repeated windows the word ranges [s, e) to remove, unmerged."""
    return sourced_spans(docs, id_col, text_col).groupBy("i", "r").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def kept_words(data: np.ndarray, offsets: np.ndarray, spans: list) -> list[tuple[int, int, bytes]]:
    """Per text (words, removed words, kept words joined by one space)."""
    starts, ends, at = word_bounds(data, offsets)
    out = []
    flat = data.tobytes()
    for j, cover in enumerate(spans):
        a, b = int(at[j]), int(at[j + 1])
        if not cover:
            out.append((b - a, 0, b" ".join(flat[offsets[j] : offsets[j + 1]].split())))
            continue
        steps = np.zeros(b - a + 1, np.int64)
        np.add.at(steps, [x["s"] for x in cover], 1)
        np.add.at(steps, [x["e"] for x in cover], -1)
        keep = np.flatnonzero(np.cumsum(steps[:-1]) == 0) + a
        out.append((b - a, b - a - len(keep), b" ".join(flat[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (words that stay, joined by one space). Null texts have no words;
    rows with a null id lose nothing; rows that share an id are one document, each with its own text; documents without
    repeated windows do not pass the join."""
    spans = stored(repeated_spans(docs, id_col, text_col))
    words = id_filter(spans, "i")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).select("i", F.xxhash64("t").alias("r"), "t")
    kind = "doc_id long, n_words long, n_removed long, kept string"

    def emit(part, cover):
        got = kept_words(*raw(part["t"]), cover)
        return pa.RecordBatch.from_arrays([part["i"], pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2].decode() for x in got], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    def hit(batch):
        return in_filter(words, batch["i"].fill_null(0).to_numpy()) & batch["i"].is_valid().to_numpy(zero_copy_only=False)

    def untouched(batches):
        for batch in batches:
            for part in chunks(batch.filter(pa.array(~hit(batch))), "t"):
                yield emit(part, [None] * part.num_rows)

    def maybe(batches):
        for batch in batches:
            yield batch.filter(pa.array(hit(batch)))

    def cut(batches):
        for batch in batches:
            for part in chunks(batch, "t"):
                yield emit(part, part["spans"].to_pylist())

    joined = rows.mapInArrow(maybe, "i long, r long, t string").join(spans.hint("shuffle_hash"), ["i", "r"], "left").select("i", "t", "spans")
    return rows.mapInArrow(untouched, kind).union(joined.mapInArrow(cut, kind))


def op8(spark, sf_dir):
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
g as (select doc_id, i as s, md5(array_to_string(words[i:i+49], ' ')) as h from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w)),
f as (select h, min(doc_id) as first from g group by h having min(doc_id) <> max(doc_id)),
c as (select distinct doc_id, unnest(range(s, s + 50)) as i from g join f using (h) where doc_id > first),
k as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w)
select w.doc_id, any_value(len(words)) as n_words, count(c.i) as n_removed,
  sha256(coalesce(string_agg(k.word, ' ' order by k.i) filter (where c.i is null), '')) as kept_sha256
from w left join k using (doc_id) left join c on c.doc_id = k.doc_id and c.i = k.i group by w.doc_id
"""
