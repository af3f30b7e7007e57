"""Ranked lexical search by bags: documents that no query can tell apart are scored once.

1. The query items come in blocks of at most ITEMS items with VOCABULARY terms together (a larger item is a block of its
   own). A block is what tasks know of the items: its terms with weights, and for each term the items that hold it.
2. Each document is read once for a block and leaves its bag: the number of its terms, and how often each term of the
   block occurs in it. Corpus figures (documents, terms, documents by term) are partial sums over all bags.
3. Bags with equal counts and an equal length figure m score alike. They are grouped by hash, and by the counts
   themselves, so a collision parts what differs; a group is one class with its least id.
4. Classes are scored where they are, for all items of the block; a task keeps its best classes by item. The best
   classes overall are few, as every class has a member: a document of a lower class has that many before it.
5. Only those classes meet their members again, in ascending id, as many as the report is long.

All figures but the weights are 64-bit integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import ascii_lower, discard, read, stored
from strandlake.llm.kernels import chunks

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Most items of a block, and most distinct terms of its items, added up.
ITEMS, VOCABULARY = 1024, 1 << 18
#: The scale of weights and of counts, and the length figure of an average document in percent.
SCALE, SHARE, NORM = 1000, 1_000_000_000, (100, 50)
_terms = re.compile(TERM.encode())  # on UTF-8, where all bytes of other characters are above 0x7F
#: Classes that are scored together.
TOGETHER = 2048


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int, limit: int) -> Iterator[dict]:
    """Blocks of items, each {item id: its distinct terms}. Rows that repeat an id are one item; null ids are one too."""
    term = F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(TERM), 0))
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), term.alias("term")).distinct()
    block, held = {}, 0
    for item, own in groupby(rows.orderBy("item").toLocalIterator(), key=lambda row: row["item"]):  # a partition at a time
        terms = {row["term"] for row in own}
        if block and (len(block) >= most or held + len(terms) > limit):
            yield block
            block, held = {}, 0
        block[item] = terms
        held += len(terms)
    if block:
        yield block


def bags(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document that has a term: all its terms with repeats, and of the given terms the
    numbers of those it holds in order, each with its occurrences."""
    number = {t.encode(): i for i, t in enumerate(terms)}
    kind = "doc_id long, n long, terms array<int>, tfs array<int>"

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "t"):
                ids, sizes, at, found, times = [], [], [0], [], []
                for i, text in zip(part["i"].to_pylist(), part["t"].cast(pa.large_binary()).to_pylist(), strict=True):
                    counts = Counter(_terms.findall(text.lower()))
                    if not counts:
                        continue
                    own = sorted((number[t], tf) for t, tf in counts.items() if t in number)
                    ids.append(i)
                    sizes.append(counts.total())
                    found += [x for x, _ in own]
                    times += [x for _, x in own]
                    at.append(len(found))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, kind)


class Postings:
    """What a task needs of a block: for each term its weight and the items that hold it."""

    def __init__(self, block: dict, weight: dict[str, int], terms: list[str]):
        by = {t: [] for t in terms}
        for k, own in enumerate(block.values()):
            for t in own:
                by[t].append(k)
        self.weight = np.array([weight.get(t, 0) for t in terms], np.int64)
        self.at = np.cumsum([0, *(len(by[t]) for t in terms)])
        self.items = np.array([k for t in terms for k in by[t]], np.int64)
        self.n_items = len(block)

    def scores(self, per: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """(bags x items) scores; bag b has the next per[b] of terms and tfs."""
        bag = np.repeat(np.arange(len(per)), per)
        tf = tfs.astype(np.int64)
        gain = self.weight[terms] * (SHARE * tf // (SCALE * tf + 20 * m[bag]))
        n = np.where(gain > 0, self.at[terms + 1] - self.at[terms], 0)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = np.zeros(len(per) * self.n_items, np.int64)
        np.add.at(out, np.repeat(bag, n) * self.n_items + self.items[np.repeat(self.at[terms], n) + step], np.repeat(gain, n))
        return out.reshape(len(per), self.n_items)


def best_classes(classes: DataFrame, postings: Postings, k: int) -> DataFrame:
    """(item, score, c, lo): of each item (by place in the block) the k best classes of a task, by score and least id."""
    kind = "item int, score long, c long, lo long"
    last = np.iinfo(np.int64).max

    def run(batches):
        held = {}  # item -> (score, lo, c), the best so far

        def merge(item, score, lo, c):
            old = held.get(item)
            if old is not None:
                score, lo, c = (np.concatenate(x) for x in zip(old, (score, lo, c), strict=True))
            keep = np.lexsort((lo, -score))[:k]
            held[item] = score[keep], lo[keep], c[keep]

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                terms, tfs = (part[x].flatten().to_numpy() for x in ("terms", "tfs"))
                per = np.diff(part["terms"].offsets.to_numpy())
                lo, c = part["lo"].fill_null(last).to_numpy(), part["c"].to_numpy()
                table = postings.scores(per, terms, tfs, part["m"].to_numpy())
                for item in range(postings.n_items):
                    score, old = table[:, item], held.get(item)
                    floor = old[0][-1] if old is not None and len(old[0]) == k else 1
                    hit = np.flatnonzero(score >= floor)
                    if len(hit):
                        merge(item, score[hit], lo[hit], c[hit])
        for item, (score, lo, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), item, np.int32)), pa.array(score), pa.array(c), pa.array(lo, mask=lo == last)], names=["item", "score", "c", "lo"])

    return classes.select("c", "lo", "m", "terms", "tfs").mapInArrow(run, kind)


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = ITEMS, block_terms: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents with the highest scores above 0, equal scores by
    ascending doc_id, null ids last.

    Items and documents without terms (null or empty texts) have no row. Rows of docs that repeat an id are documents of
    their own; rows of items that repeat an id are one item with all their terms. Columns beside the named ones are not
    read. Empty tables give no rows. Scores are exact whatever the tables' sizes."""
    spark = docs.sparkSession
    kind = "item_id long, rank int, doc_id long, score long"
    out, figures = [], None
    for block in item_blocks(items, item_id, item_text, block_items, block_terms):
        terms = sorted(set().union(*block.values()))
        bag = stored(bags(docs, terms, doc_id, doc_text))
        if figures is None:
            figures = bag.agg(F.count("*"), F.sum("n")).first()
        n_docs, n_terms = figures
        if not n_docs:
            break
        df = {terms[r["t"]]: r["df"] for r in bag.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # one row a term of the block
        postings = Postings(block, {t: math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}, terms)
        m = F.expr(f"{NORM[0] - NORM[1]} + ({NORM[1]} * n * {n_docs}L) div {n_terms}L")
        sized = bag.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs").withColumn("h", F.xxhash64("terms", "tfs", "m"))
        same = ["h", "m", "terms", "tfs"]
        classes = stored(sized.groupBy(*same).agg(F.min("doc_id").alias("lo")).withColumn("c", F.monotonically_increasing_id()))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("lo"))
        best = best_classes(classes, postings, k).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        best = stored(best.select("item", "score", "c"))
        wanted = classes.join(best.select("c").distinct(), "c", "left_semi").select("c", *same)  # at most k an item
        hashes = F.broadcast(wanted.select("h").distinct())  # k numbers for each of a block's items
        nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.asc_nulls_last("doc_id")))
        members = sized.join(hashes, "h", "left_semi").withColumn("nth", nth).where(F.col("nth") <= k)
        members = members.join(wanted, same).select("c", "doc_id")
        ranked = best.join(members, "c").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(block)], "item int, item_id long")
        out.append(stored(ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")))
        discard(bag, classes, best)
    found = spark.createDataFrame([], kind)
    for part in out:
        found = found.union(part)
    return found


def op11(spark, sf_dir):
    return search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
len as (select doc_id, count(*)::bigint as n from t group by 1),
corpus as (select count(*)::bigint as nd, sum(n)::bigint as nt from len),
tf as (select doc_id, term, count(*)::bigint as tf from t where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, corpus group by term),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // nt))))::bigint as score
  from q join tf using (term) join w using (term) join len using (doc_id), corpus group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 50
"""
