"""Spelling variants by finite-state composition.

1. Words are counted where texts are read; partial counts meet in one aggregate.
2. Two words at one edit agree on all before it and on all after it. With the shorter word's length halved, they share
   the first half (the edit is behind it) or what follows the second half's start. So each word enters partitions named
   by a fixed beginning and a fixed end: an initial state of the composition, reached by what both words share. A
   partition of over GROUP words is halved again by the same rule, until one symbol is left between the fixed parts,
   where the alphabet bounds it. Replacements lie in one partition; of an insertion the place behind the longest common
   beginning counts, so a pair is found once.
3. In a partition the middles of its words form a minimal acyclic acceptor. It is composed with the one-edit transducer
   and itself: before the edit both sides are in one state, an edit leads to two states, and from there only strings
   that both accept count. Composed states are computed once each, in the order in which the acceptor's states end.
4. Accepted pairs leave a task summed up by word (how many, and the one of largest count), never one by one.
5. Forms are followed to their last by pointer doubling in joins.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import LOWER, UPPER, discard, read, stored
from strandlake.llm.kernels import chunks

#: Most words of a partition that has more than one symbol between its fixed parts.
GROUP = 4096
#: Words a task counts before it passes its counts on.
HELD = 1 << 17
#: A word's form has at least this many times the word's own occurrences.
RATIO = 2
_run = re.compile("[A-Za-zÀ-ÿ]+")
_low = str.maketrans(UPPER, LOWER)


def typed(prefix: int, run: str, every: int) -> str:
    """A lower-cased run as it counts: where `every` divides the crc32 of id, colon and run, it has lost one code point.
    prefix is the crc32 of id and colon."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, n), stored: the words of at least `shortest` code points with at least `least` occurrences. Null texts have
    none; a null id counts as an empty one."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in chunks(batch, "t"):
                for i, text in zip(part["i"].to_pylist(), part["t"].to_pylist(), strict=True):
                    prefix = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for found, n in Counter(_run.findall(text)).items():
                        word = typed(prefix, found.lower() if found.isascii() else found.translate(_low), every)
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return stored(rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


class Acceptor:
    """The minimal acyclic automaton of sorted distinct strings. States are numbered with children first; the last is the
    initial one. arcs[q]: symbol -> (state, strings of q before the arc's); strings of a state are numbered in order."""

    def __init__(self, strings: list[str]):
        self.arcs: list[dict] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self._known: dict = {}
        path, labels, last = [[[], False]], [], ""
        for s in strings:
            same, most = 0, min(len(last), len(s))
            while same < most and last[same] == s[same]:
                same += 1
            self._close(path, labels, same)
            for c in s[same:]:
                labels.append(c)
                path.append([[], False])
            path[-1][1] = True
            last = s
        self._close(path, labels, 0)
        self.initial = self._state(*path[0])

    def _close(self, path, labels, depth):
        while len(path) > depth + 1:
            state = self._state(*path.pop())
            path[-1][0].append((labels.pop(), state))

    def _state(self, arcs, final):
        key = (final, *arcs)
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            n, own = int(final), {}
            for c, to in arcs:
                own[c] = (to, n)
                n += self.count[to]
            self.arcs.append(own)
            self.final.append(final)
            self.count.append(n)
        return state


def one_edit_pairs(a: Acceptor, to_the_end: bool = True) -> list[tuple[int, int]]:
    """(i, j): numbers of the acceptor's strings that are one edit apart, each pair once; of an insertion i is the
    shorter. Insertions at the very end count only if asked."""
    both: dict = {}

    def common(x: int, y: int) -> list:
        """Numbers of the strings that states x and y both accept."""
        todo = [(x, y)]
        while todo:
            p = todo[-1]
            if p in both:
                todo.pop()
                continue
            u, v = p
            if u == v:
                both[p] = [(k, k) for k in range(a.count[u])]
                continue
            au, av = a.arcs[u], a.arcs[v]
            met = [(au[c], av[c]) for c in au if c in av]
            if open_ := [(s[0], t[0]) for s, t in met if (s[0], t[0]) not in both]:
                todo += open_
                continue
            out = [(0, 0)] if a.final[u] and a.final[v] else []
            for (s, i), (t, j) in met:
                out += [(i + k, j + m) for k, m in both[s, t]]
            both[p] = out
        return both[x, y]

    behind: list[list] = []  # per state the pairs whose edit is in it or behind it
    for q, arcs in enumerate(a.arcs):
        out = []
        own = list(arcs.items())
        for k, (b, (s, i)) in enumerate(own):
            out += [(i + x, i + y) for x, y in behind[s]]
            for _, (t, j) in own[k + 1 :]:  # b replaced
                out += [(i + x, j + y) for x, y in common(s, t)]
            next_ = a.arcs[s]  # b inserted before something else, or before nothing
            if to_the_end and a.final[q] and a.final[s]:
                out.append((0, i))
            for c, (t, j) in own:
                if c != b and c in next_:
                    u, m = next_[c]
                    out += [(j + x, i + m + y) for x, y in common(t, u)]
        behind.append(out)
    return behind[a.initial]


def halved(rows: DataFrame) -> DataFrame:
    """Partitions split in two: rows (word, n, l, lo, hi) with lo fixed symbols in front and hi at the end, l being the
    length of a pair's shorter word."""
    rest = F.col("l") - F.col("lo") - F.col("hi")
    half = F.floor(rest / 2).cast("int")
    front = F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"))
    back = F.struct(F.col("lo").alias("lo"), (F.col("hi") + rest - half).alias("hi"))
    return rows.select("word", "n", "l", F.explode(F.array(front, back)).alias("p")).select("word", "n", "l", "p.lo", "p.hi")


def keyed(rows: DataFrame) -> DataFrame:
    front, back = F.expr("substring(word, 1, lo)"), F.expr("substring(word, char_length(word) - hi + 1, hi)")
    return rows.withColumn("h", F.xxhash64("l", "lo", "hi", front, back))


def partitions(words: DataFrame, group: int = GROUP) -> list[DataFrame]:
    """Tables of rows (h, word, n, l, lo, hi) of words (word, n): in each, the rows of one h are a partition (or, should
    hashes collide, several). The tables past the first, if any, hold the halves of partitions that were too large."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("l")).where("l > 0").withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    out = []
    rows = keyed(halved(rows))
    while True:
        large = stored(rows.where("l - lo - hi > 1").groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > group).select("h"))
        if large.isEmpty():
            discard(large)
            return [*out, rows]
        out.append(rows.join(large, "h", "left_anti"))
        rows = stored(keyed(halved(rows.join(large, "h", "left_semi").drop("h"))))


def _pairs_of(words: list[str], l: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs (places in words) of one partition."""
    middle = [w[lo : len(w) - hi] for w in words]
    order = sorted(range(len(words)), key=middle.__getitem__)
    for i, j in one_edit_pairs(Acceptor([middle[k] for k in order]), not hi):
        i, j = order[i], order[j]
        if len(words[i]) == l:  # two longer words are a pair of the partitions of their own length
            yield i, j


def _groups(batches) -> Iterator[tuple[list[str], list[int], tuple[int, int, int]]]:
    """(words, counts, (l, lo, hi)) of the partitions of more than one word, from batches in the order of h."""

    def exact(rows):
        parts = defaultdict(list)
        for word, n, *at in rows:
            l, lo, hi = at
            parts[l, lo, hi, word[:lo], word[len(word) - hi :]].append((word, n))
        for key, own in parts.items():
            if len(own) > 1 and min(len(w) for w, _ in own) == key[0]:
                yield [w for w, _ in own], [n for _, n in own], key[:3]

    held, last = [], None
    for batch in batches:
        h = batch["h"].to_numpy()
        if not len(h):
            continue
        rows = list(zip(*(batch[c].to_pylist() for c in ("word", "n", "l", "lo", "hi")), strict=True))
        ends = [*np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)]
        at = 0
        for end in ends:
            if last != h[at]:
                if len(held) > 1:
                    yield from exact(held)
                held, last = [], h[at]
            held += rows[at:end]
            at = end
    if len(held) > 1:
        yield from exact(held)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("h")).sortWithinPartitions("h").select("h", "word", "n", "l", "lo", "hi")


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, near): all ordered pairs of distinct words (word, n) that are one edit apart."""

    def run(batches):
        for own, _, at in _groups(batches):
            pairs = list(_pairs_of(own, *at))
            if pairs:
                a, b = [own[i] for i, _ in pairs], [own[j] for _, j in pairs]
                yield pa.RecordBatch.from_arrays([pa.array(a + b), pa.array(b + a)], names=["word", "near"])

    tables = [_in_order(t).mapInArrow(run, "word string, near string") for t in partitions(words, group)]
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def near_counts(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, best_n, best): of words (word, n) that have near ones, how many, and of these the one of largest n
    (ties: the least by code point). Pairs are summed up in the task that finds them."""

    def run(batches):
        rows = ([], [], [], [])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(x, pa.int64()) for x in rows[1:3]), pa.array(rows[3], pa.string())], names=["word", "k", "top", "best"])

        for own, n, at in _groups(batches):
            met = {}
            for i, j in _pairs_of(own, *at):
                for x, y in ((i, j), (j, i)):
                    k, best = met.get(x, (0, (0, "")))
                    mine = (-n[y], own[y])
                    met[x] = (k + 1, mine if not k or mine < best else best)
            for x, (k, best) in met.items():
                for column, value in zip(rows, (own[x], k, *best), strict=True):
                    column.append(value)
            if len(rows[0]) > HELD:
                yield out()
                rows = ([], [], [], [])
        yield out()

    tables = [_in_order(t).mapInArrow(run, "word string, k long, top long, best string") for t in partitions(words, group)]
    found = tables[0]
    for t in tables[1:]:
        found = found.union(t)
    best = F.min(F.struct("top", "best")).alias("b")
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best).select("word", "n_near", (-F.col("b.top")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root), stored, of forms (word, form) without nulls and cycles: the last form that follows from a word's."""
    state = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("at"), F.col("root").alias("to"))
        step = stored(state.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")))
        discard(state)
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        state = step


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, shortest: int = 5, least: int = 3, every: int = 97, group: int = GROUP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of docs (see vocabulary): its near words, the one of largest n
    among them if that n is at least ratio times the word's own, and where forms lead.

    Null and empty texts and empty tables add no words. Rows that repeat an id are counted each. Words of any length
    count; other columns are not read. ratio has to be above 1, so that forms have no cycles (else ValueError)."""
    if ratio <= 1:
        raise ValueError("ratio has to be above 1")
    words = vocabulary(docs, id_col, text_col, shortest, least, every)
    near = stored(words.join(near_counts(words, group), "word", "left"))
    ok = F.col("best_n") >= ratio * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("best")).alias("form"), F.when(ok, F.col("best_n")).alias("form_n"))
    last = roots(near.where("form is not null"))
    return near.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12(spark, sf_dir):
    return group_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


#: crc32 by its table, which follows from the polynomial.
ORACLE = r"""
with recursive r as (select unnest(range(0, 256))::bigint as i, unnest(range(0, 256))::bigint as c, 0 as k union all
  select i, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k + 1 from r where k < 8),
tab as (select list(c order by i) as tab from r where k = 8),
x as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
y as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from x group by all),
z as (select run, n, xor(4294967295, list_reduce(list_transform(string_split(trim(regexp_replace(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '(..)', '\1 ', 'g')), ' '), lambda b: ('0x' || b)::bigint),
  lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295::bigint)) as h from y, tab),
w as (select word, sum(n)::bigint as n from (select case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from z) where length(word) >= 5 group by word having sum(n) >= 3),
d as (select word, n, i, word[:i - 1] || word[i + 1:] as cut from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
p as (select distinct a.word, b.word as near, b.n as near_n from d a join d b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select d.word, w.word, w.n from d join w on w.word = d.cut union select w.word, d.word, d.n from d join w on w.word = d.cut),
b as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as form, max(near_n) as form_n from p group by word),
f as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 2 * w.n then form end as form, case when form_n >= 2 * w.n then form_n end as form_n from w left join b using (word)),
t as (select word, word as at, form as next from f union all select t.word, f.word, f.form from t join f on f.word = t.next)
select f.*, t.at as root from f join t on t.word = f.word and t.next is null
"""
