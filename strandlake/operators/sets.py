"""Set operations, duplicates, containment and overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import PIECE, canonical, expected_errors, hamming, parse_header, pieces, revcomp, words
from strandlake.operators.filters import first_of_group
from strandlake.sources.shared import stored

VARIANT = ["chrom", "pos", "ref", "alt"]
FEATURE = ["seqid", "start", "stop", "strand"]


def compare_sets(frames: list[DataFrame], mode: str, keys: list[str]) -> DataFrame:
    """union, intersection, or difference (the first without all others) of keyed rows; distinct keys."""
    parts = [f.select(*keys).distinct() for f in frames]
    if mode == "union":
        return reduce(lambda a, b: a.union(b), parts).distinct()
    how = {"intersection": "left_semi", "difference": "left_anti"}[mode]
    return reduce(lambda a, b: a.join(b, keys, how), parts)


def compare_vcf(frames: list[DataFrame], mode: str, min_qual: float | None = None) -> DataFrame:
    if min_qual is not None:
        frames = [f.where(F.col("qual") >= min_qual) for f in frames]
    return compare_sets(frames, mode, VARIANT)


def gff_set_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    return compare_sets([x.where(F.col("type") == "CDS") for x in (a, b)], op, FEATURE)


def kmer_set(counts: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    keep = F.col("count") >= low
    return counts.where(keep & (F.col("count") <= high) if high is not None else keep).select("kmer")


def kmer_neighbors(df: DataFrame, subs: int = 1, ins: int = 0, dels: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """All k-mers (column kmer) within so many edits; substitutions, insertions (a base enters and the last one
    leaves) and deletions (a base leaves and any base enters at the end) each in rounds on distinct rows. Columns in keep
    go with each k-mer."""
    acgt = F.array(*map(F.lit, "ACGT"))

    def once(d: DataFrame, kind: str) -> DataFrame:
        n = F.length("kmer")
        each = d.withColumn("i", F.explode(F.sequence(F.lit(1), n))).withColumn("b", F.explode(acgt))
        head, rest = F.left("kmer", F.col("i") - 1), F.substring("kmer", F.col("i"), n)
        tail = F.substring("kmer", F.col("i") + 1, n)
        made = {"sub": F.concat(head, "b", tail), "ins": F.left(F.concat(head, "b", rest), n), "del": F.concat(head, tail, "b")}[kind]
        return each.select(*keep, made.alias("kmer")).union(d).distinct()

    out = df.select(*keep, "kmer").distinct()
    for kind, times in (("sub", subs), ("ins", ins), ("del", dels)):
        for _ in range(times):
            out = once(out, kind)
    return out


#: K-mers that a task grows to their neighbours, where there are many.
NEAR_ROWS = 2_000


def near_kmers(one: DataFrame, two: DataFrame, subs: int) -> DataFrame:
    """(kmer, other): canonical k-mers of one and of two that are equal, on either strand, but for so many bases. The side
    with fewer k-mers grows to its neighbours, which meet the other side as they are: if a k-mer is near another, that one
    is near it. The last round is not made distinct, so pairs may repeat."""
    a, b = (stored(x.select("kmer").distinct()) for x in (one, two))
    n = a.count(), b.count()
    turned = n[0] > n[1]
    few, many = (b, a) if turned else (a, b)
    # a small file would be one task, whatever its rows grow to
    few = few.repartition(int(min(1 + min(n) // NEAR_ROWS, 256 * few.sparkSession.sparkContext.defaultParallelism)))
    grown = few.withColumn("__own", F.col("kmer"))
    if subs > 1:
        grown = kmer_neighbors(grown, subs - 1, keep=("__own",))
    mine, other = ("kmer", "__own") if turned else ("__own", "kmer")
    plain = lambda x: x.agg(F.min(F.length("kmer")), F.max(F.length("kmer")), F.bool_and(F.col("kmer").rlike("^[ACGT]+$"))).first()
    kinds = {tuple(plain(x)) for x in (few, many)}
    k = max((x[1] or 0 for x in kinds), default=0)
    if kinds == {(k, k, True)} and k <= 31:
        # as numbers of two bits a base, whose order is that of the texts; a base changed is an exclusive or on either strand
        number = lambda c: F.conv(F.translate(c, "ACGT", "0123"), 4, 10).cast("long")
        text = lambda c: F.translate(F.lpad(F.conv(F.col(c).cast("string"), 10, 4), k, "0"), "0123", "ACGT")
        ways = [F.least(F.col("__x").bitwiseXOR(F.lit(v << 2 * i).cast("long")), F.col("__y").bitwiseXOR(F.lit(v << 2 * (k - 1 - i)).cast("long"))) for i in range(k) for v in (1, 2, 3)]
        coded = grown.select(number(F.col("__own")).alias("__own"), number(F.col("kmer")).alias("__x"), number(revcomp(F.col("kmer"))).alias("__y"))
        made = coded.select("__own", F.explode(F.array(F.least("__x", "__y"), *ways)).alias("kmer"))
        met = made.join(many.select(number(F.col("kmer")).alias("kmer")).hint("merge"), "kmer")
        return met.select(text(mine).alias("kmer"), text(other).alias("other"))
    at = F.explode(F.sequence(F.lit(1), F.length("kmer"))).alias("__i")
    each = grown.select("__own", "kmer", at).select("__own", "kmer", "__i", F.explode(F.array(*map(F.lit, "ACGT"))).alias("__b"))
    each = each.where(F.substring("kmer", F.col("__i"), F.lit(1)) != F.col("__b"))
    made = each.select("__own", F.concat(F.left("kmer", F.col("__i") - 1), "__b", F.substring("kmer", F.col("__i") + 1, F.length("kmer"))).alias("kmer"))
    met = made.union(grown.select("__own", "kmer")).select("__own", canonical(F.col("kmer")).alias("kmer")).join(many.hint("merge"), "kmer")
    return met.select(F.col(mine).alias("kmer"), F.col(other).alias("other"))


def dedupe(df: DataFrame, rcomp: bool = True, unique_only: bool = False, by_name: bool = False, order: str = "ordinal") -> DataFrame:
    """The first row of each sequence (or its reverse complement); with unique_only those without any copy."""
    key = canonical(F.col("bases")) if rcomp else F.col("bases")
    keys = [key.alias("__k")] + ([F.col("name")] if by_name else [])
    rows = df.withColumn("__k", key)
    names = ["__k"] + (["name"] if by_name else [])
    first = rows.groupBy(*names).agg(F.min(order).alias("__o"), F.count("*").alias("__n"))
    if unique_only:
        first = first.where("__n = 1")
    # by sequence and order: another sequence may have the same number
    same = [rows[c].eqNullSafe(first[c]) for c in names]
    return rows.join(first.hint("merge"), reduce(lambda x, y: x & y, same, rows[order] == first["__o"]), "left_semi").drop("__k")


def count_duplicates(df: DataFrame, bases: bool = True, names: bool = False, quals: bool = False) -> DataFrame:
    cols = [c for c, use in (("bases", bases), ("name", names), ("quals", quals)) if use]
    g = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("reads"), F.sum(F.col("n") - 1).alias("duplicates"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("fraction"))


def mark_duplicates(df: DataFrame, counts: bool = False, order: str = "ordinal") -> DataFrame:
    """" duplicate" after the name of second and later copies, or the number of copies after every name."""
    g = df.groupBy("bases").agg(F.min(order).alias("__o"), F.count("*").alias("__n"))
    rows = df.join(g, "bases")
    name = F.concat("name", F.lit(" copies="), F.col("__n").cast("string")) if counts else F.when(F.col(order) > F.col("__o"), F.concat("name", F.lit(" duplicate"))).otherwise(F.col("name"))
    return rows.withColumn("name", name).drop("__o", "__n")


def dedupe_by_mapping(aln: DataFrame, keys=("rname", "pos", "ref_len", "strand"), best: str = "mapq", order: str = "aln_id") -> DataFrame:
    """One alignment of each placement, the best value first, then the order; rows without a placement stay."""
    k = list(keys)
    placed, other = aln.where(F.col(k[0]).isNotNull()), aln.where(F.col(k[0]).isNull())
    top = placed.groupBy(*k).agg(F.max(F.struct(F.col(best).alias("b"), (-F.col(order)).alias("o"))).alias("t")).select((-F.col("t.o")).alias(order))
    return placed.join(top, order, "left_semi").unionByName(other)


def dedupe_optical(df: DataFrame, distance: int, subs: int = 2, umi: bool = False, prefix: int = 16, order: str = "ordinal") -> DataFrame:
    """Reads near an earlier read of one tile (dx, dy up to distance) with the same first bases and up to subs
    differences go. Reads meet in grid cells of the distance, so a tile is never one group. Of equal reads at one place the
    first stands for the others, which go."""
    rows = df.withColumns({"h": parse_header(F.col("name")), "seed": F.left("bases", F.lit(prefix))})
    rows = rows.select(order, "bases", "seed", *(["umi"] if umi else []), F.col("h.lane").alias("lane"), F.col("h.tile").alias("tile"), F.col("h.x").alias("x"), F.col("h.y").alias("y"))
    place = ["bases", "seed", *(["umi"] if umi else []), "lane", "tile", "x", "y"]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in place])  # others meet nothing
    if distance < 0 or subs < 0:
        return df
    rows = stored(rows.where(known).select(order, *place))
    copies = rows.groupBy(*place).agg(F.min(order).alias("__first"))
    later = rows.join(copies.hint("merge"), place).where(F.col(order) > F.col("__first")).select(order)
    rows = copies.withColumnRenamed("__first", order).withColumns({"cx": F.floor(F.col("x") / max(1, distance)), "cy": F.floor(F.col("y") / max(1, distance))})
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    other = rows.withColumn("m", F.explode(near)).withColumns({"cx": F.col("cx") + F.col("m.a"), "cy": F.col("cy") + F.col("m.b")})
    on = ["lane", "tile", "cx", "cy", "seed"] + (["umi"] if umi else [])
    other = other.select(*on, F.col(order).alias("o2"), F.col("bases").alias("b2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    hit = rows.join(other, on).where((F.col("o2") < F.col(order)) & (F.abs(F.col("x") - F.col("x2")) <= distance) & (F.abs(F.col("y") - F.col("y2")) <= distance) & (F.length("bases") == F.length("b2")))
    hit = hit.where(hamming(F.col("bases"), F.col("b2")) <= subs)
    return df.join(hit.select(order).distinct().union(later).hint("merge"), order, "left_anti")


def unique_prefixes(df: DataFrame, n: int, order: str = "ordinal") -> DataFrame:
    top = df.groupBy(F.left("bases", F.lit(n)).alias("p")).agg(F.min(order).alias(order))
    return df.join(top.select(order), order, "left_semi")


def contained_exact(df: DataFrame, k: int, id_col: str) -> DataFrame:
    """(s, l): sequences of at least k bases that lie whole in l, on either strand; candidates share the first k-mer."""
    b = F.length("bases")
    short = df.where(b >= k).select(F.col(id_col).alias("s"), F.col("bases").alias("sb"))
    both = short.select("s", F.explode(F.array("sb", revcomp(F.col("sb")))).alias("q"))
    seeds = both.select("s", "q", F.left("q", F.lit(k)).alias("kmer"))
    cut = df.select(F.col(id_col).alias("l"), F.explode(pieces(F.col("bases"), k)).alias("c"))
    places = cut.select("l", F.explode(words(F.col("c"), k, False)).alias("kmer")).distinct()
    cand = seeds.join(places.hint("merge"), "kmer").where("s <> l").select("s", "l", "q").distinct()
    full = cand.join(df.select(F.col(id_col).alias("l"), F.col("bases").alias("lb")).hint("merge"), "l")
    longer = (F.length("lb") > F.length("q")) | ((F.length("lb") == F.length("q")) & (F.col("l") < F.col("s")))
    return full.where(longer & F.contains("lb", F.col("q"))).select("s", "l").distinct()


#: Letters of a piece from which on pieces are joined; shorter ones lie in many sequences by chance.
NEAR_SEED = 12


def faced_near(short: DataFrame, df: DataFrame, id_col: str) -> DataFrame:
    """contained_near for short (s, q, n, e) whose pieces have few letters: blocks of them meet blocks of all sequences, and
    the pieces find their places in the task, so that no place that fits by chance is sent. Long sequences come in pieces with
    as much on both sides as a short one can reach."""
    import numpy as np
    import pyarrow as pa

    from strandlake.operators.aligner import band_edits
    from strandlake.operators.similarity import block_pairs, in_pairs

    kind = dict(df.dtypes)[id_col]
    reach = short.agg(F.max(F.col("n") + F.col("e"))).first()[0]
    if reach is None:
        return df.select(F.col(id_col).alias("s"), F.col(id_col).alias("l"), F.lit(0).cast("long").alias("edits")).where("false")
    start = lambda i: F.greatest(i * PIECE - reach, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("bases"), F.lit(1)) - 1) / PIECE).cast("int")), lambda i: F.struct(start(i).alias("from"), (i * PIECE - start(i)).alias("lead"), F.substring("bases", start(i) + 1, (i + 1) * PIECE + reach - start(i)).alias("c")))
    long = df.where("bases is not null").select(F.col(id_col).alias("l"), F.length("bases").alias("size"), F.explode(cut).alias("x")).select("l", "size", "x.lead", "x.c")

    def hashes(codes, width):
        out = np.zeros(max(len(codes) - width + 1, 0), np.uint64)
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(out)]
        return out

    def flat(texts):
        size = np.array([len(x) for x in texts], np.int64)
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64), size, np.cumsum(size) - size

    def run(one, two, _):
        queries, texts = one.column("q").to_pylist(), two.column("c").to_pylist()
        s, l = one.column("s").to_pylist(), two.column("l").to_pylist()
        n, e = (one.column(c).to_numpy().astype(np.int64) for c in ("n", "e"))
        whole, lead = (two.column(c).to_numpy().astype(np.int64) for c in ("size", "lead"))
        asked, _, asked_at = flat(queries)
        codes, size, _ = flat(texts)
        of = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        core = (place >= lead[of]) & (place < lead[of] + PIECE)
        who = np.repeat(np.arange(len(queries)), e + 1)
        number = np.arange(len(who)) - np.repeat(np.cumsum(e + 1) - e - 1, e + 1)
        at = number * n[who] // (e[who] + 1)
        width = (number + 1) * n[who] // (e[who] + 1) - at
        found = []
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            seeds, words = hashes(asked, w)[asked_at[who[own]] + at[own]], hashes(codes, w)
            some = np.flatnonzero(core[: len(words)] & (size[of[: len(words)]] - place[: len(words)] >= w))
            some = some[np.argsort(words[some], kind="stable")]
            lo, hi = (np.searchsorted(words[some], seeds, x) for x in ("left", "right"))
            hits = hi - lo
            pick = np.repeat(own, hits)
            there = some[np.repeat(lo, hits) + np.arange(len(pick)) - np.repeat(np.cumsum(hits) - hits, hits)]
            k, j = who[pick], of[there]
            fits = (whole[j] > n[k]) | (whole[j] == n[k])
            found.append(np.stack([k[fits], j[fits], (place[there] - at[pick])[fits]]))
        k, j, d = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((3, 0), np.int64)
        for lo in range(0, len(k), 1 << 16):
            rows = []
            for a, b, c in zip(k[lo : lo + (1 << 16)].tolist(), j[lo : lo + (1 << 16)].tolist(), d[lo : lo + (1 << 16)].tolist(), strict=True):
                if s[a] is not None and l[b] is not None and s[a] != l[b] and (whole[b] > n[a] or l[b] < s[a]):
                    rows.append((a, b, texts[b][max(c - e[a], 0) : max(c + n[a] + e[a], 0)]))
            edits = np.array([0 if queries[a] in x else -1 for a, _, x in rows], np.int64)
            rest = [i for i in np.flatnonzero(edits < 0).tolist() if e[rows[i][0]] > 0 and rows[i][2]]
            if rest:
                most = np.array([e[rows[i][0]] for i in rest], np.int64)
                edits[rest] = band_edits([queries[rows[i][0]] for i in rest], [rows[i][2] for i in rest], most, 2 * most)
            best = {}
            for i in np.flatnonzero(edits >= 0).tolist():
                key = rows[i][:2]
                best[key] = min(best.get(key, edits[i]), edits[i])
            if best:
                a, b = (pa.array([x[i] for x in best]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([one.column("s").take(a), two.column("l").take(b), pa.array(list(best.values()), pa.int64())], names=["s", "l", "edits"])

    return in_pairs(block_pairs(short, long, "s", "l"), run, f"s {kind}, l {kind}, edits long")


def contained_near(df: DataFrame, min_identity: float, id_col: str, ask: str = "true") -> DataFrame:
    """(s, l, edits): sequences that lie in l, on either strand, with at most floor(length * (1 - min_identity / 100))
    edits, e of them; of those that meet the condition ask.

    Every such place is found: of e + 1 pieces of the short sequence one is free of edits (pigeonhole) and joins the
    words of the long ones, which gives a diagonal; the long sequence's bases around it, e more on each side, are fetched
    from tiles and aligned in a band with free ends. Sequences whose pieces are short meet all in blocks (faced_near).
    Sequences of e bases or fewer are left out."""
    from strandlake.operators.aligner import with_edits
    from strandlake.operators.pileup import cut_ranges

    n = F.length("bases")
    e = F.floor(n * (1 - min_identity / 100) + 1e-9).cast("int")
    short = df.where(ask).select(F.col(id_col).alias("s"), F.explode(F.array("bases", revcomp(F.col("bases")))).alias("q"), n.alias("n"), e.alias("e")).where("n > e")
    m = F.col("e") + 1
    many = F.floor(F.col("n") / m) < NEAR_SEED
    faced = faced_near(short.where(many), df, id_col)
    cut = F.transform(F.sequence(F.lit(0), F.col("e")), lambda i: F.struct(F.floor(i * F.col("n") / m).cast("int").alias("at"), F.floor((i + 1) * F.col("n") / m).cast("int").alias("end")))
    seeds = short.where(~many).select("s", "q", "n", "e", F.explode(cut).alias("c"))
    seeds = stored(seeds.select("s", "q", "n", "e", "c.at", F.substring("q", F.col("c.at") + 1, F.col("c.end") - F.col("c.at")).alias("seed")))
    sizes = [r[0] for r in seeds.select(F.length("seed")).distinct().collect()]  # a few lengths
    size = F.length("bases").alias("size")
    parts = [df.select(F.col(id_col).alias("l"), size, F.posexplode(pieces(F.col("bases"), w)).alias("piece", "c")).select("l", "size", "piece", F.posexplode(words(F.col("c"), w, False)).alias("i", "seed")) for w in sizes]
    if not parts:
        return faced.groupBy("s", "l").agg(F.min("edits").alias("edits"))
    places = reduce(lambda x, y: x.union(y), parts).select("l", "size", "seed", (F.col("piece") * PIECE + F.col("i")).alias("place"))
    met = seeds.join(places.hint("merge"), "seed").where("s <> l and (size > n or (size = n and l < s))")
    keys = ["s", "q", "n", "e", "l", "d"]
    met = met.select("s", "q", "n", "e", "l", (F.col("place") - F.col("at")).alias("d")).distinct()
    kind = dict(df.dtypes)[id_col]
    start = F.greatest(F.col("d") - F.col("e"), F.lit(0))
    asked = met.select(*keys, F.col("l").cast("string").alias("chrom"), (start + 1).alias("start"), (F.col("d") + F.col("n") + F.col("e") + 1).alias("stop"))
    facing = cut_ranges(df.select(F.col(id_col).cast("string").alias("name"), "bases"), asked, keys)
    rows = facing.select("s", "l", "q", "bases", F.col("e").cast("long").alias("e"), (2 * F.col("e")).cast("long").alias("free"))
    exact = rows.where(F.contains("bases", F.col("q"))).select("s", "l", F.lit(0).cast("long").alias("edits"))
    near = with_edits(rows.where("e > 0").where(~F.contains("bases", F.col("q"))), "q", "bases", "e", "free").where("edits is not null").select("s", "l", "edits")
    return exact.union(near).union(faced).groupBy("s", "l").agg(F.min("edits").alias("edits")).select(F.col("s").cast(kind).alias("s"), F.col("l").cast(kind).alias("l"), "edits")


def dedupe_containment(df: DataFrame, k: int = 31, id_col: str = "name", min_identity: float = 100.0, ask: str = "true") -> DataFrame:
    """Sequences that lie whole in a longer one (either strand) go, equal ones but the first too: exactly, or with
    min_identity below 100 with as many edits as that allows (then k does not count). Only sequences that meet the
    condition ask are looked for and returned, in all sequences."""
    found = contained_exact(df, k, id_col) if min_identity >= 100 else contained_near(df, min_identity, id_col, ask)
    return df.where(ask).join(found.select(F.col("s").alias(id_col)).distinct().hint("merge"), id_col, "left_anti")


def overlap_edges(df: DataFrame, min_overlap: int = 200, id_col: str = "name") -> DataFrame:
    """(a, b, overlap): suffix of a equal to a prefix of b, the longest of at least min_overlap. Heads and places meet in a
    shuffle (see joins.kmer_rows)."""
    heads = df.where(F.length("bases") >= min_overlap).select(F.col(id_col).alias("b"), F.col("bases").alias("bb"), F.left("bases", F.lit(min_overlap)).alias("kmer"))
    places = df.where(F.length("bases") >= min_overlap).select(F.col(id_col).alias("a"), F.col("bases").alias("ab"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length("bases") - min_overlap + 1), lambda i: F.substring("bases", i, F.lit(min_overlap)))).alias("pos", "kmer"))
    n = F.length("ab") - F.col("pos")
    hit = places.join(heads.hint("merge"), "kmer").where("a <> b").withColumn("n", n).where(F.startswith("bb", F.substring("ab", F.col("pos") + 1, F.col("n"))))
    return hit.groupBy("a", "b").agg(F.max("n").cast("bigint").alias("overlap"))


def overlap_clusters(df: DataFrame, min_overlap: int = 200, id_col: str = "name", edges: DataFrame | None = None) -> DataFrame:
    """(id, cluster): the least id that overlaps reach; a sequence without overlaps is alone. Edges may be given."""
    from strandlake.operators.graphs import connected_components

    found = connected_components(overlap_edges(df, min_overlap, id_col) if edges is None else edges).withColumnRenamed("node", id_col)
    return df.select(id_col).distinct().join(found.hint("merge"), id_col, "left").select(id_col, F.coalesce("component", id_col).alias("cluster"))


def cluster_summary(df: DataFrame, clusters: DataFrame, edges: DataFrame, id_col: str = "name") -> DataFrame:
    """Per cluster of overlap_clusters: size, bases, links (distinct pairs), and the representative: the longest sequence,
    of equals the one with most links, then the least id."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = pairs.select(F.col("a").alias(id_col)).union(pairs.select("b")).groupBy(id_col).agg(F.count("*").alias("k"))
    rows = df.select(id_col, F.length("bases").cast("bigint").alias("n")).join(clusters.hint("merge"), id_col).join(links.hint("merge"), id_col, "left").fillna(0, ["k"])
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("k")).alias("k"), F.col(id_col).alias("i"))).alias("b")
    g = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("bases"), (F.sum("k") / 2).cast("bigint").alias("links"), best)
    return g.select("cluster", "size", "bases", "links", F.col("b.i").alias("representative"))


def diff_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines (ordinal, value) that differ by position; a missing line is null."""
    x, y = a.select("ordinal", F.col("value").alias("a")), b.select("ordinal", F.col("value").alias("b"))
    return x.join(y, "ordinal", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def concat_text(spark, paths: list[str], comment: str = "@") -> DataFrame:
    """Lines of files; header lines (by their first character) only from the first file by name."""
    rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("f"))
    first = rows.agg(F.min("f").alias("first"))
    return rows.crossJoin(F.broadcast(first)).where(~F.startswith("value", F.lit(comment)) | (F.col("f") == F.col("first"))).select("value")


def lowest_error(df: DataFrame, key: str) -> DataFrame:
    return first_of_group(df, [key], F.round(expected_errors(F.col("quals")), 9), F.col("ordinal"))
