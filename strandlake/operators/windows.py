"""Order, top-k, runs and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import canonical, expected_errors, kmers, revcomp
from strandlake.operators.joins import kmer_rows
from strandlake.sources.shared import stored

SORT_KEYS = {
    "name": lambda: [F.col("name")],
    "length": lambda: [F.length("bases")],
    "quality": lambda: [F.round(expected_errors(F.col("quals")), 6)],
    "sequence": lambda: [F.col("bases")],
    "position": lambda: [F.col("rname"), F.col("pos")],
}


def sort_reads(df: DataFrame, key: str = "name", ascending: bool = True, tie: str = "ordinal") -> DataFrame:
    cols = SORT_KEYS[key]() if key in SORT_KEYS else [F.col(key)]
    return df.orderBy(*[c.asc() if ascending else c.desc() for c in cols], F.col(tie))


def sort_by_list(df: DataFrame, order: DataFrame, column: str = "name") -> DataFrame:
    """Rows in the order of a list (name, ordinal); others last."""
    o = order.select(F.col("name").alias(column), F.col("ordinal").alias("__o"))
    return df.join(o, column, "left").orderBy(F.col("__o").asc_nulls_last(), column).drop("__o")


def merge_sorted(frames: list[DataFrame], key: str) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(key)


def shuffle(df: DataFrame, seed: int, id_col: str = "ordinal") -> DataFrame:
    return df.orderBy(F.xxhash64(id_col, F.lit(seed)))


def sample(df: DataFrame, rate: float, seed: int, id_col: str = "ordinal") -> DataFrame:
    """The share of rows whose id hashes below the rate: the same rows however the data are partitioned."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / (1 << 32)
    return df.where(draw < rate)


def sample_bases(df: DataFrame, bases_target: int, longest_first: bool = False, id_col: str = "ordinal", bins: int = 1 << 16) -> DataFrame:
    """Reads up to a number of bases, in hash order or longest first. Sums by bin give the bin where the target falls;
    only that bin is ordered row by row."""
    n = F.length("bases").cast("bigint")
    key = -n if longest_first else F.pmod(F.xxhash64(id_col), F.lit(bins))
    rows = df.withColumns({"__k": key.cast("bigint"), "__n": n})
    sums = rows.groupBy("__k").agg(F.sum("__n").alias("s")).withColumn("upto", F.sum("s").over(Window.orderBy("__k")))
    marked = rows.join(sums.select("__k", (F.col("upto") - F.col("s")).alias("before")), "__k")
    inside = F.sum("__n").over(Window.partitionBy("__k").orderBy(id_col)) + F.col("before")
    return marked.withColumn("__t", inside).where((F.col("__t") - F.col("__n")) < bases_target).drop("__k", "__n", "before", "__t")


def low_cov_bases(depth: DataFrame, window: int, least: float) -> DataFrame:
    """(contig, bases): bases in windows (of window positions) whose mean depth is below least. depth has a row for each
    position; a contig's positions are taken in order."""
    w = Window.partitionBy("contig").orderBy("pos").rowsBetween(-(window - 1), 0)
    low = depth.withColumns({"m": F.avg("depth").over(w), "c": F.count("*").over(w)}).where((F.col("m") < least) & (F.col("c") == window))
    ranges = low.select("contig", (F.col("pos") - window + 1).alias("start"), F.col("pos").alias("stop"))
    return merge_ranges(ranges, "contig", 0).groupBy("contig").agg(F.sum(F.col("stop") - F.col("start") + 1).alias("bases"))


def merge_ranges(df: DataFrame, key: str, max_gap: int = 0) -> DataFrame:
    """Ranges (key, start, stop inclusive) that overlap or lie at most max_gap apart become one."""
    order = Window.partitionBy(key).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("start") > reach + 1 + max_gap)).cast("int")
    return df.withColumn("__f", fresh).withColumn("__g", F.sum("__f").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "__g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__g")


def drop_contained(df: DataFrame, key: str) -> DataFrame:
    """Ranges that lie in another one go; of equal ones the first stays."""
    order = Window.partitionBy(key).orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__r", F.max("stop").over(order)).where(F.col("__r").isNull() | (F.col("stop") > F.col("__r"))).drop("__r")


def delta_rows(depth: DataFrame) -> DataFrame:
    before = F.lag("depth").over(Window.partitionBy("contig").orderBy("pos"))
    return depth.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col("depth"))).drop("__b")


def call_peaks(hist: DataFrame, radius: int = 2, min_height: float = 2.0) -> DataFrame:
    """Local maxima of a histogram (value, count) after triangular smoothing: value, height, volume to the valleys."""
    w = Window.orderBy("value")
    smooth = sum((F.coalesce(F.lag("count", d).over(w) if d > 0 else F.lead("count", -d).over(w) if d < 0 else F.col("count"), F.lit(0)) * (radius + 1 - abs(d)) for d in range(-radius, radius + 1)), F.lit(0.0)) / ((radius + 1) ** 2)
    s = hist.withColumn("smooth", smooth)
    up = F.coalesce(F.lag("smooth").over(w), F.lit(-1.0))
    down = F.coalesce(F.lead("smooth").over(w), F.lit(-1.0))
    s = s.withColumns({"peak": (F.col("smooth") > up) & (F.col("smooth") >= down) & (F.col("smooth") >= min_height), "valley": (F.col("smooth") <= up) & (F.col("smooth") < down)})
    s = s.withColumn("island", F.sum(F.col("valley").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("island").agg(F.sum("count").alias("volume"), F.max(F.when(F.col("peak"), F.struct("smooth", "value"))).alias("p"))
    return g.where("p is not null").select(F.col("p.value").alias("value"), F.round("p.smooth", 6).alias("height"), "volume")


def find_repeats(df: DataFrame, k: int = 31, min_depth: int = 2, gap: int = 0, min_repeat: int = 0, id_col: str = "name") -> DataFrame:
    """(id, start, stop): stretches (0-based, inclusive) of k-mers that occur min_depth times or more anywhere."""
    rows = kmer_rows(df, id_col, k)
    deep = rows.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= min_depth).select("kmer")
    hit = rows.join(deep, "kmer").select(id_col, F.col("pos").cast("bigint").alias("start"), (F.col("pos") + k - 1).cast("bigint").alias("stop"))
    return merge_ranges(hit, id_col, gap).where(F.col("stop") - F.col("start") + 1 >= min_repeat)


def extend_repeat(text: str, at: int, d: int, k: int, mismatches: int, reach: int, penalty: int = 3) -> tuple[int, int, int]:
    """(start, length, mismatches) of the stretch around text[at : at + k] that is most like the one d further: of those
    with at most so many mismatches and with ends alike, the one with the most matches less penalty for each mismatch
    (of equals fewer mismatches, then the leftmost). It grows reach places to each side at most."""
    lo, hi = max(at - reach, 0), min(at + k + reach, len(text) - d)
    same = [text[t] == text[t + d] and text[t] in "ACGT" for t in range(lo, hi)]

    def ends(places, step):
        """(mismatches, matches) on the way to the far end of each run of matches."""
        out, wrong, right = [(0, 0)], 0, 0
        for t in places:
            if same[t - lo]:
                right += 1
                if not (lo <= t + step < hi and same[t + step - lo]):
                    out.append((wrong, right))
            else:
                wrong += 1
                if wrong > mismatches:
                    break
        return out

    left, right = ends(range(at - 1, lo - 1, -1), -1), ends(range(at + k, hi), 1)
    choices = ((-(m + n) + penalty * (v + w), v + w, at - m - v, at + k + n + w) for v, m in left for w, n in right if v + w <= mismatches)
    _, wrong, start, stop = min(choices)
    return start, stop - start, wrong


def stem_length(text: str, max_loop: int = 8) -> int:
    """The most bases that pair with their reverse complement around a loop of at most max_loop bases."""
    pair = {"A": "T", "C": "G", "G": "C", "T": "A"}
    best = 0
    for right in range(1, len(text)):
        for loop in range(min(max_loop, right - 1) + 1):
            i, j, n = right - loop - 1, right, 0
            while i >= 0 and j < len(text) and pair.get(text[i]) == text[j]:
                i, j, n = i - 1, j + 1, n + 1
            best = max(best, n)
    return best


def find_crisprs(df: DataFrame, k: int = 12, spacer: tuple[int, int] = (14, 60), id_col: str = "name", repeat: tuple[int, int] = (20, 60), mismatches: int = 3) -> DataFrame:
    """(id, start, repeat_length, spacer_length, mismatches, stem): the same stretch twice, a spacer between. start is
    0-based; stem is how many bases of the first copy pair within it (a palindrome).

    Seeds are k bases alike at a distance that repeat and spacer allow; those of one id meet in bins of the largest
    distance, so a common k-mer pairs with its near places only. From the first seed of each run on a diagonal the repeat
    is extended to both sides (see extend_repeat) in bases fetched from tiles. Ids are names of one sequence each."""
    import pyarrow as pa

    from strandlake.operators.pileup import cut_ranges

    kind = dict(df.dtypes)[id_col]
    near, far, reach = repeat[0] + spacer[0], repeat[1] + spacer[1], repeat[1] + mismatches + 1
    rows = kmer_rows(df, id_col, k, rcomp=False).select(id_col, "kmer", F.col("pos").cast("long").alias("pos"))
    at = F.floor(F.col("pos") / far)
    later = rows.select(id_col, "kmer", F.col("pos").alias("q"), at.alias("bin"))
    pairs = rows.withColumn("bin", F.explode(F.array(at, at + 1))).join(later, [id_col, "kmer", "bin"])
    pairs = stored(pairs.withColumn("d", F.col("q") - F.col("pos")).where(F.col("d").between(near, far)).select(id_col, "d", "pos"))
    first = pairs.join(pairs.withColumn("pos", F.col("pos") + 1), [id_col, "d", "pos"], "left_anti")
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    asked = first.select(F.col(id_col).cast("string").alias("chrom"), "d", (F.col("pos") - low).alias("at"), low.alias("low"), (low + 1).alias("start"), (F.col("pos") + F.col("d") + k + reach + 1).alias("stop"))
    facing = cut_ranges(df.select(F.col(id_col).cast("string").alias("name"), "bases"), asked, ["chrom", "d", "at", "low"])

    def run(batches):
        for batch in batches:
            out = []
            for chrom, d, own, low, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start, n, wrong = extend_repeat(text, own, d, k, mismatches, reach)
                if repeat[0] <= n <= repeat[1] and spacer[0] <= d - n <= spacer[1]:
                    out.append((chrom, low + start, n, d - n, wrong, stem_length(text[start : start + n])))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["chrom", "start", "repeat_length", "spacer_length", "mismatches", "stem"])

    found = facing.select("chrom", "d", "at", "low", "bases").mapInArrow(run, "chrom string, start long, repeat_length long, spacer_length long, mismatches long, stem long")
    return found.distinct().select(F.col("chrom").cast(kind).alias(id_col), "start", "repeat_length", "spacer_length", "mismatches", "stem")


def crispr_arrays(pairs: DataFrame, id_col: str = "name", slip: int = 3) -> DataFrame:
    """Repeats of find_crisprs chained to arrays: a pair whose second copy is the first one of another (up to slip bases
    apart) goes on there. (id, start, stop, copies, repeat_length): from the first copy to the end of the last one, the
    number of copies, the most common repeat length (of equals the least)."""
    from strandlake.operators.graphs import connected_components

    second = F.col("start") + F.col("repeat_length") + F.col("spacer_length")
    node = F.struct(F.col(id_col).alias("i"), F.col("start").alias("s"), F.col("repeat_length").alias("r"), F.col("spacer_length").alias("p"))
    rows = stored(pairs.select(id_col, "start", "repeat_length", "spacer_length", second.alias("second"), node.alias("node")))
    ahead = rows.select(id_col, F.col("start").alias("place"), F.col("node").alias("b"))
    links = rows.withColumn("place", F.explode(F.sequence(F.col("second") - slip, F.col("second") + slip))).join(ahead, [id_col, "place"]).select(F.col("node").alias("a"), "b")
    parts = connected_components(links)
    every = rows.join(parts, "node", "left").withColumn("array", F.coalesce("component", "node"))
    copies = every.select(id_col, "array", "repeat_length", F.explode(F.array(F.col("start"), F.col("second"))).alias("x"))
    w = Window.partitionBy(id_col, "array").orderBy("x")
    new = copies.withColumn("new", F.coalesce((F.col("x") - F.lag("x").over(w) > slip).cast("int"), F.lit(1)))
    g = new.groupBy(id_col, "array").agg(F.min("x").alias("start"), F.max(F.col("x") + F.col("repeat_length")).alias("stop"), F.sum("new").alias("copies"), F.mode("repeat_length", True).alias("repeat_length"))
    return g.drop("array")


def top_hits(df: DataFrame, query: str, score: str, n: int, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= n)


def count_percentile(df: DataFrame, p: float) -> DataFrame:
    """Barcode count at which barcodes from the most frequent on reach share p of all reads."""
    n = df.groupBy("barcode").agg(F.count("*").alias("n"))
    h = n.groupBy("n").agg((F.count("*") * F.col("n")).alias("reads"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("reads").over(Window.partitionBy())
    return h.withColumns({"c": F.sum("reads").over(w), "t": total}).where(F.col("c") >= F.lit(p) * F.col("t")).agg(F.max("n").alias("count_at_percentile"))


def blur_tiles(tiles: DataFrame, value: str = "v") -> DataFrame:
    """(lane, tile, bx, by, v) smoothed with 8 times itself and its four neighbours."""
    shift = [(0, 0, 8), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)]
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in shift])
    spread = tiles.withColumn("m", F.explode(moves)).select("lane", "tile", (F.col("bx") + F.col("m.a")).alias("bx"), (F.col("by") + F.col("m.b")).alias("by"), F.col("m.w").alias("w"), (F.col(value) * F.col("m.w")).alias("x"))
    g = spread.groupBy("lane", "tile", "bx", "by").agg(F.sum("x").alias("x"), F.sum("w").alias("w"), F.max(F.col("w") == 8).alias("own"))
    return g.where("own").select("lane", "tile", "bx", "by", F.round(F.col("x") / F.col("w"), 6).alias("smooth"))


def pivot_kmers(df: DataFrame, k: int, id_col: str = "ordinal") -> DataFrame:
    """(id, pivot): the k-mer of the largest md5 in each read. Reads without a k-mer have a null pivot."""
    best = F.array_max(F.transform(kmers(F.col("bases"), k), lambda x: F.struct(F.md5(canonical(x)).alias("h"), canonical(x).alias("k"))))
    return df.select(id_col, best["k"].alias("pivot"))


def clumpify(df: DataFrame, k: int = 31, id_col: str = "ordinal") -> DataFrame:
    """Rows grouped and ordered by pivot k-mer: range-partitioned, sorted inside partitions."""
    best = F.array_max(F.transform(kmers(F.col("bases"), k), lambda x: F.struct(F.xxhash64(canonical(x)).alias("h"), canonical(x).alias("k"))))
    return df.withColumn("pivot", best["k"]).repartitionByRange("pivot").sortWithinPartitions("pivot", id_col)


def mark_reverse(df: DataFrame) -> DataFrame:
    return df.withColumn("reversed", F.col("bases") > revcomp(F.col("bases")))
