"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: every source has a weight; shares of all words by weight, none above TIMES its own size, the excess shared
   again by weight until none is above (a loop of sums over the sources).
2. Schedule: slot i of the mix is the point i * GOLDEN mod 2**31, a golden-ratio sequence in integers. Sources own
   consecutive ranges of these points in proportion to their targets, and a slot belongs to the source whose range its
   point is in. Any stretch of the schedule so has every source near its share. Ranges and points meet in bins.
3. Ranks: slots are numbered within their source by counts over chunks of CHUNK slots, and rows within a chunk.
4. Streams: documents of a source, in the order of a digest of their ids, lie end to end and are read up to TIMES times.
   A stream is cut into blocks of equal words; block r of a source joins the source's slot of rank r.

No window holds a source: chunks of slots and digest buckets bound every group, also where one source has a third of all
documents. Digest order and integer points make reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import WORD, discard, read, stored

#: Weights of sources in their order, repeating.
WEIGHTS = (1, 2, 3)
TIMES = 3
#: Words of a block, and points of the schedule: GOLDEN is the odd number nearest to POINTS over the golden ratio.
BLOCK = 16
POINTS = 1 << 31
GOLDEN = 1327217885
#: Slots of a chunk, and about the documents of a digest bucket.
CHUNK, BUCKET = 1 << 16, 1 << 12
#: Copies of one row that are made at once.
COPIES = 1 << 12
#: Sources up to which their table is broadcast.
SMALL = 1 << 14


def lookup(sources: DataFrame) -> DataFrame:
    """A table of sources for joins on the source: broadcast where its size, checked, allows it."""
    return F.broadcast(sources) if sources.count() <= SMALL else sources


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df, stored, with sums over all rows before each in the order: ranges of rows are summed, and rows within ranges.
    The driver has one row of sums for each range."""
    spark = df.sparkSession
    part = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    totals = part.groupBy("__part").agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()]).orderBy("__part").collect()
    before, rows = dict.fromkeys(sums, 0), []
    for row in totals:
        rows.append((row["__part"], *before.values()))
        before = {n: before[n] + row[n] for n in sums}
    bases = spark.createDataFrame(rows, ", ".join(["__part int", *(f"`__{n}` long" for n in sums)]))
    earlier = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = part.join(F.broadcast(bases), "__part")
    out = out.withColumns({n: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long") + F.col(f"__{n}") for n, c in sums.items()})
    done = stored(out.select(*df.columns, *sums))
    discard(part)
    return done


def targets(sources: DataFrame, weights=WEIGHTS, times: int = TIMES) -> DataFrame:
    """(source, source_size, target, units, lo) of sources (source, source_size): targets as in the module's text, and
    each source's range of points [lo, lo + units). Sources come by code point, null last. Words of all sources are
    targets of some source; without words all targets are 0."""
    order = [F.asc_nulls_last("source")]
    placed = running(sources, order, {"place": F.lit(1)})
    placed = placed.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    above, level, held = F.lit(False), 0.0, -1
    while True:  # those above at one level stay above at the next
        row = placed.agg(F.sum(F.when(above, times * F.col("source_size")).otherwise(0)).alias("c"), F.sum(F.when(above, 0).otherwise(F.col("w"))).alias("w"), F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == held:
            break
        held = row["n"]
        if not row["w"]:
            break
        level = (total - row["c"]) / row["w"]
        above = times * F.col("source_size") <= level * F.col("w")
    target = F.when(above, (times * F.col("source_size")).cast("double")).otherwise(level * F.col("w"))
    placed = placed.withColumn("target", target).withColumn("units", F.floor(F.col("target") * POINTS / F.lit(max(total, 1))).cast("long"))
    out = running(placed.select("source", "source_size", "target", "units"), order, {"lo": F.col("units")})
    return out


def slots(sources: DataFrame, n: int) -> DataFrame:
    """(source, slot, rank) for slots 0 to n - 1 of sources (source, lo, units): rank counts a source's slots before it.
    Points beyond the last range, which rounding down leaves, are empty slots and have no row."""
    spark = sources.sparkSession
    bins = 1 << max(6, math.ceil(math.log2(max(1, sources.count()))))
    width = POINTS // bins
    own = sources.where("units > 0").select("source", "lo", (F.col("lo") + F.col("units")).alias("hi"))
    own = own.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    at = (F.col("id") % POINTS * GOLDEN) % POINTS
    points = spark.range(n).select(F.col("id").alias("slot"), at.alias("x")).withColumn("bin", F.floor(F.col("x") / width))
    taken = points.join(own, "bin").where("x >= lo and x < hi").select("source", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    taken = stored(taken)
    counts = taken.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = taken.withColumn("nth", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")))
    return placed.join(base, placed["source"].eqNullSafe(base["s"]) & (placed["chunk"] == base["c"])).select("source", "slot", (F.col("base") + F.col("nth") - 1).alias("rank"))


def streams(docs: DataFrame) -> DataFrame:
    """docs (source, doc_id, size, copies) with `at`, the words before the document in its source's stream. The order is
    that of a digest of the id (then of the id and size); copies of a row follow one another."""
    n = docs.count()
    digits = max(1, math.ceil(math.log(max(1, n / BUCKET), 16)))
    keyed = docs.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("key", 1, digits))
    words = F.col("size") * F.col("copies")
    counts = keyed.groupBy("source", "bucket").agg(F.sum(words).alias("n"))
    up_to = Window.unboundedPreceding, -1
    base = counts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(*up_to)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum(words).over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(*up_to)), F.lit(0))
    placed = keyed.withColumn("inside", inside)
    joined = placed.join(base, placed["source"].eqNullSafe(base["s"]) & (placed["bucket"] == base["b"]))
    return joined.select("source", "doc_id", "size", "copies", (F.col("base") + F.col("inside")).alias("at"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, doc_id, size, copies), stored: rows alike in all three once, with their number."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), size.alias("size"))
    return stored(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")))


def schedule(own: DataFrame, weights=WEIGHTS, times: int = TIMES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """For own (source, doc_id, size, copies): the mix, stored, as pieces (slot, source, doc_id, size, start, words,
    epoch): `words` words of a document from `start` (counted through all copies of its row) are read at that slot,
    in the given pass over the stream; and the targets (see targets)."""
    sources = targets(own.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, times)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    held = slots(sources, -(-total // block))
    ends = held.groupBy("source").agg(F.count("*").alias("n"))
    ends = ends.join(sources.select(F.col("source").alias("s"), "source_size"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("s").alias("of"), "n", "source_size")
    ends = lookup(stored(ends))
    placed = streams(own.where("size > 0"))
    placed = placed.join(ends, placed["source"].eqNullSafe(ends["of"])).drop("of")
    # passes over the stream that the source's blocks reach
    passes = F.sequence(F.lit(0), F.least(F.lit(times - 1), F.floor((F.col("n") * block - 1) / F.col("source_size"))).cast("int"))
    read = placed.withColumn("epoch", F.explode(passes)).withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("at"))
    read = read.withColumn("end", F.col("begin") + F.col("size") * F.col("copies"))
    first, last = F.floor(F.col("begin") / block), F.least(F.floor((F.col("end") - 1) / block), F.col("n") - 1)
    cut = read.where(first <= last).withColumn("rank", F.explode(F.sequence(first, last)))
    start, end = F.greatest(F.col("begin"), F.col("rank") * block), F.least(F.col("end"), (F.col("rank") + 1) * block)
    cut = cut.select(F.col("source").alias("from"), "rank", "doc_id", "size", "epoch", (start - F.col("begin")).alias("start"), (end - start).alias("words"))
    mix = cut.join(held.withColumnRenamed("rank", "r"), F.col("from").eqNullSafe(F.col("source")) & (F.col("rank") == F.col("r")))
    return stored(mix.select("slot", "source", "doc_id", "size", "start", "words", "epoch")), sources


def mix(docs: DataFrame, weights=WEIGHTS, times: int = TIMES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target (of its source) and taken, the words that the mix takes
    of it, repeats counted.

    Null texts have no words. Null sources are one source, the last. Rows with a null id are documents like others. Rows
    alike in id, source and size lie side by side in the stream, and each takes its part. A source's taken words are
    within a few blocks of its target, and at most times its size, so no document exceeds times its own. Other columns
    are not read. An empty table gives no rows."""
    own = sized(docs, id_col, text_col, source_col)
    pieces, sources = schedule(own, weights, times, block)
    got = pieces.groupBy("source", "doc_id", "size").agg(F.sum("words").alias("taken"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("source", "doc_id", "size")]
    joined = own.alias("a").join(got.alias("b"), same[0] & same[1] & same[2], "left").select("a.*", F.coalesce("b.taken", F.lit(0)).alias("all"))
    # copies of a row share what is taken of them; the first ones have one more where it does not part evenly
    groups = joined.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    one = groups.withColumn("nth", F.explode(F.sequence(F.col("g") * COPIES, F.least(F.col("copies"), (F.col("g") + 1) * COPIES) - 1)))
    share = F.expr("`all` div copies") + F.when(F.col("nth") < F.col("all") % F.col("copies"), 1).otherwise(0)
    one = one.select("doc_id", F.col("source").alias("of"), "size", share.cast("long").alias("taken"))
    return one.join(lookup(sources), F.col("of").eqNullSafe(F.col("source"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def op13(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


#: Copies of a row (alike in id, source and size) are counted apart only where there are some; ids are unique here.
ORACLE = f"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
p as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w, sum(source_size) over () as total from s),
f as (select 0 as step, 0::double as level, -1::bigint as held union all
  select step + 1, case when x.w > 0 then (x.total - x.c)::double / x.w else level end, x.n from f,
    lateral (select coalesce(sum(case when f.step > 0 and 3 * source_size <= f.level * p.w then 3 * source_size else 0 end), 0)::bigint as c, coalesce(sum(case when f.step > 0 and 3 * source_size <= f.level * p.w then 0 else p.w end), 0)::bigint as w,
      count(*) filter (where f.step > 0 and 3 * source_size <= f.level * p.w) as n, any_value(total)::bigint as total from p) x where x.n > f.held),
l as (select level from f order by step desc limit 1),
t as (select source, source_size, total, case when 3 * source_size <= level * w then (3 * source_size)::double else level * w end as target from p, l),
u as (select *, floor(target * {POINTS} / greatest(total, 1))::bigint as units from t),
r as (select *, (sum(units) over (order by source nulls last) - units)::bigint as lo from u),
k as (select source, count(*) as n from (select (i % {POINTS} * {GOLDEN}) % {POINTS} as x from (select unnest(range(0, ((select sum(size) from d) + {BLOCK - 1})::bigint // {BLOCK})) as i)) join r on x >= lo and x < lo + units group by source),
o as (select *, (sum(size) over (partition by source order by md5(coalesce(doc_id::varchar, '')), doc_id nulls first, size rows unbounded preceding) - size)::bigint as below from d)
select doc_id, size, source_size, target, coalesce(case when size > 0 then (select sum(greatest(0, least(e * source_size + below + size, n * {BLOCK}) - (e * source_size + below)))
  from (select unnest(range({TIMES})) as e)) end, 0)::bigint as taken
from o join r on o.source is not distinct from r.source left join k on k.source is not distinct from o.source
"""
