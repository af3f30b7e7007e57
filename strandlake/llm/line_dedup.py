"""Line dedup by range-partitioned line hashes and per-document bitmaps; DataFrame functions only.

Lines become rows of two 64-bit hashes, document and position. They are range-partitioned by (hash, document), so
a line that a third of the corpus holds is spread over partitions, and sorted inside by position: a window that
streams over each (hash, document) passes first occurrences on. Those are counted per hash with partial sums.
What each document loses comes back as a sparse bitmap (word number -> 64 bits), never as text; the text meets
its bitmap in one join on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import SPACE, ascii_lower, bit_at, fresh, read, stored


def lines_of(text: Column) -> Column:
    """Lines between line feeds; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that loses lines: (id, drops), drops being a map from word number to 64 bits, bit i of word w
    for line 64 * w + i. A line goes if its key (stripped, A-Z lower-cased) has at least min_chars code points
    and is in at least min_docs documents, this one not being the largest id of them. Null ids lose no line."""
    line = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("d"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    line = line.select("d", "pos", F.btrim("line", F.lit(SPACE)).alias("k")).where(F.char_length("k") >= min_chars)
    line = line.select("d", "pos", ascii_lower(F.col("k")).alias("k"))
    # two hashes that do not determine each other: the second starts from the hash of a number
    line = line.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"), "d", "pos")
    ranged = line.repartitionByRange("h1", "h2", "d")
    nth = F.row_number().over(Window.partitionBy("h1", "h2", "d").orderBy("pos"))
    first = ranged.withColumn("n", nth).where("n = 1")
    # stored, so that the join stands alone and Spark can split a line that many documents hold
    frequent = stored(first.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("d").alias("last")).where(F.col("docs") >= min_docs))
    lost = line.join(frequent, ["h1", "h2"]).where("d <> last").select("d", "pos")
    words = lost.groupBy("d", F.shiftright("pos", 6).alias("w")).agg(F.bit_or(bit_at(F.col("pos").bitwiseAND(F.lit(63)))).alias("bits"))
    return words.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("drops")).withColumnRenamed("d", id_col)


def is_dropped(drops: Column, pos: Column) -> Column:
    bits = F.coalesce(F.try_element_at(drops, F.shiftright(pos, 6)), F.lit(0).cast("long"))
    return bits.bitwiseAND(bit_at(pos.bitwiseAND(F.lit(63)))) != 0


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", prefix: str = "line") -> DataFrame:
    """Every row of docs with its columns, plus {prefix}_count, {prefix}_drops, {prefix}_kept (the text that stays) and
    {prefix}_map (the bitmap of what goes, null if nothing does).

    Null text counts as one empty line and stays an empty text; rows with a null id are kept as they are; rows
    that repeat an id share its bitmap. Raises ValueError where docs has a column of one of the four names: choose
    another prefix. All other columns pass through."""
    names = [f"{prefix}_{x}" for x in ("count", "drops", "kept", "map")]
    if clash := {x.lower() for x in docs.columns} & {x.lower() for x in names}:
        raise ValueError(f"docs has columns {sorted(clash)}: choose another prefix")
    key, cut = fresh(docs, "id"), names[3]
    drops = drop_bitmaps(docs, min_chars, min_docs, id_col, text_col).select(F.col(id_col).alias(key), F.col("drops").alias(cut))
    lines = lines_of(F.col(text_col))
    kept = F.array_join(F.filter(lines, lambda x, i: ~is_dropped(F.col(cut), i)), "\n")
    n = F.aggregate(F.map_values(cut), F.lit(0), lambda s, b: s + F.bit_count(b))
    joined = docs.join(drops.hint("shuffle_hash"), F.col(id_col) == F.col(key), "left")
    return joined.select(
        *[docs[x] for x in docs.columns],
        F.size(lines).cast("long").alias(names[0]),
        F.when(F.col(cut).isNull(), 0).otherwise(n).cast("long").alias(names[1]),
        F.when(F.col(cut).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept).alias(names[2]),
        F.col(cut),
    )


def bitmap_text(drops: Column) -> Column:
    """A bitmap as text: word number and hexadecimal bits, comma-joined in order; empty where nothing goes."""
    words = F.array_sort(F.map_entries(drops))
    return F.coalesce(F.array_join(F.transform(words, lambda x: F.concat(x["key"].cast("string"), F.lit(":"), F.hex(x["value"]))), ","), F.lit(""))


def op6(spark, sf_dir):
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = {"n_lines": F.col("line_count"), "n_dropped": F.col("line_drops"), "kept_sha256": F.sha2("line_kept", 256), "drop_bitmap": bitmap_text(F.col("line_map"))}
    return out.select("doc_id", *[c.alias(name) for name, c in columns.items()])


ORACLE = r"""
with l as (
  select doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
f as (select k, max(doc_id) as last from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
b as (select doc_id, string_agg(w || ':' || upper(to_hex(bits)), ',' order by w) as drop_bitmap from (
  select doc_id, (i - 1) // 64 as w, bit_or(1::ubigint << ((i - 1) % 64)::ubigint) as bits from l join f using (k) where doc_id <> last group by all) group by doc_id)
select coalesce(any_value(b.drop_bitmap), '') as drop_bitmap, l.doc_id, count(*) as n_lines, count(*) filter (where f.k is not null and l.doc_id <> f.last) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.k is null or l.doc_id = f.last), '')) as kept_sha256
from l left join f on l.k = f.k left join b on l.doc_id = b.doc_id group by l.doc_id
"""
