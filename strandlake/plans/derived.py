"""Sequence tables derived from the driver's tables, with one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (source tables, SQL). STR is the string type of the engine.
DERIVED = {
    "dv_reads": (
        ["events"],
        """select event_id as ordinal,
  concat('M1:7:FC1:', cast(1+event_id%4 as STR), ':', cast(1101+event_id%8 as STR), ':',
         cast((event_id*37)%5000 as STR), ':', cast((event_id*91)%5000 as STR)) as name,
  translate(concat(md5(cast(event_id%700 as STR)), md5(concat('b',cast(event_id%700 as STR))),
                   md5(concat('c',cast(event_id%350 as STR)))), '0123456789abcdef','ACGTACGTACGTACGN') as bases,
  translate(concat(md5(concat('q',cast(event_id as STR))), md5(concat('r',cast(event_id as STR))),
                   md5(concat('s',cast(event_id as STR)))), '0123456789abcdef','!+5?DGHIIIIIIIII') as quals,
  substr(translate(md5(concat('bc',cast(event_id%24 as STR))),'0123456789abcdef','ACGTACGTACGTACGT'),1,8) as barcode
from events""",
    ),
    "dv_contigs": (
        ["part"],
        """select p_partkey as contig_id, concat('ctg_', cast(p_partkey as STR)) as name,
  substr(translate(concat(md5(concat('x',cast(p_partkey as STR))),md5(concat('y',cast(p_partkey as STR))),
                          md5(concat('z',cast(p_partkey as STR))),md5(concat('w',cast(p_partkey as STR)))),
         '0123456789abcdef','ACGTACGTACGTACGN'),1,cast(40+p_size as int)) as bases
from part""",
    ),
    "dv_aln": (
        ["lineitem"],
        """select l_orderkey*10+l_linenumber as aln_id, concat('ctg_', cast(l_partkey as STR)) as rname,
  cast(1+l_suppkey%30 as bigint) as pos, cast(l_quantity as bigint) as ref_len,
  cast(l_linenumber%2 as bigint) as strand, cast(round(l_discount*400) as bigint) as mapq, l_returnflag as rf
from lineitem""",
    ),
    "dv_tax": (
        ["region", "nation", "customer"],
        """select cast(1 as bigint) as id, cast(1 as bigint) as pid, 'root' as name, 9 as level
union all select cast(10+r_regionkey as bigint), cast(1 as bigint), r_name, 8 from region
union all select cast(100+n_nationkey as bigint), cast(10+n_regionkey as bigint), n_name, 6 from nation
union all select cast(1000+c_custkey as bigint), cast(100+c_nationkey as bigint), c_name, 1 from customer""",
    ),
    "dv_var": (
        ["orders"],
        """select concat('s', cast(o_custkey%3 as STR)) as sample, concat('ctg_', cast(o_orderkey%50 as STR)) as chrom,
  cast(1+o_orderkey%40 as bigint) as pos,
  substr(translate(md5(cast(o_orderkey%97 as STR)),'0123456789abcdef','ACGTACGTACGTACGT'),1,1) as ref,
  substr(translate(md5(concat('a',cast(o_orderkey%97 as STR))),'0123456789abcdef','ACGTACGTACGTACGT'),1,1) as alt,
  o_totalprice/1000 as qual
from orders""",
    ),
    "dv_edges": (
        ["embeddings"],
        """select a, b, la, lb from (
  select vec_id as a, lead(vec_id, 1) over (partition by label order by vec_id) as b, cast(label as bigint) as la, cast(label as bigint) as lb from embeddings
  union all select vec_id, lead(vec_id, 2) over (partition by label order by vec_id), cast(label as bigint), cast(label as bigint) from embeddings
  union all select vec_id, lead(vec_id, 5) over (partition by label order by vec_id), cast(label as bigint), cast(label as bigint) from embeddings) x
where b is not null""",
    ),
    # alignments of 30 reference bases with planted changes: at base 12 (X), GT before 16, 20 and 21 gone, and clipped ends
    "dv_sam": (
        ["lineitem", "part"],
        """select aln_id, rname, pos, strand, mapq,
  case kind when 2 then concat(cast(16-pos as STR),'M2I',cast(14+pos as STR),'M') when 3 then concat(cast(20-pos as STR),'M2D',cast(8+pos as STR),'M')
    when 4 then '3S30M' when 5 then concat(cast(20-pos as STR),'M2D',cast(8+pos as STR),'M') else '30M' end as cigar,
  case kind when 1 then concat(substr(b,cast(pos as int),cast(12-pos as int)),alt,substr(b,13,cast(17+pos as int)))
    when 2 then concat(substr(b,cast(pos as int),cast(16-pos as int)),'GT',substr(b,16,cast(14+pos as int)))
    when 3 then concat(substr(b,cast(pos as int),cast(20-pos as int)),substr(b,22,cast(8+pos as int)))
    when 4 then concat('TTT',substr(b,cast(pos as int),30))
    when 5 then concat(substr(b,cast(pos as int),cast(12-pos as int)),alt,substr(b,13,7),substr(b,22,cast(8+pos as int)))
    else substr(b,cast(pos as int),30) end as seq,
  substr(marks,1,case kind when 2 then 32 when 3 then 28 when 4 then 33 when 5 then 28 else 30 end) as quals
from (select concat(cast(l_orderkey as STR),'-',cast(l_linenumber as STR),'-',cast(l_partkey as STR),'-',cast(l_suppkey as STR),'-',cast(cast(l_quantity as bigint) as STR),'-',
      cast(cast(round(l_extendedprice*100) as bigint) as STR)) as aln_id,
    concat('ctg_', cast(l_partkey as STR)) as rname, cast(1+l_suppkey%10 as bigint) as pos,
    cast(l_linenumber%2 as bigint) as strand, cast(round(l_discount*400) as bigint) as mapq, (l_orderkey+l_linenumber+l_partkey)%7 as kind,
    translate(concat(md5(cast(l_orderkey as STR)),md5(cast(l_linenumber as STR))),'0123456789abcdef','+5?DGHIIIIIII!5?') as marks,
    b, translate(substr(b,12,1),'ACGTN','CGTAA') as alt
  from lineitem join (select p_partkey, substr(translate(concat(md5(concat('x',cast(p_partkey as STR))),md5(concat('y',cast(p_partkey as STR))),
      md5(concat('z',cast(p_partkey as STR))),md5(concat('w',cast(p_partkey as STR)))),'0123456789abcdef','ACGTACGTACGTACGN'),1,cast(40+p_size as int)) as b from part) p on p_partkey=l_partkey) x""",
    ),
    "dv_features": (
        ["lineitem"],
        """select concat('ctg_', cast(l_partkey as STR)) as seqid, case when l_linenumber%3=0 then 'gene' else 'CDS' end as type,
  cast(1+l_suppkey%30 as bigint) as start, cast(1+l_suppkey%30+3*(5+l_linenumber) as bigint) as stop,
  case when l_orderkey%2=0 then '+' else '-' end as strand, cast(l_orderkey as bigint) as feature_id,
  cast(l_linenumber as bigint) as line
from lineitem""",
    ),
}

#: Derived tables of sequences: a row of a few bytes becomes a text, which operators cut into k-mers.
TEXTS = {"dv_reads", "dv_contigs"}
#: Rows of a partition of these; and partitions for each core at most.
SPREAD_ROWS, SPREAD_WAVES = 5_000, 256


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt by their first column: a file of a few MB is one task, whatever its rows grow to."""
    most = SPREAD_WAVES * df.sparkSession.sparkContext.defaultParallelism
    n = min(-(-df.count() // SPREAD_ROWS), most)
    return df.repartition(n, df.columns[0]) if n > df.rdd.getNumPartitions() else df


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Driver tables or derived ones. What is derived meets others by a shuffle: its files say nothing of its size."""
    out = []
    for n in names:
        if n not in DERIVED:
            out.append(spark.read.parquet(f"{sf_dir}/{n}.parquet"))
            continue
        sources, sql = DERIVED[n]
        text = sql.replace("STR", "string")
        for s in sources:
            text = text.replace(f"from {s}", f"from {{{s}}}").replace(f"join {s}", f"join {{{s}}}")
        given = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in sources}
        out.append(spark.sql(text, **{s: (spread(d) if n in TEXTS else d).hint("merge") for s, d in given.items()}))
    return out


def duck(*names: str) -> str:
    """A WITH clause of the derived tables for DuckDB."""
    return "with recursive " + ",\n".join(f"{n} as ({DERIVED[n][1].replace('STR', 'varchar')})" for n in names) + "\n"
