"""Queries of joins, aggregates, windows, sets, graphs, similarity and streaming flows, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import aggregates as ag
from strandlake.operators import graphs as gr
from strandlake.operators import joins as jo
from strandlake.operators import sets as st
from strandlake.operators import similarity as si
from strandlake.operators import windows as wi
from strandlake.plans.queries_rows import query, rc
from strandlake.sources.shared import stored
from strandlake.streaming import flows


def km(name: str, source: str, key: str, k: int, canonical: bool = True) -> str:
    """A DuckDB CTE of k-mer rows (key, pos, kmer)."""
    x = f"substr(bases,(i+1)::int,{k})"
    c = f"least({x},{rc(x)})" if canonical else x
    return f"{name} as (select {key}, i as pos, {c} as kmer from (select *, unnest(range(0,greatest(0,length(bases)-{k}+1))) as i from {source}) where not regexp_matches({x},'[^ACGT]'))"


def vectors(e):
    """All components of the vectors as columns, with a label of two values; and their names."""
    names = [f"f{i}" for i in range(e.select(F.max(F.size("embedding"))).first()[0])]
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(names)], (F.col("label") % 2).cast("double").alias("label")), names


# -- joins ------------------------------------------------------------------------------------------------------


@query("repair_pairs", "dv_reads", sql="select 'p' || (ordinal//2)::varchar as key, max(case when ordinal%2=0 then bases end) as b1, max(case when ordinal%2=1 then bases end) as b2 from dv_reads where ordinal%11<>3 group by 1 having count(*)=2")
def _(r):
    rows = r.where("ordinal % 11 <> 3").withColumns({"name": F.concat(F.lit("p"), F.floor(F.col("ordinal") / 2).cast("string"), F.lit("/"), (F.col("ordinal") % 2 + 1).cast("string")), "pair": (F.col("ordinal") % 2 + 1).cast("int")})
    return jo.repair(rows)[0].select("key", F.col("r1.bases").alias("b1"), F.col("r2.bases").alias("b2"))


@query("split_pairs", "dv_contigs", sql="select case when length(bases)>=60 and contig_id%50>=20 then 'pair' when length(bases)>=60 then 'single1' when contig_id%50>=20 then 'single2' else 'bad' end as class, count(*) as n from dv_contigs group by all")
def _(c):
    p = c.select(F.col("bases").alias("bases1"), F.when(F.col("contig_id") % 50 >= 20, F.repeat(F.lit("A"), F.lit(60))).otherwise("C").alias("bases2"))
    return jo.split_pairs(p, 60).groupBy("class").agg(F.count("*").alias("n"))


@query("merge_barcodes", "dv_reads", sql="select a.ordinal, a.name || ':' || b.barcode as name from (select ordinal, 'r' || ordinal::varchar as name from dv_reads) a join (select 'r' || ordinal::varchar as name, barcode from dv_reads where ordinal%3=0) b using(name)")
def _(r):
    n = r.withColumn("name", F.concat(F.lit("r"), F.col("ordinal").cast("string")))
    return jo.merge_barcodes(n.select("ordinal", "name"), n.where("ordinal % 3 = 0")).select("ordinal", "name")


@query("replace_headers", "dv_reads", sql="select ordinal, 'new' || ordinal::varchar || ' ' || name as name from dv_reads")
def _(r):
    new = r.select("ordinal", F.concat(F.lit("new"), F.col("ordinal").cast("string")).alias("name"))
    return jo.replace_headers(r, new, prefix=True).select("ordinal", "name")


@query("rename_ref", "dv_aln", "part", sql="select aln_id, case when p.p_partkey is not null then 'chr' || p.p_partkey::varchar else rname end as rname from dv_aln a left join (select * from part where p_partkey%2=0) p on a.rname='ctg_' || p.p_partkey::varchar")
def _(a, p):
    m = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("ctg_"), F.col("p_partkey").cast("string")).alias("old"), F.concat(F.lit("chr"), F.col("p_partkey").cast("string")).alias("new"))
    return jo.rename_ref(a, m).select("aln_id", "rname")


@query("rename_by_mapping", "dv_contigs", "dv_aln", sql="with v as (select rname, pos%5 as taxid, count(*) as n from dv_aln group by all), b as (select rname, taxid from (select *, row_number() over (partition by rname order by n desc, taxid) as k from v) where k=1), c as (select rname, sum(ref_len) as s from dv_aln group by all) select d.name || printf(' cov_%.6f tid_%d', coalesce(c.s/length(bases),0.0)::double, coalesce(b.taxid,0)::bigint) as renamed from dv_contigs d left join c on c.rname=d.name left join b on b.rname=d.name")
def _(c, a):
    return jo.rename_by_mapping(c.withColumn("length", F.length("bases")), a.withColumn("taxid", F.col("pos") % 5), 6).select("renamed")


@query("merge_tables", "dv_var", sql="with a as (select pos as k, max(chrom || sample || ref) as m from dv_var where sample='s0' group by 1), b as (select pos as k, max(chrom || sample || ref) as m from dv_var where sample='s1' and pos%2=0 group by 1) select coalesce(a.k,b.k) as key, a.m as v, b.m as v_b from a full join b on a.k=b.k")
def _(v):
    rows = v.withColumn("v", F.concat("chrom", "sample", "ref")).select(F.col("pos").alias("k"), "v", "sample").distinct()
    return jo.merge_tables(rows.where("sample = 's0'").drop("sample"), rows.where("sample = 's1' and k % 2 = 0").drop("sample"), "k", "k", "v").select("key", "v", "v_b")


@query("matrix_to_columns", "nation", sql="select a.n_name as \"row\", b.n_name as \"column\", (a.n_nationkey*100+b.n_nationkey)::bigint as value_a, (a.n_nationkey+b.n_nationkey)::bigint as value_b from nation a join nation b on b.n_name<a.n_name")
def _(n):
    names = n.select("n_name", "n_nationkey")
    keys = [r["n_name"] for r in names.orderBy("n_nationkey").collect()]
    cell = lambda f: names.select(F.col("n_name").alias("row"), *[f(i).cast("bigint").alias(k) for i, k in enumerate(keys)])
    return jo.matrices_to_columns(cell(lambda i: F.col("n_nationkey") * 100 + i), cell(lambda i: F.col("n_nationkey") + i), "row")


@query("transpose", "region", sql="select 'a' as \"column\", " + ", ".join(f"sum(case when r_regionkey={i} then r_regionkey+1 end)::bigint as k{i}" for i in range(5)) + " from region union all select 'b', " + ", ".join(f"sum(case when r_regionkey={i} then r_regionkey*2 end)::bigint" for i in range(5)) + " from region")
def _(r):
    t = r.select(F.concat(F.lit("k"), F.col("r_regionkey").cast("string")).alias("id"), (F.col("r_regionkey") + 1).cast("bigint").alias("a"), (F.col("r_regionkey") * 2).cast("bigint").alias("b"))
    return jo.transpose(t, "id", [f"k{i}" for i in range(5)])


@query("barcode_assign", "dv_reads", sql="with o as (select distinct case when ordinal%5=0 then 'T' || substr(barcode,2) else barcode end as barcode from dv_reads), e as (select distinct barcode as e from dv_reads where ordinal%24<16), p as (select barcode, e, hamming(barcode,e) as d from o, e), r as (select *, row_number() over (partition by barcode order by d, e) as k, lead(d) over (partition by barcode order by d, e) as nx from p) select barcode, case when d<=1 and coalesce(nx,1048576)-d>=1 then e end as assigned, d::bigint as distance from r where k=1")
def _(r):
    o = r.select(F.when(F.col("ordinal") % 5 == 0, F.concat(F.lit("T"), F.substring("barcode", 2, 10))).otherwise(F.col("barcode")).alias("barcode"))
    return jo.assign_barcodes(o, r.where("ordinal % 24 < 16").select("barcode"))


@query("barcode_assign_dual", "dv_reads", sql="with o as (select distinct case when ordinal%5=0 then 'T' || substr(barcode,2) when ordinal%7=0 then substr(barcode,1,7) || 'A' else barcode end as b from dv_reads), e as (select distinct barcode as e from dv_reads), p as (select substr(b,1,4) || '+' || substr(b,5) as barcode, substr(e,1,4) || '+' || substr(e,5) as e, hamming(substr(b,1,4),substr(e,1,4)) as d1, hamming(substr(b,5),substr(e,5)) as d2 from o, e), r as (select *, row_number() over (partition by barcode order by d1+d2, e) as k, lead(d1+d2) over (partition by barcode order by d1+d2, e) as nx from p) select barcode, case when d1<=1 and d2<=1 and d1+d2<=1 and coalesce(nx,1048576)-d1-d2>=1 then e end as assigned, (d1+d2)::bigint as distance from r where k=1")
def _(r):
    dual = lambda c: F.concat(F.left(c, F.lit(4)), F.lit("+"), F.substring(c, 5, 4))
    seen = F.when(F.col("ordinal") % 5 == 0, F.concat(F.lit("T"), F.substring("barcode", 2, 10))).when(F.col("ordinal") % 7 == 0, F.concat(F.left("barcode", F.lit(7)), F.lit("A"))).otherwise(F.col("barcode"))
    return jo.assign_barcodes(r.select(dual(seen).alias("barcode")), r.select(dual(F.col("barcode")).alias("barcode")), 1, 1, split_at=4, max_sum=1)


@query("cut_gff", "dv_contigs", "dv_features", sql=f"select f.feature_id, f.line, case when strand='-' then {rc('substr(bases,start::int,(stop-start+1)::int)')} else substr(bases,start::int,(stop-start+1)::int) end as bases from dv_features f join dv_contigs c on c.name=f.seqid where type='CDS'")
def _(c, f):
    return jo.cut_gff(c, f, ["CDS"]).select("feature_id", "line", "bases")


@query("cut_primers", "dv_reads", sql="select ordinal, substr(bases,11+(ordinal%7)::int,(50+ordinal%9-10-ordinal%7-1)::int) as bases from dv_reads")
def _(r):
    n = r.withColumn("name", F.col("ordinal").cast("string"))
    hit = lambda s: n.select("name", s.alias("start"), s.alias("stop"))
    return jo.cut_primers(n, hit(10 + F.col("ordinal") % 7), hit(50 + F.col("ordinal") % 9)).select("ordinal", "bases")


@query("interval_overlap", "dv_features", sql="with a as (select * from dv_features where line=1), b as (select * from dv_features where line=2) select a.seqid, count(*) as n, sum(a.start*b.stop)::bigint as s from a join b on a.seqid=b.seqid and a.start<=b.stop and b.start<=a.stop group by all")
def _(f):
    f = f.select("seqid", "start", "stop", "line", "feature_id")
    j = jo.interval_join(f.where("line = 1"), f.where("line = 2"), "seqid", 16)
    return j.groupBy("seqid").agg(F.count("*").alias("n"), F.sum(F.col("start") * F.col("stop_b")).alias("s"))


DEPTH = "e as (select rname as contig, pos as p, 1 as d from dv_aln union all select rname, pos+ref_len, -1 from dv_aln), e2 as (select contig, p, sum(d) as d from e group by all having sum(d)<>0), s as (select contig, p as start, sum(d) over (partition by contig order by p)::bigint as depth, (lead(p) over (partition by contig order by p))-1 as stop from e2), seg as (select contig, start, stop, depth from s where depth>0)"


@query("coverage_at_variant", "dv_var", "dv_aln", sql=f"with {DEPTH}, b as (select contig as chrom, unnest(range(start,stop+1)) as pos, depth from seg), v as (select distinct chrom, pos, ref, alt from dv_var) select v.chrom, v.pos, v.ref, v.alt, coalesce(b.depth,0)::double as coverage from v left join b using(chrom,pos)")
def _(v, a):
    depth = ag.depth_per_base(ag.depth_segments(a)).withColumnRenamed("contig", "chrom")
    return jo.variant_coverage(v.select("chrom", "pos", "ref", "alt"), depth).withColumn("coverage", F.col("coverage").cast("double"))


@query("filter_bad_vars", "dv_var", sql="with v as (select *, (pos*7+ascii(ref))%20 as e from dv_var), s as (select chrom,pos,alt from v where ref<>alt group by all having count(*)>=20) select sample || chrom as \"read\", count(*) as unsupported from v where ref<>alt and e>=5 and not exists (select 1 from s where s.chrom=v.chrom and s.pos=v.pos and s.alt=v.alt) group by 1 having count(*)>2")
def _(v):
    rows = v.where("ref <> alt").withColumns({"read": F.concat("sample", "chrom"), "end_distance": (F.col("pos") * 7 + F.ascii("ref")) % 20})
    good = rows.groupBy("chrom", "pos", "alt").agg(F.count("*").alias("n")).where("n >= 20")
    return jo.filter_sam_vars(rows.select("read", "chrom", "pos", "alt", "end_distance"), good, border=5)


@query("mapping_diff", "dv_aln", sql="select aln_id as \"read\" from dv_aln where mapq<8 and aln_id not in (select aln_id from dv_aln where pos%2=1)")
def _(a):
    t = a.select(F.col("aln_id").alias("read"), "rname", "pos")
    return jo.compare_sam(t, t.withColumn("pos", F.when((F.col("pos") % 2 == 0), F.col("pos") + 1).otherwise(F.col("pos"))), t).join(a.where("mapq < 8").select(F.col("aln_id").alias("read")), "read")


@query("intersection_hist", "dv_reads", "dv_contigs", sql=f"with {km('a','dv_reads','ordinal',5)}, {km('b','dv_contigs','contig_id',5)}, x as (select kmer, count(*) as n from a group by all), y as (select kmer, count(*) as n from b group by all) select coalesce(x.n,0) as depth_a, coalesce(y.n,0) as depth_b, count(*) as kmers from x full join y using(kmer) group by all")
def _(r, c):
    return jo.kmer_intersection(ag.kmer_count(r, 5), ag.kmer_count(c, 5))


SEAL = f"with {km('r','dv_reads','ordinal',9)}, {km('c','dv_contigs','name',9)}, k as (select distinct name, kmer from c), h as (select ordinal, name, count(*) as hits from r join k using(kmer) group by all), t as (select ordinal, count(*) as kmers from r group by all), m as (select *, row_number() over (partition by ordinal order by hits desc, name) as rn from h where hits>=2)"


@query("kmer_classify", "dv_reads", "dv_contigs", sql=SEAL + " select m.ordinal as \"read\", name as ref, hits, kmers from m join t using(ordinal) where rn=1")
def _(r, c):
    return jo.seal(r, c, 9, min_hits=2, ambiguous="first")


@query("split_by_reference", "dv_reads", "dv_contigs", sql=SEAL + " select name as ref, count(*) as reads from m where rn=1 group by all")
def _(r, c):
    return jo.seal(r, c, 9, min_hits=2, ambiguous="first").groupBy("ref").agg(F.count("*").alias("reads"))


@query("kmer_classify_near", "dv_contigs", sql=f"with {km('r','(select contig_id, substr(bases,1,17) || translate(substr(bases,18,1),chr(65) || chr(67) || chr(71) || chr(84),chr(67) || chr(71) || chr(84) || chr(65)) || substr(bases,19,16) as bases from dv_contigs)','contig_id',21)}, {km('c','dv_contigs','name',21)}, y as (select name, substr(kmer,1,(i-1)::int) || b || substr(kmer,(i+1)::int) as x from c, (select unnest(range(1,22)) as i), (select unnest(['A','C','G','T']) as b)), k as (select distinct name, least(x,{rc('x')}) as kmer from y), h as (select contig_id, name, count(*) as hits from r join k using(kmer) group by all) select contig_id as \"read\", name as ref, hits from h")
def _(c):
    wrong = F.concat(F.left("bases", F.lit(17)), F.translate(F.substring("bases", 18, 1), "ACGT", "CGTA"), F.substring("bases", 19, 16))
    return jo.seal(c.select("contig_id", wrong.alias("bases")), c, 21, ambiguous="all", read_id="contig_id", hdist=1, clearzone=1 << 20).select("read", "ref", "hits")


@query("add_ssu", "dv_tax", "dv_contigs", sql="select t.id as taxid, c.bases as ssu from dv_tax t left join dv_contigs c on c.contig_id=t.id")
def _(t, c):
    return jo.add_ssu(t.select(F.col("id").alias("taxid")), c.select(F.col("contig_id").alias("taxid"), "bases"))


@query("kmer_contam_filter", "dv_reads", "dv_contigs", sql=f"with {km('r','dv_reads','ordinal',9)}, {km('c','dv_contigs','name',9)}, h as (select ordinal,pos from r where kmer in (select kmer from c)), g as (select ordinal, pos - row_number() over (partition by ordinal order by pos) as g from h), u as (select ordinal, count(*) as n from g group by ordinal, g) select ordinal as \"read\", max(n) as longest from u group by all having max(n)>=2")
def _(r, c):
    return jo.bloom_filter_reads(r, c, 9, 2)


ENDS = "case when strand='-' then start else stop end as e, case when strand='-' then stop else start end as s"


@query("gff_compare", "dv_features", sql=f"with q as (select seqid,strand,type,e,min(s) as s from (select seqid,strand,type,{ENDS} from dv_features where line<=3) group by all), t as (select seqid,strand,type,e,min(s) as t from (select seqid,strand,type,{ENDS} from dv_features where line>=3) group by all) select count(*) filter (where s is not null and t is not null) as tp_stop, count(*) filter (where t is null) as fp_stop, count(*) filter (where s is null) as fn_stop, count(*) filter (where s=t) as tp_start, count(*) filter (where s is not null and s is distinct from t) as fp_start, count(*) filter (where t is not null and s is distinct from t) as fn_start from q full join t using(seqid,strand,type,e)")
def _(f):
    one = lambda d: d.groupBy("seqid", "strand", "type", F.when(F.col("strand") == "-", F.col("start")).otherwise(F.col("stop")).alias("e")).agg(F.min(F.when(F.col("strand") == "-", F.col("stop")).otherwise(F.col("start"))).alias("s")).select("seqid", "type", "strand", F.when(F.col("strand") == "-", F.col("e")).otherwise(F.col("s")).alias("start"), F.when(F.col("strand") == "-", F.col("s")).otherwise(F.col("e")).alias("stop"))
    return jo.compare_gff(one(f.where("line <= 3")), one(f.where("line >= 3")))


@query("false_positive_list", "dv_features", sql="select feature_id, line from dv_features a where line=2 and not exists (select 1 from dv_features b where b.line=4 and a.seqid=b.seqid and a.start=b.start and a.stop=b.stop and a.strand=b.strand)")
def _(f):
    return jo.false_positives(f.where("line = 2"), f.where("line = 4").select("seqid", "start", "stop", "strand")).select("feature_id", "line")


@query("label_from_truth", "dv_features", sql="with k as (select *, seqid || start::varchar || '-' || stop::varchar || strand as k from dv_features) select label, count(*) as n from (select case when k in (select k from k where line=1) then 1 else 0 end::bigint as label from k where k in (select k from k where line=1) or k not in (select k from k where line in (1,2))) group by all")
def _(f):
    return jo.build_training_set(f, f.where("line = 2"), f.where("line = 1")).groupBy("label").agg(F.count("*").alias("n"))


# -- aggregates -------------------------------------------------------------------------------------------------


CNT = "sum(length(bases)-length(replace(bases,'{0}','')))::bigint"


@query("basic_counts", "dv_reads", sql="select barcode, count(*) as reads, sum(length(bases))::bigint as bases, " + ", ".join(f"{CNT.format(s)} as {s.lower()}" for s in "ACGTN") + ", 0::bigint as other, round((" + CNT.format("G") + "+" + CNT.format("C") + ")/(" + "+".join(CNT.format(s) for s in "ACGT") + "),6) as gc from dv_reads group by all")
def _(r):
    return ag.count_gc(r, ["barcode"])


@query("assembly_stats", "dv_contigs", sql="with c as (select contig_id%5 as asm, length(bases) as len, bases from dv_contigs), r as (select *, sum(len) over (partition by asm order by len desc, bases rows unbounded preceding) as s, row_number() over (partition by asm order by len desc, bases) as k, sum(len) over (partition by asm) as t from c) select asm, count(*) as contigs, max(t)::bigint as total, max(len) as longest, max(len) filter (where s>=0.5*t) as n50, min(k) filter (where s>=0.5*t) as l50, max(len) filter (where s>=0.9*t) as n90, min(k) filter (where s>=0.9*t) as l90, round(sum(length(bases)-length(translate(bases,'GC','')))/max(t),6) as gc, round(sum(length(bases)-length(replace(bases,'N','')))/max(t),6) as gap from r group by asm")
def _(c):
    return ag.assembly_stats(c.withColumn("asm", F.col("contig_id") % 5), "asm")


@query("length_hist", "dv_contigs", sql="with h as (select least(length(bases),80)//10*10 as bin, count(*) as reads, sum(length(bases))::bigint as bases from dv_contigs group by 1) select *, (sum(reads) over (order by bin desc))::bigint as at_least, round((sum(reads) over (order by bin desc))/(sum(reads) over ()),6) as share_at_least from h")
def _(c):
    return ag.length_hist(c, 10, 80)


@query("gc_hist", "dv_reads", sql="select (length(bases)-length(translate(bases,'GC','')))*20//(length(bases)-length(translate(bases,'ACGT',''))) as bin, count(*) as reads from dv_reads group by 1")
def _(r):
    return ag.gc_hist(r, 20)


@query("quality_hist", "dv_reads", sql="with q as (select i-1 as pos, ascii(quals[i])-33 as q from (select quals, unnest(range(1,length(quals)+1)) as i from dv_reads)) select pos, count(*) as reads, round(avg(q),6) as mean, min(q)::bigint as low, quantile_cont(q,0.25)::double as q1, quantile_cont(q,0.5)::double as median, quantile_cont(q,0.75)::double as q3, max(q)::bigint as high from q group by all")
def _(r):
    return ag.quality_by_position(r)


@query("quality_counts", "dv_reads", sql="select (ascii(c)-33)::bigint as q, count(*) as bases from (select unnest(string_split(quals,'')) as c from dv_reads) group by all")
def _(r):
    return ag.quality_counts(r)


@query("average_quality_hist", "dv_reads", sql="select floor(round(-10*log10(list_sum(list_transform(string_split(quals,''), lambda c: pow(10.0, -(ascii(c)-33)/10.0)))/length(quals)),6))::bigint as q, count(*) as reads from dv_reads group by all")
def _(r):
    return ag.average_quality_hist(r)


@query("base_by_position", "dv_reads", sql="select i-1 as pos, " + ", ".join(f"count(*) filter (where bases[i]='{s}') as {s.lower()}" for s in "ACGTN") + " from (select bases, unnest(range(1,length(bases)+1)) as i from dv_reads) group by all")
def _(r):
    return ag.base_by_position(r)


@query("edit_hists", "dv_aln", sql="select 1+pos%3+2 as value, count(*) as n from dv_aln group by all")
def _(a):
    from strandlake.plans.queries_rows import sam_like

    return ag.edit_hists(sam_like(a), "errors")


@query("match_by_position", "dv_aln", sql="with l as (select ref_len as m, 1+pos%3 as x from dv_aln), u as (select m, x, unnest(range(0,m+x+6)) as pos from l) select pos, count(*) filter (where pos<m) as match, count(*) filter (where pos>=m and pos<m+x) as sub, count(*) filter (where pos>=m+x and pos<m+x+2) as ins, count(*) filter (where pos>=m+x+2) as clip from u group by all")
def _(a):
    from strandlake.plans.queries_rows import sam_like

    return ag.match_by_position(sam_like(a))


@query("polymer_hist", "dv_contigs", sql="with r as (select unnest(regexp_extract_all(bases,'(A+|C+|G+|T+)')) as r from dv_contigs), h as (select r[1] as base, length(r) as length, count(*) as runs from r group by all) select *, (sum(runs) over (partition by base order by length desc))::bigint as at_least from h")
def _(c):
    return ag.polymer_hist(c)


@query("kmer_count", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',6)} select kmer, count(*) as count from k group by all having count(*)>=3")
def _(r):
    return ag.kmer_count(r, 6, min_count=3)


@query("kmer_hist", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',5)}, c as (select kmer, count(*) as n from k group by all) select n as depth, count(*) as kmers from c group by all")
def _(r):
    return ag.kmer_hist(ag.kmer_count(r, 5))


@query("kmer_spectrum_per_seq", "dv_contigs", sql=f"with {km('k','dv_contigs','contig_id',4)}, n as (select contig_id, pos//20 as \"window\", kmer, count(*) as n from k group by all) select *, round(n/(sum(n) over (partition by contig_id, \"window\")),6) as share from n")
def _(c):
    return ag.tetramer_freq(c, "contig_id", 4, 20)


@query("common_kmers", "dv_contigs", sql=f"with {km('k','dv_contigs','contig_id',2,False)}, n as (select contig_id, kmer, count(*) as count from k group by all), r as (select *, row_number() over (partition by contig_id order by count desc, kmer) as rank from n) select * from r where rank<=3")
def _(c):
    return ag.common_kmers(c, "contig_id", 2, 3)


SH = "round(coalesce(count(*) filter (where kmer in ({0}))/nullif(count(kmer),0),0),6)"


@query("scalar_metrics", "dv_contigs", sql=f"with {km('k','dv_contigs','contig_id',2,False)}, g as (select contig_id, length(bases)-length(replace(bases,'G','')) as g, length(bases)-length(replace(bases,'C','')) as c, length(bases)-length(translate(bases,'ACGT','')) as called from dv_contigs) select g.contig_id, round((any_value(g)+any_value(c))/any_value(called),6) as gc, round(coalesce(abs(any_value(g)-any_value(c))/nullif(any_value(g)+any_value(c),0),0),6) as skew, " + ", ".join(f"{SH.format(v)} as {n}" for n, v in (("hh", "'AA','TT','CC','GG'"), ("pp", "'AG','GA','CT','TC'"), ("aaat", "'AA','AT','TA','TT'"), ("cccg", "'CC','CG','GC','GG'"), ("caga", "'CA','GA'"))) + " from g left join k using(contig_id) group by all")
def _(c):
    return ag.scalars(c, "contig_id")


@query("gc_intervals", "dv_contigs", sql="with s as (select name, p*30 as start, substr(bases,(p*30+1)::int,30) as b from (select *, unnest(range(0, ceil(length(bases)/30.0)::bigint)) as p from dv_contigs)) select name, start, round(coalesce((length(b)-length(translate(b,'GC','')))/nullif(length(b)-length(translate(b,'ACGT','')),0),0),6) as gc from s")
def _(c):
    return ag.gc_intervals(c, 30)


@query("distinct_kmers_multi", "dv_reads")
def _(r):
    return ag.kmer_cardinality(r, [7, 15, 31], 2)


@query("count_min_depth", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',9)}, c as (select kmer, count(*) as n from k group by all) select ordinal, count(*) as kmers, quantile_cont(n,0.5)::double as median_depth from k join c using(kmer) group by all")
def _(r):
    return ag.kmer_depth(r, 9)


@query("unique_kmer_curve", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',9)}, d as (select distinct ordinal, kmer from k), f as (select kmer, min(ordinal) as o from d group by all), a as (select ordinal//500 as bin, count(*) as kmers from d group by all), b as (select o//500 as bin, count(*) as fresh from f group by all) select bin, kmers, coalesce(fresh,0) as fresh from a left join b using(bin)")
def _(r):
    return ag.uniqueness_curve(r, 9, 500)


@query("normalize_depth", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',9)}, c as (select kmer, count(*) as n from k group by all), d as (select ordinal, quantile_cont(n,0.54) as d from k join c using(kmer) group by all) select ordinal, round(d,6)::double as depth, d>=5 and ('0x' || substr(md5(ordinal::varchar),1,8))::bigint/4294967296.0 < 12/d as keep from d")
def _(r):
    return ag.normalize(r, 9, 12, 5)


#: Reads of 40 templates, so that depths are high, with a wrong base in some of them.
PLANTED = "t as (select ordinal, bases from dv_reads where ordinal<40), b as (select r.ordinal, t.bases, case when r.ordinal%11=7 then 1+(r.ordinal*7)%90 end as spot from dv_reads r join t on t.ordinal=r.ordinal%40), p as (select ordinal, case when spot is null then bases else substr(bases,1,(spot-1)::int) || translate(substr(bases,spot::int,1),'ACGT','CGTA') || substr(bases,(spot+1)::int) end as bases from b)"


def planted(r):
    t = r.where("ordinal < 40").select(F.col("ordinal").alias("k"), F.col("bases").alias("b"))
    at = F.when(F.col("ordinal") % 11 == 7, (1 + (F.col("ordinal") * 7) % 90).cast("int"))
    rows = r.select("ordinal", (F.col("ordinal") % 40).alias("k"), at.alias("at")).join(t, "k")
    wrong = F.concat(F.substring("b", F.lit(1), F.col("at") - 1), F.translate(F.substring("b", F.col("at"), F.lit(1)), "ACGT", "CGTA"), F.substring("b", F.col("at") + 1, F.length("b")))
    return rows.select("ordinal", F.when(F.col("at").isNull(), F.col("b")).otherwise(wrong).alias("bases"))


@query("kmer_error_filter", "dv_reads", sql=f"""with {PLANTED}, {km('q','p','ordinal',15,False)}, c as (select kmer, count(*) as n from q group by all),
g as (select ordinal, pos, kmer, pos - row_number() over (partition by ordinal order by pos) as g from q join c using(kmer) where n<=2),
u as (select ordinal, count(*) as n, min(pos) as first, max(pos) as last, min_by(kmer,pos) as a, max_by(kmer,pos) as z from g group by ordinal, g),
v as (select u.*, n=15 or (n<15 and first=0) as head from u join p using(ordinal) where n=15 or (n<15 and (first=0 or last=length(bases)-15))),
y as (select ordinal, case when head then last else first+14 end as pos, case when head then z[1] else a[15] end as old, new, case when head then new || z[2:] else a[:14] || new end as kmer from v, (select unnest(['A','C','G','T']) as new)),
ok as (select y.*, count(*) over (partition by ordinal, pos) as k from y join c using(kmer) where n>=5 and new<>old) select ordinal, pos::bigint as pos, old, new from ok where k=1""")
def _(r):
    return ag.ecc_by_depth(planted(r), 15)


@query("kmer_error_discard", "dv_reads", sql=f"with {PLANTED}, {km('q','p','ordinal',15)}, c as (select kmer, count(*) as n from q group by all), bad as (select ordinal from q join c using(kmer) group by all having count(*) filter (where n<=2)/count(*)>0.1) select ordinal from p where ordinal not in (select ordinal from bad)")
def _(r):
    return ag.discard_weak(planted(r), 15, most=0.1).select("ordinal")


@query("depth_per_base", "dv_aln", sql=f"with {DEPTH} select contig, unnest(range(start,stop+1)) as pos, depth from seg")
def _(a):
    return ag.depth_per_base(ag.depth_segments(a)).withColumn("depth", F.col("depth").cast("bigint"))


@query("covstats", "dv_aln", "dv_contigs", sql=f"with {DEPTH}, v as (select contig, sum(stop-start+1) as covered, sum((stop-start+1)*depth) as total, sum((stop-start+1)*depth*depth) as sq, max(depth) as md from seg group by all), t as (select rname as contig, count(*) filter (where strand=0) as p, count(*) filter (where strand=1) as m, round(sum((pos%10)/10.0*ref_len)/sum(ref_len),6) as rg from dv_aln group by all), bs as (select contig, unnest(range(start,stop+1)) as pos, depth from seg union all select name, unnest(range(1,(greatest(0,length(bases)-coalesce(covered,0))+1)::bigint)), 0 from dv_contigs left join v on v.contig=name), md as (select contig, quantile_disc(depth,0.5)::bigint as md from bs group by all) select c.name as contig, coalesce(md.md,0) as median_fold, coalesce(rg,0) as read_gc, length(bases) as length, round((length(bases)-length(translate(bases,'GC','')))/(length(bases)-length(translate(bases,'ACGT',''))),6) as ref_gc, round(coalesce(total,0)/length(bases),6) as avg_fold, coalesce(covered,0)::bigint as covered, round(100*least(coalesce(covered,0),length(bases))/length(bases),6) as covered_percent, coalesce(v.md,0)::bigint as max_depth, coalesce(p,0) as plus_reads, coalesce(m,0) as minus_reads, round(sqrt(greatest(coalesce(sq,0)/length(bases)-(coalesce(total,0)/length(bases))*(coalesce(total,0)/length(bases)),0)),6) as std_dev from dv_contigs c left join v on v.contig=c.name left join t on t.contig=c.name left join md on md.contig=c.name")
def _(a, c):
    return ag.covstats(ag.depth_segments(a), c, a.withColumn("gc", (F.col("pos") % 10) / 10.0))


@query("coverage_binned", "dv_aln", sql=f"with {DEPTH}, b as (select contig, unnest(range(start,stop+1)) as pos, depth from seg) select contig, (pos-1)//10 as bin, round(sum(depth)/10.0,6) as depth from b group by all")
def _(a):
    return ag.bincov(ag.depth_segments(a), 10)


@query("range_coverage", "dv_aln", sql=f"with {DEPTH}, b as (select contig, unnest(range(start,stop+1)) as pos from seg where depth>=20), g as (select contig, pos, pos - row_number() over (partition by contig order by pos) as g from b) select contig, min(pos) as start, max(pos) as stop from g group by contig, g")
def _(a):
    return ag.rangecov(ag.depth_segments(a), 20)


@query("depth_hist", "dv_aln", sql=f"with {DEPTH} select depth, sum(stop-start+1)::bigint as bases from seg group by all")
def _(a):
    return ag.cov_hist(ag.depth_segments(a)).withColumn("depth", F.col("depth").cast("bigint"))


@query("coverage_summary", "dv_aln", sql=f"with {DEPTH} select contig, round(sum((stop-start+1)*depth)/80,6) as mean, " + ", ".join(f"round(100.0*sum(case when depth>={d} then stop-start+1 else 0 end)/80,6)::double as x{d}" for d in (1, 2, 3, 4, 5, 10, 20)) + " from seg group by all")
def _(a):
    return ag.coverage_summary(ag.depth_segments(a), "contig", 80)


@query("merge_covstats", "dv_aln", sql="with c as (select rname || ' otu' || (pos%4)::varchar as name, avg(mapq) as fold, sum(ref_len) as length, avg(strand) as ref_gc, count(*) filter (where strand=0) as plus, count(*) filter (where strand=1) as minus, avg(pos) as read_gc from dv_aln group by rname, pos%4) select split_part(name,' ',2) as otu, round(sum(fold*length)/sum(length),6) as fold, round(sum(ref_gc*length)/sum(length),6) as ref_gc, round(sum(read_gc*(plus+minus))/sum(plus+minus),6) as read_gc, sum(length)::bigint as length, sum(plus)::bigint as plus, sum(minus)::bigint as minus from c group by 1")
def _(a):
    c = a.groupBy("rname", (F.col("pos") % 4).alias("o")).agg(F.avg("mapq").alias("fold"), F.sum("ref_len").alias("length"), F.avg("strand").alias("ref_gc"), F.count_if(F.col("strand") == 0).alias("plus"), F.count_if(F.col("strand") == 1).alias("minus"), F.avg("pos").alias("read_gc"))
    return ag.merge_otu(c.withColumn("name", F.concat("rname", F.lit(" otu"), F.col("o").cast("string"))))


@query("no_call_regions", "dv_aln", sql=f"with {DEPTH}, b as (select contig, case when depth<5 then 'none' else 'half' end as level, unnest(range(start,stop+1)) as pos from seg where depth<12), g as (select *, pos - row_number() over (partition by contig, level order by pos) as g from b) select contig, level, min(pos) as start, max(pos) as stop from g group by contig, level, g")
def _(a):
    return ag.nocall_intervals(ag.depth_segments(a), 5, 12)


@query("est_capture", "dv_aln", sql="select rname as est, count(distinct rf) as scaffolds, min(pos) as intron_min, max(pos) as intron_max, round(avg(pos),6) as intron_mean, case when sum(ref_len)/900.0>=1 then 'all' when sum(ref_len)/900.0>=0.5 then 'most' when sum(ref_len)>0 then 'some' else 'zero' end as class from dv_aln group by all")
def _(a):
    return ag.est_stats(a.select(F.col("rname").alias("est"), F.lit(900).alias("est_length"), F.col("ref_len").alias("aligned"), F.col("rf").alias("scaffold"), F.col("pos").alias("intron")))


@query("call_variants", "dv_var", "dv_aln", sql=f"with {DEPTH}, o as (select chrom, pos, ref, alt, qual::double%40 as q, pos%2 as st from dv_var where ref<>alt), g as (select chrom, pos, ref, alt, count(*) as c, sum(q) as qs, max(q) as qm, count(*) filter (where st=0) as plus from o group by all), d as (select g.*, coalesce(depth,0) as depth from g left join seg on seg.contig=chrom and pos between start and stop), x as (select *, round(c/greatest(depth,c),6) as fraction, 1.0-c/greatest(depth,c)*least(1.0,qs/c/40)*least(1.0,greatest(depth,c)/10) as doubt from d), y as (select *, round(case when doubt<=1e-6 then 60.0 else least(60.0,-10.0*log10(doubt)) end,6)::double as score from x) select chrom, pos, ref, alt, c as count, plus, fraction, score from y where c>=2 and fraction>=0.1 and score>=1")
def _(v, a):
    obs = v.where("ref <> alt").select("chrom", "pos", "ref", "alt", (F.col("qual") % 40).alias("base_qual"), F.lit(30).alias("mapq"), (F.col("pos") % 2).alias("strand"), F.lit(20).alias("end_distance"))
    return ag.call_variants(obs, ag.depth_segments(a), ploidy=2).select("chrom", "pos", "ref", "alt", "count", "plus", "fraction", "score")


@query("merge_samples", "dv_var", sql="select chrom, pos, ref, alt, count(*) as n, round(max(qual),6)::double as qual, arg_max(sample, {'q': qual, 's': sample}) as best_sample, array_to_string(list_sort(list(distinct sample)),',') as samples from dv_var group by all")
def _(v):
    return ag.merge_samples(v).withColumn("qual", F.col("qual").cast("double"))


@query("consensus", "dv_contigs", "dv_var", sql="with w as (select chrom as contig, pos, alt as base, sum(1+pos%3) as w from dv_var group by all), t as (select contig, pos, sum(w) as total, arg_max(base, {'w': w, 'b': base}) as top from w group by all), u as (select name, bases, unnest(range(1,length(bases)+1)) as i from dv_contigs), x as (select u.name, u.i, u.bases[u.i] as b, t.total, t.top, coalesce(w.w,0) as own from u left join t on t.contig=u.name and t.pos=u.i left join w on w.contig=u.name and w.pos=u.i and w.base=u.bases[u.i]) select name as contig, string_agg(case when total is null or own*2>=total then b else top end, '' order by i) as bases from x group by all")
def _(c, v):
    votes = v.select(F.col("chrom").alias("contig"), "pos", F.col("alt").alias("base"), (1 + F.col("pos") % 3).alias("weight"))
    return ag.consensus(votes, c.select("name", "bases"))


@query("apply_variants", "dv_contigs", "dv_var", sql="with g as (select chrom, pos, ref, alt, count(*) as n from dv_var where ref<>alt group by all), b as (select chrom, pos, alt from (select *, row_number() over (partition by chrom, pos order by n desc, ref, alt) as k from g) where k=1), u as (select name, bases, unnest(range(1,length(bases)+1)) as i from dv_contigs) select name, string_agg(coalesce(b.alt, bases[i]), '' order by i) as bases from u left join b on b.chrom=name and b.pos=i group by all")
def _(c, v):
    g = v.where("ref <> alt").groupBy("chrom", "pos", "ref", "alt").agg(F.count("*").alias("count"))
    return ag.apply_variants(c.select("name", "bases"), g)


@query("consect", "dv_reads", sql="select ordinal, array_to_string(list_transform(range(1,length(bases)+1), lambda i: case when bases[i]='A' then 'C' else bases[i] end),'') as bases, array_to_string(list_transform(range(1,length(bases)+1), lambda i: case when bases[i] in ('G','N') then quals[i] when bases[i]='A' then greatest(translate(quals[i],'!','+'),translate(quals[i],'5','?')) else greatest(translate(quals[i],'!','+'),translate(quals[i],'5','?'),translate(quals[i],'I','J')) end),'') as quals from dv_reads")
def _(r):
    version = lambda a, b, c, d: r.select("ordinal", F.translate("bases", a, b).alias("bases"), F.translate("quals", c, d).alias("quals"))
    return ag.consect(r, [version("A", "C", "!", "+"), version("AG", "CT", "5", "?"), version("A", "N", "I", "J")])


@query("true_quality", "dv_aln", sql="select mapq as quality, count(*) as bases, sum(case when pos%7=0 then 1 else 0 end)::bigint as errors, round(-10*log10((sum(case when pos%7=0 then 1 else 0 end)+1)/(count(*)+1)),6) as observed from dv_aln group by all")
def _(a):
    return ag.calc_true_quality(a.select(F.col("mapq").alias("quality"), (F.col("pos") % 7 == 0).alias("is_error")))


@query("barcode_counts", "dv_reads", sql="with n as (select barcode, count(*) as count from dv_reads group by all), e as (select distinct barcode as e from dv_reads where ordinal%24<6) select barcode, count, min(hamming(barcode,e))::bigint as hamming, min(levenshtein(barcode,e))::bigint as edit, min(hamming(barcode,e))=0 as valid from n, e group by all")
def _(r):
    return ag.count_barcodes(r, r.where("ordinal % 24 < 6").select("barcode"))


@query("barcode_mismatch_table", "dv_reads", sql="with b as (select case when ordinal%10=0 then substr(barcode,1,4) || (select max(substr(barcode,5)) from dv_reads) else barcode end as barcode from dv_reads), n as (select substr(barcode,1,4) as l, substr(barcode,5) as r, barcode, count(*) as n from b group by all), e as (select distinct barcode, substr(barcode,1,4) as l, substr(barcode,5) as r from dv_reads where ordinal%24<6), v as (select sum(n) as v from n where barcode in (select barcode from e)), ls as (select l, sum(n) as nl from n group by all), rs as (select r, sum(n) as nr from n group by all) select x.l as \"left\", y.r as \"right\", coalesce(n.n,0)::bigint as actual, round(nl*nr/v,6) as chance from (select distinct l from e) x join ls using(l) cross join ((select distinct r from e) z join rs using(r)) y cross join v left join n on n.l=x.l and n.r=y.r where not exists (select 1 from e where e.l=x.l and e.r=y.r)")
def _(r):
    last = r.agg(F.max(F.substring("barcode", 5, 10)).alias("m"))
    b = r.crossJoin(F.broadcast(last)).select(F.when(F.col("ordinal") % 10 == 0, F.concat(F.left("barcode", F.lit(4)), "m")).otherwise(F.col("barcode")).alias("barcode"))
    return ag.analyze_barcodes(b, r.where("ordinal % 24 < 6").select("barcode"), 4)


@query("label_confusion", "dv_aln", sql="with l as (select case when pos%5=0 then null else rf end as a, case when mapq%3=0 then null when mapq%7=0 then 'X' else rf end as b from dv_aln) select coalesce(a,'unknown') as label, count(*) filter (where a=b) as aa, count(*) filter (where a<>b) as ab, count(*) filter (where a is not null and b is null) as au, count(*) filter (where a is null and b is not null) as ua, count(*) filter (where a is null and b is null) as uu from l group by 1")
def _(a):
    rows = a.select(F.when(F.col("pos") % 5 != 0, F.col("rf")).alias("a"), F.when(F.col("mapq") % 3 == 0, None).when(F.col("mapq") % 7 == 0, "X").otherwise(F.col("rf")).alias("b"))
    return ag.compare_labels(rows, "a", "b")


CLOSURE = "clo(id, ancestor, distance) as (select id, id, 0::bigint from dv_tax union all select c.id, t.pid, c.distance+1 from clo c join dv_tax t on t.id=c.ancestor where t.pid<>t.id)"


@query("tax_closure", "dv_tax", sql=f"with {CLOSURE} select * from clo")
def _(t):
    return gr.tax_closure(t)


@query("tax_lineage", "dv_tax", sql=f"with {CLOSURE} select c.id, string_agg(t.name, ';' order by c.distance desc) as lineage from clo c join dv_tax t on t.id=c.ancestor group by all")
def _(t):
    return gr.lineage(gr.tax_closure(t), t)


@query("tax_size", "dv_tax", "customer", "orders", sql=f"with {CLOSURE}, o as (select 1000+o_custkey as id, sum(o_orderkey)::bigint as b, count(*) as s from orders group by all) select ancestor as id, sum(case when o.id=ancestor then b else 0 end)::bigint as own_bases, sum(b)::bigint as bases, sum(s)::bigint as sequences, count(*) as nodes from o join clo using(id) group by all")
def _(t, c, o):
    return ag.tax_size(o.select((1000 + F.col("o_custkey")).alias("taxid"), F.col("o_orderkey").alias("bases")), gr.tax_closure(t))


@query("filter_taxa", "dv_tax", "orders", sql=f"with {CLOSURE} select o_orderkey from orders where 1000+o_custkey in (select id from clo where ancestor in (11,12))")
def _(t, o):
    from strandlake.operators.filters import filter_taxa

    return filter_taxa(o.withColumn("taxid", 1000 + F.col("o_custkey")), [11, 12], gr.tax_closure(t)).select("o_orderkey")


@query("common_ancestor", "dv_tax", "orders", sql=f"with {CLOSURE}, g as (select distinct o_orderkey%50 as \"group\", 1000+o_custkey as id from orders), n as (select \"group\", count(*) as n from g group by all), h as (select \"group\", ancestor, count(*) as c, min(distance) as d from g join clo using(id) group by all) select h.\"group\", arg_min(ancestor, d) as lca from h join n using(\"group\") where c=n group by all")
def _(t, o):
    g = o.select((F.col("o_orderkey") % 50).alias("group"), (1000 + F.col("o_custkey")).alias("id"))
    return gr.lca(g, gr.tax_closure(t))


@query("best_copy_per_taxon", "dv_contigs", sql="select name from (select name, row_number() over (partition by contig_id%90 order by (length(bases)>1600), length(translate(bases,'N','')) desc, length(bases)-length(replace(bases,'N','')), name) as k from dv_contigs) where k=1")
def _(c):
    return ag.keep_best_copy(c.withColumn("taxid", F.col("contig_id") % 90)).select("name")


@query("rpkm", "dv_aln", "dv_contigs", sql="with h as (select rname as ref, count(*) as reads from dv_aln group by all) select name as ref, length(bases) as length, coalesce(reads,0) as reads, round(coalesce(reads,0)*1e9/(length(bases)*(select sum(reads) from h)),6) as rpkm from dv_contigs left join h on h.ref=name")
def _(a, c):
    h = a.groupBy(F.col("rname").alias("ref")).agg(F.count("*").alias("reads"))
    return ag.rpkm(h, c.select(F.col("name").alias("ref"), F.length("bases").cast("bigint").alias("length")))


@query("seal_summary", "dv_var", sql="with s as (select sample as file, chrom as name, count(*) as reads, sum(pos)::bigint as bases from dv_var group by all), p as (select file, arg_max(name,{'b':bases,'n':name}) as primary, max(bases) as b from s group by all) select s.file, any_value(p.primary) as primary, (sum(reads)-any_value(reads) filter (where name=p.primary))::bigint as other_reads, (sum(bases)-any_value(p.b))::bigint as other_bases, round(1e6*(sum(bases)-any_value(p.b))/sum(bases),6) as ppm from s join p using(file) group by s.file")
def _(v):
    return ag.summarize_seal(v.groupBy(F.col("sample").alias("file"), F.col("chrom").alias("name")).agg(F.count("*").alias("reads"), F.sum("pos").alias("bases")))


@query("sketch_summary", "dv_var", sql="with r as (select chrom as query, sample || pos::varchar as ref, pos%3 as taxid, round(max(qual),6)::double as ani from dv_var group by all), k as (select *, row_number() over (partition by query order by ani desc, ref) as n from r), f as (select * from k where n=1), o as (select k.query, arg_min(k.ref,k.n) as contaminant, arg_min(k.ani,k.n) as contaminant_ani from k join f using(query) where k.taxid<>f.taxid group by all) select f.query, f.ref as primary, f.ani as primary_ani, contaminant, contaminant_ani from f left join o using(query)")
def _(v):
    return ag.summarize_sketch(v.groupBy(F.col("chrom").alias("query"), F.concat("sample", F.col("pos").cast("string")).alias("ref"), (F.col("pos") % 3).alias("taxid")).agg(F.round(F.max("qual"), 6).cast("double").alias("ani")))


@query("quast_summary", "dv_var", sql="with v as (select chrom as metric, list_sort(list(round(qual,6)::double)) as v from dv_var group by all) select metric, " + ", ".join(f"v[(floor({p}*(len(v)-1)+0.5)+1)::int] as p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " from v")
def _(v):
    return ag.quast_quantiles(v.select(F.col("chrom").alias("metric"), F.col("sample").alias("assembly"), F.round("qual", 6).cast("double").alias("value")))


@query("report_summaries", "dv_aln", sql="select rf as name, sum(pos)::bigint as reads, sum(mapq*0.5)::double as seconds from dv_aln group by all")
def _(a):
    return ag.parse_speed(a.select(F.concat("rf", F.lit(": "), F.col("pos").cast("string"), F.lit(" reads in "), (F.col("mapq") * 0.5).cast("string"), F.lit(" seconds")).alias("value")))


@query("hmm_protein_summary", "dv_aln", sql="select rname as protein, rf as model, max(ref_len) as longest from dv_aln group by all")
def _(a):
    return ag.hmm_report(a.select(F.col("rname").alias("protein"), F.col("rf").alias("model"), F.col("ref_len").alias("length")))


@query("kapa_stats", "dv_aln", sql="select rf as plate, pos%8 as well, sum(ref_len)::bigint as reads, sum(case when mapq%8=pos%8 then ref_len else 0 end)::bigint as own, round(sum(case when mapq%8=pos%8 then ref_len else 0 end)/sum(ref_len),6) as own_share from dv_aln group by all")
def _(a):
    return ag.kapa_stats(a.select(F.col("rf").alias("plate"), (F.col("pos") % 8).alias("well"), (F.col("mapq") % 8).alias("tag"), (F.col("pos") % 8).alias("expected_tag"), F.col("ref_len").alias("reads")))


@query("strandedness", "dv_reads", sql=f"with {km('a','dv_reads','ordinal',9,False)}, g as (select least(kmer,{rc('kmer')}) as c, count(*) filter (where kmer<={rc('kmer')}) as f, count(*) as n from a group by 1 having count(*)>1) select count(*) as kmers, round(avg(greatest(f,n-f)/n),6) as strandedness from g")
def _(r):
    return ag.check_strand(r, 9)


@query("hic_junctions", "dv_reads", sql="select substr(bases, 17, 8) as motif, count(*) as n from dv_reads group by all")
def _(r):
    return ag.hic_junctions(r.select(F.lit("20S76M").alias("cigar"), F.col("bases").alias("seq")))


@query("kmer_positions", "dv_reads", "dv_contigs", sql=f"with {km('r','dv_reads','ordinal',9)}, {km('c','dv_contigs','name',9)} select pos, count(*) as hits from r where kmer in (select kmer from c) group by all")
def _(r, c):
    return ag.kmer_positions(r, c.select("bases"), 9)


@query("shared_lines", "dv_var", sql="select a.sample as file, b.sample as file_b, count(*) as shared from (select distinct sample, lower(chrom) || pos::varchar as v from dv_var where pos%2=0) a join (select distinct sample, lower(chrom) || pos::varchar as v from dv_var where pos%3=0) b using(v) group by all")
def _(v):
    f = v.select(F.col("sample").alias("file"), F.concat(F.upper("chrom"), F.col("pos").cast("string")).alias("value"), "pos")
    return ag.shared_lines(f.where("pos % 2 = 0"), f.where("pos % 3 = 0"))


@query("bin_grades", "dv_aln", sql="with p as (select rf as bin, pos%4 as genome, sum(ref_len) as b from dv_aln group by all), g as (select bin, arg_max(genome,{'b':b,'g':genome}) as genome, max(b) as own, sum(b) as total from p group by all), s as (select pos%4 as genome, sum(ref_len)*0.6 as size from dv_aln group by all) select bin, genome, round(own/size,6)::double as completeness, round((total-own)/total,6)::double as contamination, case when (total-own)/total<=0.2 then 'LQ' else 'VLQ' end as class from g join s using(genome)")
def _(a):
    g = F.col("pos") % 4
    return ag.grade_bins(a.select(F.col("rf").alias("bin"), g.alias("genome"), F.col("ref_len").alias("bases")), a.groupBy(g.alias("genome")).agg((F.sum("ref_len") * 0.6).cast("double").alias("size")))


@query("roc_curve", "dv_aln", sql="with h as (select mapq, count(*) filter (where pos%3<>0) as t, count(*) filter (where pos%3=0) as f from dv_aln group by all) select mapq, (sum(t) over (order by mapq desc))::bigint as tp, (sum(f) over (order by mapq desc))::bigint as fp from h")
def _(a):
    return ag.roc(a.select("mapq", (F.col("pos") % 3 != 0).alias("correct")))


@query("merge_grade", "dv_aln", sql="select count(*) filter (where pos%3=1) as correct, count(*) filter (where pos%3=2) as too_long, count(*) filter (where pos%3=0) as too_short from dv_aln")
def _(a):
    return ag.grade_merge(a.select(F.concat(F.lit("r insert="), F.col("ref_len").cast("string")).alias("name"), (F.col("ref_len") + F.col("pos") % 3 - 1).alias("merged_length")))


@query("precision_recall", "dv_aln", sql="select rf as tool, 'g' || (pos%5)::varchar as genome, sum(mapq)::bigint as tp, sum(ref_len)::bigint as fp, sum(strand)::bigint as fn, round(sum(mapq)/(sum(mapq)+sum(ref_len)),6) as precision, round(sum(mapq)/nullif(sum(mapq)+sum(strand),0),6) as recall from dv_aln group by rollup(rf, 'g' || (pos%5)::varchar) having rf is not null")
def _(a):
    return ag.benchmark_metrics(a.select(F.col("rf").alias("tool"), F.concat(F.lit("g"), (F.col("pos") % 5).cast("string")).alias("genome"), F.col("mapq").alias("tp"), F.col("ref_len").alias("fp"), F.col("strand").alias("fn")))


@query("webcheck_summary", "events", sql="select case when event_id%13<>0 then event_type end as status, count(*) as n, round(avg(case when event_id%13<>0 then (event_id%100)*0.5 end),6) as mean, max(case when event_id%13<>0 then (event_id%100)*0.5 end)::double as worst from events group by 1")
def _(e):
    line = F.concat_ws("|", F.lit("t"), F.lit("https://x"), "event_type", F.when(F.col("event_id") % 13 == 0, "bad").otherwise(((F.col("event_id") % 100) * 0.5).cast("string")))
    return ag.webcheck(e.select(line.alias("value")))


@query("frame_kmer_model", "dv_contigs", "dv_features", sql=f"with s as (select feature_id::varchar || '.' || line::varchar as fid, case when strand='-' then {rc('substr(c.bases,start::int,(stop-start+1)::int)')} else substr(c.bases,start::int,(stop-start+1)::int) end as bases from dv_features f join dv_contigs c on c.name=f.seqid where type='CDS'), {km('a','s','fid',3,False)}, {km('b','dv_contigs','name',3,False)}, i as (select pos%3 as frame, kmer, count(*) as inside from a group by all), o as (select kmer, count(*) as outside from b group by all) select frame, kmer, inside, coalesce(outside,0) as outside, round(inside/(sum(inside) over (partition by frame)),6) as share from i left join o using(kmer)")
def _(c, f):
    return ag.frame_kmer_model(c, f, 3)


# -- windows ----------------------------------------------------------------------------------------------------


@query("sort_reads", "dv_contigs", sql="select contig_id, length(bases) as n from dv_contigs")
def _(c):
    return wi.sort_reads(c, "length", False, "contig_id").select("contig_id", F.length("bases").cast("bigint").alias("n"))


@query("sample_reads", "dv_reads", sql="select ordinal from dv_reads where ('0x' || substr(md5(ordinal::varchar || ':7'),1,8))::bigint/4294967296.0 < 0.3")
def _(r):
    return wi.sample(r, 0.3, 7).select("ordinal")


@query("sample_bases", "dv_contigs", sql="select contig_id from (select contig_id, sum(length(bases)) over (order by length(bases) desc, contig_id rows unbounded preceding) - length(bases) as s from dv_contigs) where s < 20000")
def _(c):
    return wi.sample_bases(c, 20000, True, "contig_id").select("contig_id")


@query("low_coverage_windows", "dv_aln", sql=f"with {DEPTH}, b as (select contig, unnest(range(start,stop+1)) as pos, depth from seg), w as (select contig, pos, avg(depth) over x as m, count(*) over x as c from b window x as (partition by contig order by pos rows 4 preceding)), l as (select contig, unnest(range(pos-4,pos+1)) as p from w where m<6 and c=5) select contig, count(distinct p) as bases from l group by all")
def _(a):
    return wi.low_cov_bases(ag.depth_per_base(ag.depth_segments(a)), 5, 6.0)


@query("delta_rows", "dv_aln", sql=f"with {DEPTH}, b as (select contig, unnest(range(start,stop+1)) as pos, depth from seg) select contig, pos, depth from (select *, lag(depth) over (partition by contig order by pos) as q from b) where q is null or q<>depth")
def _(a):
    return wi.delta_rows(ag.depth_per_base(ag.depth_segments(a))).withColumn("depth", F.col("depth").cast("bigint"))


@query("gaps_islands", "dv_features", sql="with p as (select seqid, unnest(range(start,stop+1)) as p from dv_features), d as (select distinct seqid, p from p), g as (select seqid, p, p - row_number() over (partition by seqid order by p) as g from d) select seqid, min(p) as start, max(p) as stop from g group by seqid, g")
def _(f):
    return wi.merge_ranges(f.select("seqid", "start", "stop"), "seqid")


@query("call_peaks", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',7)}, c as (select kmer, count(*) as n from k group by all), h as (select n as value, count(*) as count from c group by all), s as (select value, count, (3.0*count+2.0*coalesce(lag(count) over w,0)+2.0*coalesce(lead(count) over w,0)+coalesce(lag(count,2) over w,0)+coalesce(lead(count,2) over w,0))/9.0 as sm from h window w as (order by value)), m as (select *, sm>coalesce(lag(sm) over w,-1) and sm>=coalesce(lead(sm) over w,-1) and sm>=2 as peak, sm<=coalesce(lag(sm) over w,-1) and sm<coalesce(lead(sm) over w,-1) as valley from s window w as (order by value)), i as (select *, sum(valley::int) over (order by value) as island from m), g as (select island, sum(count)::bigint as volume, max(case when peak then row(sm, value) end) as p from i group by all) select p[2] as value, round(p[1],6)::double as height, volume from g where p is not null")
def _(r):
    h = ag.kmer_hist(ag.kmer_count(r, 7)).withColumnsRenamed({"depth": "value", "kmers": "count"})
    return wi.call_peaks(h)


@query("find_repeats", "dv_contigs", sql=f"with {km('k','dv_contigs','name',6)}, d as (select kmer from k group by all having count(*)>=60), p as (select distinct name, unnest(range(pos,pos+6)) as p from k where kmer in (select kmer from d)), g as (select name, p, p - row_number() over (partition by name order by p) as g from p) select name, min(p) as start, max(p) as stop from g group by name, g having count(*)>=8")
def _(c):
    return wi.find_repeats(c, 6, 60, 0, 8)


#: Repeats by their definition: on each diagonal (d apart) the stretches between mismatches, three of them inside.
REPEATS = """b as (select contig_id as name, substr(bases,1,25) || substr(bases,26,15) || substr(bases,1,9) || translate(substr(bases,10,1),'ACGTN','CGTAA') || substr(bases,11,15) || substr(bases,27,14) || substr(bases,1,25) || reverse(bases) as bases from dv_contigs),
dg as (select name, d, p, bases[p]=bases[p+d] and bases[p] in ('A','C','G','T') as m from (select *, unnest(range(1,length(bases)-d+1)) as p from (select *, unnest(range(34,51)) as d from b))),
mis as (select name, d, p as x from dg where not m union all select distinct name, d, 0 from dg union all select name, d, max(p)+1 from dg group by all),
mj as (select *, row_number() over (partition by name, d order by x) as j from mis),
iv as (select a.name, a.d, a.x as lo, b.x as hi from mj a join mj b on a.name=b.name and a.d=b.d and b.j between a.j+1 and a.j+4),
st as (select distinct name, d, s, e, ok from (select name, d, lo, hi, min(p) as s, max(p) as e, count(*) as ok from iv join dg using (name, d) where p>lo and p<hi and m group by all)),
ru as (select name, d, min(p) as r from (select *, p-row_number() over (partition by name, d order by p) as g from dg where m) group by name, d, g having count(*)>=8),
rep as (select distinct name, d, q.s, q.e-q.s+1 as n, q.e-q.s+1-q.ok as wrong from (select ru.name, ru.d, ru.r, arg_max({'s': s, 'e': e, 'ok': ok}, (4*ok-3*(e-s+1), ok-(e-s+1), -s, -e)) as q from ru join st on st.name=ru.name and st.d=ru.d and s<=r and e>=r+7 group by all)),
hits as (select name, s-1 as start, n as repeat_length, d-n as spacer_length, wrong as mismatches from rep where n between 20 and 30 and d-n between 14 and 20)"""


def with_repeats(c):
    b = F.col("bases")
    changed = F.translate(F.substring(b, 10, 1), "ACGTN", "CGTAA")
    made = F.concat(F.left(b, F.lit(25)), F.substring(b, 26, 15), F.left(b, F.lit(9)), changed, F.substring(b, 11, 15), F.substring(b, 27, 14), F.left(b, F.lit(25)), F.reverse(b))
    return wi.find_crisprs(c.select(F.col("contig_id").alias("name"), made.alias("bases")), 8, (14, 20), repeat=(20, 30))


@query("find_crisprs", "dv_contigs", sql=f"with {REPEATS} select * from hits")
def _(c):
    return with_repeats(c).drop("stem")


@query("crispr_arrays", "dv_contigs", sql=f"with {REPEATS}, l as (select a.name, a.start as a, a.repeat_length as ar, a.spacer_length as asp, b.start as b, b.repeat_length as br, b.spacer_length as bsp from hits a join hits b on a.name=b.name and abs(a.start+a.repeat_length+a.spacer_length-b.start)<=3), n as (select name, {{'s': start, 'r': repeat_length, 'p': spacer_length}} as x, start, repeat_length, spacer_length from hits), e as (select name, {{'s': a, 'r': ar, 'p': asp}} as x, {{'s': b, 'r': br, 'p': bsp}} as y from l), ee as (select name, x, y from e union all select name, y, x from e), r(name, x, y) as (select name, x, x from n union select r.name, r.x, ee.y from r join ee on ee.name=r.name and ee.x=r.y), g as (select name, x, min(y) as grp from r group by all), c as (select n.name, grp, repeat_length, unnest([start, start+repeat_length+spacer_length]) as y from n join g on g.name=n.name and g.x=n.x), w as (select *, coalesce((y-lag(y) over (partition by name, grp order by y)>3)::int, 1) as fresh from c), mo as (select name, grp, repeat_length, row_number() over (partition by name, grp order by count(*) desc, repeat_length) as k from w group by name, grp, repeat_length) select w.name, min(y) as start, max(y+w.repeat_length) as stop, sum(fresh)::bigint as copies, any_value(mo.repeat_length) as repeat_length from w join mo on mo.name=w.name and mo.grp=w.grp and mo.k=1 group by w.name, w.grp")
def _(c):
    return wi.crispr_arrays(with_repeats(c))


@query("top_hits", "dv_var", sql="select chrom, sample, pos, rank from (select *, row_number() over (partition by chrom order by qual desc, pos) as rank from dv_var) where rank<=3")
def _(v):
    return wi.top_hits(v, "chrom", "qual", 3, "pos").select("chrom", "sample", "pos", "rank")


@query("percentile_count", "dv_aln", sql="with n as (select rname, count(*) as n from dv_aln group by all), h as (select n, count(*)*any_value(n) as reads from n group by n), c as (select n, sum(reads) over (order by n desc) as cum, sum(reads) over () as t from h) select max(n) as count_at_percentile from c where cum>=0.9*t")
def _(a):
    return wi.count_percentile(a.select(F.col("rname").alias("barcode")), 0.9)


@query("blur_tiles", "dv_reads", sql="with t as (select 1+ordinal%4 as lane, 1101+ordinal%8 as tile, ((ordinal*37)%5000)//1000 as bx, ((ordinal*91)%5000)//1000 as cy, count(*) as v from dv_reads group by all), p as (select t.*, a.dx, a.dy, a.w from t, (select unnest([0,1,-1,0,0]) as dx, unnest([0,0,0,1,-1]) as dy, unnest([8,1,1,1,1]) as w) a) select t.lane, t.tile, t.bx, t.cy as \"by\", round(sum(p.v*p.w)/sum(p.w),6) as smooth from t join p on p.lane=t.lane and p.tile=t.tile and p.bx+p.dx=t.bx and p.cy+p.dy=t.cy group by all")
def _(r):
    h = r.select(S.parse_header(F.col("name")).alias("h")).select("h.lane", "h.tile", F.floor(F.col("h.x") / 1000).alias("bx"), F.floor(F.col("h.y") / 1000).alias("by"))
    return wi.blur_tiles(h.groupBy("lane", "tile", "bx", "by").agg(F.count("*").alias("v")))


@query("clump", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',9)} select ordinal, arg_max(kmer, md5(kmer)) as pivot from k group by all")
def _(r):
    return wi.pivot_kmers(r, 9).where("pivot is not null")


# -- sets -------------------------------------------------------------------------------------------------------


for _mode, _sql in (("union", "union"), ("intersection", "intersect"), ("difference", "except")):
    query(f"vcf_set_ops_{_mode}", "dv_var", sql=f"select chrom,pos,ref,alt from dv_var where sample='s0' {_sql} select chrom,pos,ref,alt from dv_var where sample='s1'")(lambda v, m=_mode: st.compare_vcf([v.where("sample = 's0'"), v.where("sample = 's1'")], m))
    query(f"gff_set_ops_{_mode}", "dv_features", sql=f"select seqid,start,stop,strand from dv_features where line<=2 and type='CDS' {_sql} select seqid,start,stop,strand from dv_features where line>=2 and type='CDS'")(lambda f, m=_mode: st.gff_set_op(f.where("line <= 2"), f.where("line >= 2"), m))


@query("kmer_set_ops", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',7)} select kmer from k group by all having count(*) between 10 and 60")
def _(r):
    return st.kmer_set(ag.kmer_count(r, 7), 10, 60)


@query("kmer_neighbors", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',8,False)}, s as (select kmer from k group by all having count(*)>=3) select distinct substr(kmer,1,(i-1)::int) || b || substr(kmer,(i+1)::int) as kmer from s, (select unnest(range(1,9)) as i), (select unnest(['A','C','G','T']) as b) union select kmer from s")
def _(r):
    return st.kmer_neighbors(ag.kmer_count(r, 8, rcomp=False, min_count=3).select("kmer"))


@query("dedupe_exact", "dv_reads", sql=f"select min(ordinal) as ordinal from dv_reads group by least(bases,{rc('bases')})")
def _(r):
    return st.dedupe(r).select("ordinal")


@query("dedupe_unique_only", "dv_reads", "dv_contigs", sql=f"select min(ordinal) as ordinal from (select ordinal, bases from dv_reads union all select -contig_id, bases from dv_contigs union all select -1000000-contig_id, {rc('bases')} from dv_contigs where contig_id%3=0) group by least(bases,{rc('bases')}) having count(*)=1")
def _(r, c):
    other = c.where("contig_id % 3 = 0").select(-1000000 - F.col("contig_id"), S.revcomp(F.col("bases")))
    rows = r.select("ordinal", "bases").union(c.select(-F.col("contig_id"), "bases")).union(other)
    return st.dedupe(rows, unique_only=True).select("ordinal")


@query("dedupe_containment", "dv_contigs", sql="with s as (select contig_id::varchar as name, substr(bases,5,30) as bases from dv_contigs union all select 'x' || contig_id::varchar, bases from dv_contigs where contig_id%3<2), k as (select name, bases, unnest([substr(bases,1,15), substr(" + rc("bases") + ",1,15)]) as seed from s), p as (select name as l, bases as lb, substr(bases,(i+1)::int,15) as seed from (select *, unnest(range(0,length(bases)-14)) as i from s)) select name from s where name not in (select k.name from k join p using(seed) where l<>name and (contains(lb,k.bases) or contains(lb," + rc("k.bases") + ")) and (length(lb)>length(k.bases) or (length(lb)=length(k.bases) and l<k.name)))")
def _(c):
    part = c.select(F.col("contig_id").cast("string").alias("name"), F.substring("bases", 5, 30).alias("bases"))
    whole = c.where("contig_id % 3 < 2").select(F.concat(F.lit("x"), F.col("contig_id").cast("string")).alias("name"), "bases")  # the others are held by nothing
    return st.dedupe_containment(part.union(whole), 15).select("name")


OVERLAPS = "s as (select contig_id as name, substr(bases,1,30) as b from dv_contigs union all select contig_id+5000000, substr(bases,15,26) from dv_contigs), p as (select name, b, i, substr(b,(i+1)::int,15) as seed from (select *, unnest(range(0,length(b)-14)) as i from s)), e as (select p.name as a, s.name as b, length(p.b)-i as overlap from p join s on substr(s.b,1,15)=p.seed where p.name<>s.name and starts_with(s.b, substr(p.b,(i+1)::int)))"


def overlapping(c):
    return c.select(F.col("contig_id").alias("name"), F.left("bases", F.lit(30)).alias("bases")).union(c.select((F.col("contig_id") + 5_000_000).alias("name"), F.substring("bases", 15, 26).alias("bases")))


@query("overlap_edges", "dv_contigs", sql=f"with {OVERLAPS} select a, b, max(overlap)::bigint as overlap from e group by all")
def _(c):
    return st.overlap_edges(overlapping(c), 15)


@query("overlap_clusters", "dv_contigs", sql=f"with {OVERLAPS}, x as (select a, b from e union select b, a from e), r(a, t) as (select name, name from s union select r.a, x.b from r join x on x.a=r.t) select a as name, min(t) as cluster from r group by all")
def _(c):
    return st.overlap_clusters(overlapping(c), 15)


#: Of each cluster; and the forest by the cycle rule: an edge stays unless better ones already join its ends.
CLUSTERS = "x as (select a, b from e union select b, a from e), r(a, t) as (select name, name from s union select r.a, x.b from r join x on x.a=r.t), cl as (select a as name, min(t) as cluster from r group by all), pr as (select least(a,b) as a, greatest(a,b) as b, max(overlap) as w from e group by all)"


@query("overlap_representatives", "dv_contigs", sql=f"with {OVERLAPS}, {CLUSTERS}, dg as (select name, count(*) as k from (select a as name from pr union all select b from pr) group by all), n as (select cl.name, cluster, length(s.b) as n, coalesce(k,0) as k from cl join s on s.name=cl.name left join dg on dg.name=cl.name) select cluster, count(*) as size, sum(n)::bigint as bases, (sum(k)//2)::bigint as links, arg_min(name,(-n,-k,name)) as representative from n group by all")
def _(c):
    rows = overlapping(c)
    edges = stored(st.overlap_edges(rows, 15))
    return st.cluster_summary(rows, st.overlap_clusters(rows, edges=edges), edges)


@query("overlap_spanning_forest", "dv_contigs", sql=f"with {OVERLAPS}, {CLUSTERS}, o as (select *, row_number() over (order by w desc, a, b) as k from pr), bt as (select o.k, o2.a, o2.b from o join cl ca on ca.name=o.a join o o2 on o2.k<o.k join cl cy on cy.name=o2.a and cy.cluster=ca.cluster), bb as (select k, a, b from bt union all select k, b, a from bt), h(k, y) as (select k, a from o union select h.k, bb.b from h join bb on bb.k=h.k and bb.a=h.y) select a, b, w::bigint as w from o where not exists (select 1 from h where h.k=o.k and h.y=o.b)")
def _(c):
    return gr.spanning_forest(st.overlap_edges(overlapping(c), 15).withColumnRenamed("overlap", "w"))


#: Short copies with a base changed or gone lie in their contigs; seeds by pigeonhole, edits against all substrings nearby.
@query("dedupe_containment_inexact", "dv_contigs", sql="with s as (select name, bases from dv_contigs union all select 'x' || contig_id::varchar, case contig_id%4 when 3 then translate(substr(bases,5,30),'ACGTN','CGTAA') when 0 then substr(bases,5,12) || translate(substr(bases,17,1),'ACGTN','CGTAA') || substr(bases,18,20) when 1 then substr(bases,5,12) || substr(bases,18,20) else " + rc("substr(bases,4,12) || 'GT' || substr(bases,16,18)") + " end from dv_contigs), q as (select name, length(bases) as n, (length(bases)*0.1+1e-9)::double as f, bases as q from s where length(bases)<40 union all select name, length(bases), (length(bases)*0.1+1e-9)::double, " + rc("bases") + " from s where length(bases)<40), q2 as (select name, n, floor(f)::int as e, q from q), c as (select *, (i*n)//(e+1) as a, ((i+1)*n)//(e+1) as z from (select *, unnest(range(0,e+1)) as i from q2)), g as (select *, substr(q,(a+1)::int,(z-a)::int) as seed from c), p as (select name as l, bases as lb, w, i, substr(bases,(i+1)::int,w::int) as seed from (select *, unnest(range(0,length(bases)-w+1)) as i from s, (select distinct z-a as w from g))), m as (select distinct g.name, q, n, e, lb, p.i-a as d from g join p on p.seed=g.seed where l<>g.name and (length(lb)>n or (length(lb)=n and l<g.name))), t as (select m.*, unnest(range(greatest(0,d-e),d+e+1)) as st from m), t2 as (select *, unnest(range(n-e,n+e+1)) as ln from t), hit as (select distinct name from t2 where levenshtein(q,substr(lb,(st+1)::int,ln::int))<=e) select name from s where length(bases)<40 and name not in (select name from hit)")
def _(c):
    b = F.col("bases")
    kind, changed = F.col("contig_id") % 4, F.concat(F.substring(b, 5, 12), F.translate(F.substring(b, 17, 1), "ACGTN", "CGTAA"), F.substring(b, 18, 20))
    more = S.revcomp(F.concat(F.substring(b, 4, 12), F.lit("GT"), F.substring(b, 16, 18)))
    part = c.select(F.concat(F.lit("x"), F.col("contig_id").cast("string")).alias("name"), F.when(kind == 0, changed).when(kind == 1, F.concat(F.substring(b, 5, 12), F.substring(b, 18, 20))).when(kind == 2, more).otherwise(F.translate(F.substring(b, 5, 30), "ACGTN", "CGTAA")).alias("bases"))
    rows = c.select("name", "bases").union(part)
    return st.dedupe_containment(rows, min_identity=90, ask="length(bases) < 40").select("name")


@query("count_duplicates", "dv_reads", sql="with g as (select bases, count(*) as n from dv_reads group by all) select sum(n)::bigint as reads, sum(n-1)::bigint as duplicates, round(sum(n-1)/sum(n),6) as fraction from g")
def _(r):
    return st.count_duplicates(r)


@query("dedupe_by_mapping", "dv_aln", sql="select aln_id from dv_aln where aln_id in (select aln_id from (select aln_id, row_number() over (partition by rname,pos,ref_len,strand order by mapq desc, aln_id) as k from dv_aln) where k=1)")
def _(a):
    return st.dedupe_by_mapping(a).select("aln_id")


@query("dedupe_optical", "dv_reads", sql="with h as (select ordinal, bases, 1+ordinal%4 as lane, 1101+ordinal%8 as tile, (ordinal*37)%5000 as x, (ordinal*91)%5000 as y from dv_reads) select ordinal from h a where not exists (select 1 from h b where b.ordinal<a.ordinal and a.lane=b.lane and a.tile=b.tile and abs(a.x-b.x)<=600 and abs(a.y-b.y)<=600 and substr(a.bases,1,16)=substr(b.bases,1,16) and hamming(a.bases,b.bases)<=2)")
def _(r):
    return st.dedupe_optical(r, 600).select("ordinal")


@query("mark_duplicates", "dv_reads", sql="select ordinal, case when ordinal > min(ordinal) over (partition by bases) then name || ' duplicate' else name end as name from dv_reads")
def _(r):
    return st.mark_duplicates(r).select("ordinal", "name")


@query("unique_prefixes", "dv_reads", sql="select min(ordinal) as ordinal from dv_reads group by substr(bases,1,5)")
def _(r):
    return st.unique_prefixes(r, 5).select("ordinal")


@query("compare_text", "dv_reads", sql="select ordinal, name as a, case when ordinal%9=0 then name || 'x' end as b from dv_reads where ordinal%3=0")
def _(r):
    a = r.select("ordinal", F.col("name").alias("value"))
    b = a.where("ordinal % 3 <> 0 or ordinal % 9 = 0").withColumn("value", F.when(F.col("ordinal") % 9 == 0, F.concat("value", F.lit("x"))).otherwise(F.col("value")))
    return st.diff_rows(a, b)


# -- sketches, graphs, classifiers ------------------------------------------------------------------------------


SK = f"with {km('k','dv_reads','barcode',12)}, n as (select barcode, kmer, count(*) as depth from k group by all), s as (select barcode, md5(kmer) as key, depth, row_number() over (partition by barcode order by md5(kmer) desc) as rank from n)"


@query("sketch_density", "dv_reads", sql=SK + " select barcode, key, depth from s where ('0x' || left(key,8))::bigint/4294967296.0>=0.95 and depth>=2")
def _(r):
    return si.sketch_density(r, "barcode", 12, 0.05, 2)


@query("sketch_make", "dv_reads", sql=SK + " select * from s where rank<=200")
def _(r):
    return si.sketch(r, "barcode", 12, 200)


@query("sketch_merge_subset", "dv_reads", sql=SK + ", m as (select 'all' as barcode, key, sum(depth)::bigint as depth from s where rank<=100 group by key) select * from (select *, row_number() over (order by key desc) as rank from m) where rank<=150")
def _(r):
    s = si.subsketch(si.sketch(r, "barcode", 12, 200), "barcode", 100).withColumn("barcode", F.lit("all"))
    return si.merge_sketches([s], "barcode", 150)


@query("sketch_blacklist", "dv_reads", sql=SK + " select key, count(distinct barcode) as ids from s where rank<=200 group by all having count(distinct barcode)>=2")
def _(r):
    return si.blacklist(si.sketch(r, "barcode", 12, 200), "barcode", 2)


@query("sketch_compare", "dv_reads", sql=SK + ", t as (select * from s where rank<=200), c as (select barcode, count(*) as c from t group by all), h as (select a.barcode as query, b.barcode as ref, count(*) as hits from t a join t b using(key) where a.barcode<>b.barcode group by all) select query, ref, hits, round(hits/least(x.c,y.c),6) as wkid, round(hits/greatest(x.c,y.c),6) as kid, round(pow(hits/least(x.c,y.c),1.0/12),6) as ani, round(hits/y.c,6) as completeness from h join c x on x.barcode=query join c y on y.barcode=ref")
def _(r):
    s = si.sketch(r, "barcode", 12, 200)
    return si.compare_sketch(s, s, "barcode", 12, skip_same=True)


@query("sketch_unique_hits", "dv_contigs", sql=f"with {km('k','dv_contigs','contig_id',6)}, n as (select contig_id, kmer, count(*) as depth from k group by all), t as (select contig_id, key from (select contig_id, md5(kmer) as key, row_number() over (partition by contig_id order by md5(kmer) desc) as rank from n) where rank<=20), o as (select key, any_value(contig_id) as ref from t group by all having count(*)=1) select t.contig_id as query, ref, count(*) as \"unique\" from t join o using(key) group by all")
def _(c):
    s = si.sketch(c, "contig_id", 6, 20)
    return si.unique_hits(s, s, "contig_id")


@query("sketch_invert", "dv_reads", sql=SK + ", i as (select distinct kmer from n) select md5(kmer) as key, kmer from i where md5(kmer) in (select key from s where rank<=5)")
def _(r):
    s = si.sketch(r, "barcode", 12, 5)
    return si.invert_keys(s, r.select("bases"), 12)


@query("clade_spectra", "dv_contigs", sql=f"with {km('k','dv_contigs','contig_id',3)}, u as (select contig_id%40 as clade, kmer from k), x as (select a.b || b.b || c.b as kmer from (select unnest(['A','C','G','T']) as b) a, (select unnest(['A','C','G','T']) as b) b, (select unnest(['A','C','G','T']) as b) c), m as (select kmer, row_number() over (order by kmer) as i from x where kmer<={rc('kmer')}), t as (select clade, count(*) as t, sum(length(kmer)-length(translate(kmer,'GC',''))) as g from u group by all), n as (select clade, kmer, count(*) as n from u group by all) select t.clade, round(g/(t*3),6) as gc, i, round(coalesce(n,0)/t,6)::double as share from t cross join m left join n on n.clade=t.clade and n.kmer=m.kmer")
def _(c):
    s = si.clade_spectra(c.withColumn("clade", F.col("contig_id") % 40), "clade")
    each = s.select("clade", F.round("gc", 6).alias("gc"), F.posexplode("spectrum").alias("i", "x"))
    return each.select("clade", "gc", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("share"))


@query("clade_search", "dv_contigs", sql=f"with {km('k','dv_contigs','contig_id',3)}, u as (select contig_id%40 as clade, kmer from k), a as (select distinct clade from u), m as (select distinct kmer from u), n as (select clade, kmer, count(*) as n from u group by all), t as (select clade, sum(n) as t, sum(n*(length(kmer)-length(translate(kmer,'GC',''))))/(sum(n)*3) as gc from n group by all), f as (select a.clade, m.kmer, coalesce(n.n,0)/t.t as x, gc from a cross join m left join n using(clade,kmer) join t on t.clade=a.clade), d as (select p.clade as query, q.clade as ref, round(sum(abs(p.x-q.x)),6) as distance from f p join f q using(kmer) where p.clade<>q.clade and abs(p.gc-q.gc)<=0.1 group by all) select * from (select *, row_number() over (partition by query order by distance, ref) as rank from d) where rank<=2")
def _(c):
    s = si.clade_spectra(c.withColumn("clade", F.col("contig_id") % 40), "clade")
    return si.clade_search(s, s, "clade", 2)


@query("vector_distance", "embeddings", sql="with e as (select vec_id, embedding::double[] as e from embeddings) select a.vec_id as a, b.vec_id as b, round(list_sum(list_transform(range(1,len(a.e)+1), lambda i: abs(a.e[i]-b.e[i]))),5) as d, round(1-list_dot_product(a.e,b.e)/sqrt(list_dot_product(a.e,a.e)*list_dot_product(b.e,b.e)),5) as c from e a join e b on a.vec_id%20=0 and a.vec_id<>b.vec_id")
def _(e):
    p = si.vector_pairs(e.where("vec_id % 20 = 0"), e, "vec_id", "vec_id", "embedding")
    return p.select("a", "b", F.round("abs", 5).alias("d"), F.round("cosine", 5).alias("c"))


@query("all_to_all_identity", "dv_contigs", sql="select x.name as a, y.name as b, round(1-levenshtein(x.bases,y.bases)/greatest(length(x.bases),length(y.bases)),6) as identity from dv_contigs x join dv_contigs y on x.name<>y.name")
def _(c):
    return si.identity_matrix(c)


@query("shared_kmer_identity", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',24,False)}, u as (select distinct bases from dv_reads), s as (select bases, unnest(range(0,length(bases)-23)) as i from u), x as (select distinct bases, substr(bases,(i+1)::int,24) as kmer from s where not regexp_matches(substr(bases,(i+1)::int,24),'[^ACGT]')), p as (select distinct a.bases as a, b.bases as b from x a join x b using(kmer) where a.bases<b.bases) select a, b, round(1-levenshtein(a,b)/greatest(length(a),length(b)),6) as identity from p")
def _(r):
    return si.identity_pairs(r.select("bases").distinct().withColumn("name", F.col("bases")), k=24)


@query("seeded_alignment_search", "dv_contigs", sql="with q as (select name as query, substr(bases,5,10) as q from dv_contigs where contig_id%20=0), h as (select query, name as ref, i as pos, hamming(substr(bases,(i+1)::int,10),q) as subs from (select *, unnest(range(0,length(bases)-10+1)) as i from dv_contigs), q), m as (select query, ref, min(subs*1000+pos) as m from h group by all) select query, ref, m%1000 as pos, (m//1000)::bigint as subs from m where m//1000<=3")
def _(c):
    return si.seeded_search(c.where("contig_id % 20 = 0").select("name", F.substring("bases", 5, 10).alias("bases")), c, 3)


@query("banded_identity", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',24,False)}, u as (select distinct bases from dv_reads), s as (select bases, unnest(range(0,length(bases)-23)) as i from u), x as (select distinct bases, substr(bases,(i+1)::int,24) as kmer from s where not regexp_matches(substr(bases,(i+1)::int,24),'[^ACGT]')), p as (select distinct a.bases as a, b.bases as b from x a join x b using(kmer) where a.bases<b.bases), i as (select a, b, round(1-levenshtein(a,b)/greatest(length(a),length(b)),6) as identity from p) select * from i where identity>=0.58")
def _(r):
    return si.identity_pairs(r.select("bases").distinct().withColumn("name", F.col("bases")), k=24, least=0.58)


#: Nodes o (k, id, nb: neighbours) one after the other: each is taken unless a neighbour is.
GREEDY = "r(k, taken) as (select 0::bigint, []::bigint[] union all select r.k+1, case when list_has_any(nb, taken) then taken else list_append(taken, id) end from r join o on o.k=r.k+1) select unnest(taken) as id from r where k=(select max(k) from o)"


@query("representative_set", "dv_edges", sql=f"with e as (select distinct a, b, ((a*7+b*3)%100)/100.0 as w from dv_edges), x as (select a, b, w from e union select b, a, w from e), n as (select distinct a as id from x), s as (select a, sum(w::double-0.2) as s from x group by all), p as (select id, coalesce(s+0.25*s*ln((2+id%5)::double),0) as p from n left join s on s.a=id), g as (select a, list(distinct b) as nb from x group by a), o as (select row_number() over (order by p desc, id) as k, id, coalesce(nb,[]) as nb from p left join g on g.a=id), {GREEDY}")
def _(e):
    w = e.select("a", "b", (((F.col("a") * 7 + F.col("b") * 3) % 100) / 100.0).alias("w"))
    nodes = e.select(F.col("a").alias("id")).union(e.select("b")).distinct().withColumn("size", 2 + F.col("id") % 5)
    return gr.representatives(w, nodes, 0.2)


@query("pick_subset", "dv_edges", sql=f"with e as (select a, b from dv_edges where ((a*7+b*3)%100)/100.0>0.5), x as (select a, b from e union select b, a from e), n as (select a as id from dv_edges union select b from dv_edges), g as (select a, list(distinct b) as nb from x group by a), o as (select row_number() over (order by id%97, id) as k, id, coalesce(nb,[]) as nb from n left join g on g.a=id), {GREEDY}")
def _(e):
    w = e.select("a", "b", (((F.col("a") * 7 + F.col("b") * 3) % 100) / 100.0).alias("w"))
    nodes = e.select(F.col("a").alias("id")).union(e.select("b")).distinct().withColumn("rank", F.col("id") % 97)
    return gr.pick_subset(w, nodes, 0.5)


@query("identity_tree", "dv_contigs")
def _(c):
    cut = lambda a, n: c.select((F.col("contig_id") * 10 + a).alias("name"), F.substring("bases", a, n).alias("bases"))  # noqa: E731  pieces of a contig are its relatives
    p = si.identity_pairs(cut(1, 40).union(cut(3, 38)).union(cut(6, 35)), k=20)
    return gr.id_tree(p, gr.connected_components(p.where("identity >= 0.3")))


@query("kmer_cover_set", "dv_contigs")
def _(c):
    return gr.kmer_filter_set(jo.kmer_rows(c, "contig_id", 6), "contig_id")


@query("connected_components", "dv_edges", sql="with e as (select a, b from dv_edges where (a*7+b*3)%100<40), x as (select a, b from e union select b, a from e), r(a, t) as (select a, a from x union select r.a, x.b from r join x on x.a=r.t) select a as node, min(t) as component from r group by all")
def _(e):
    return gr.connected_components(e.where("(a * 7 + b * 3) % 100 < 40"))  # edges of the smaller weights, as in dbscan_refine


@query("bin_contigs", "dv_contigs")
def _(c):
    v = si.clade_spectra(c, "contig_id", 2)
    rows = v.select(F.col("contig_id").alias("id"), "gc", (1.0 + F.col("contig_id") % 9).alias("depth"), F.col("spectrum").alias("vector"))
    return gr.bin_contigs(rows, 0.3)


@query("dbscan_refine", "dv_edges", sql="with n as (select a, b from dv_edges where (a*7+b*3)%100<=20), x as (select a, b from n union select b, a from n), core as (select a from x group by all having count(*)>=2), i as (select x.a, x.b from x where a in (select a from core) and b in (select a from core)), r(a, t) as (select a, a from core union select r.a, i.b from r join i on i.a=r.t), f as (select a as node, min(t) as cluster from r group by all) select node, cluster, true as core from f union all select x.a, min(f.cluster), false from x join f on f.node=x.b where x.a not in (select a from core) group by x.a")
def _(e):
    return gr.dbscan(e.select("a", "b", ((F.col("a") * 7 + F.col("b") * 3) % 100).alias("d")), 20, 3)


@query("modularity_refine", "dv_edges")
def _(e):
    return gr.communities(e.select("a", "b", (1 + (F.col("a") + F.col("b")) % 3).alias("w")))


@query("recluster_by_kmer", "dv_reads", "dv_contigs", sql=f"with {km('r','dv_reads','ordinal',3)}, {km('c','dv_contigs','contig_id',3)}, m as (select distinct kmer from c), n as (select 'r' || ordinal::varchar as id, kmer, count(*) as n from r group by all union all select 'c' || (contig_id%20)::varchar, kmer, count(*) from c group by all), t as (select id, sum(n) as t, sum(n*(length(kmer)-length(translate(kmer,'GC',''))))/(sum(n)*3) as gc from n group by all), f as (select t.id, m.kmer, coalesce(n.n,0)/t.t as x, gc from t cross join m left join n on n.id=t.id and n.kmer=m.kmer), d as (select p.id as query, q.id as ref, round(sum(abs(p.x-q.x)),6) as distance from f p join f q using(kmer) where p.id[1]='r' and q.id[1]='c' and abs(p.gc-q.gc)<=0.1 group by all) select * from (select *, row_number() over (partition by query order by distance, ref) as rank from d) where rank<=1")
def _(r, c):
    q = si.clade_spectra(r.withColumn("id", F.concat(F.lit("r"), F.col("ordinal").cast("string"))), "id")
    ref = si.clade_spectra(c.withColumn("id", F.concat(F.lit("c"), (F.col("contig_id") % 20).cast("string"))), "id")
    return si.clade_search(q, ref, "id", 1)


@query("tax_rename", "dv_tax", "dv_reads", sql="select r.ordinal, 'tid|' || coalesce(t.id,-1)::varchar || '|acc' || (r.ordinal%3000)::varchar || '.1' as name from dv_reads r left join dv_tax t on t.id=1000+r.ordinal%3000")
def _(t, r):
    acc = t.select(F.concat(F.lit("acc"), (F.col("id") - 1000).cast("string")).alias("accession"), F.col("id").alias("taxid"))
    named = r.select("ordinal", F.concat(F.lit("acc"), (F.col("ordinal") % 3000).cast("string"), F.lit(".1")).alias("name"))
    return gr.to_taxid(named, acc.where("taxid >= 1000")).select("ordinal", "name")


@query("split_by_taxa", "dv_tax", "orders", "nation", "region", sql=f"with {CLOSURE} select coalesce(t.name,'unknown') as route, count(*) as n from orders o left join (select c.id, t.name from clo c join dv_tax t on t.id=c.ancestor where t.level=8) t on t.id=1000+o.o_custkey*2 group by 1")
def _(t, o, n, r):
    return gr.split_by_taxa(o.select((1000 + F.col("o_custkey") * 2).alias("taxid")), gr.tax_closure(t), t, 8).groupBy("route").agg(F.count("*").alias("n"))


@query("accession_patterns", "dv_reads", sql="with s as (select regexp_replace(regexp_replace(name,'[A-Za-z]','L','g'),'[0-9]','D','g') as shape, count(*) as n from dv_reads group by 1) select shape, n, round((length(shape)-length(replace(shape,'D','')))*log10(10.0)+(length(shape)-length(replace(shape,'L','')))*log10(26.0),6) as space from s")
def _(r):
    return gr.accession_patterns(r, "name")


@query("read_position_table", "dv_reads", sql="with e as (select distinct barcode as e from dv_reads where ordinal%24<6), d as (select b.barcode, min(hamming(b.barcode,e))::bigint as distance from (select distinct barcode from dv_reads) b, e group by all) select ordinal, (ordinal*37)%5000 as x, (ordinal*91)%5000 as y, distance from dv_reads join d using(barcode)")
def _(r):
    return jo.read_positions(r, r.where("ordinal % 24 < 6").select("barcode"))


@query("split_ribo", "dv_reads", "dv_contigs", sql=f"with {km('r','dv_reads','ordinal',9)}, {km('c','(select contig_id%4 as type, bases from dv_contigs)','type',9)}, k as (select distinct type, kmer from c), h as (select ordinal, 't' || type::varchar as type, count(*) as n from r join k using(kmer) group by all), b as (select ordinal, type from (select *, row_number() over (partition by ordinal order by n desc, type) as rn from h) where rn=1) select coalesce(b.type,'other') as type, count(*) as n from dv_reads left join b using(ordinal) group by 1")
def _(r, c):
    refs = c.select(F.concat(F.lit("t"), (F.col("contig_id") % 4).cast("string")).alias("type"), "bases")
    return jo.split_ribo(r.select("ordinal", "bases"), refs, 9).groupBy("type").agg(F.count("*").alias("n"))


@query("pair_merge", "dv_reads", sql="select ordinal, 56+ordinal%21 as \"insert\", 96-56-ordinal%21 as overlap, substr(translate(bases,'N','A'),1,(56+ordinal%21)::int) as merged from dv_reads")
def _(r):
    n = (56 + F.col("ordinal") % 21).cast("int")  # inserts of all lengths that leave an overlap of 20 to 40
    p = r.withColumn("bases", F.translate("bases", "N", "A")).select("ordinal", F.left("bases", F.lit(48)).alias("bases1"), S.revcomp(F.substring("bases", n - 47, F.lit(48))).alias("bases2"))
    return si.merge_pairs(p, 16).select("ordinal", "insert", "overlap", "merged")


def short_inserts(r):
    """Mates of 48 bases on inserts of 25 to 40, which run into the adapters."""
    insert = F.left("bases", (25 + F.col("ordinal") % 16).cast("int"))
    one, two = F.lit("AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"), F.lit("ACACTCTTTCCCTACACGACGCTCTTCCGATCT")
    rows = r.withColumn("bases", F.translate("bases", "N", "A"))
    return rows.select("ordinal", F.left(F.concat(insert, one), F.lit(48)).alias("bases1"), F.left(F.concat(S.revcomp(insert), two), F.lit(48)).alias("bases2"))


@query("adapter_consensus", "dv_reads", sql="select mate, left(adapter,23) as adapter, n as pairs from (select unnest([1,2]) as mate, unnest(['AGATCGGAAGAGCACACGTCTGAACTCCAGTCA','ACACTCTTTCCCTACACGACGCTCTTCCGATCT']) as adapter), (select count(*) as n from dv_reads)")
def _(r):
    return si.adapter_consensus(short_inserts(r), min_overlap=16)


@query("adapter_trim_by_overlap", "dv_reads", sql="select ordinal, substr(translate(bases,'N','A'),1,(25+ordinal%16)::int) as bases1 from dv_reads")
def _(r):
    n = (25 + F.col("ordinal") % 16).cast("int")  # inserts shorter than the reads, which run into the adapters
    insert = F.left("bases", n)
    one, two = F.lit("AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"), F.lit("ACACTCTTTCCCTACACGACGCTCTTCCGATCT")
    p = r.withColumn("bases", F.translate("bases", "N", "A")).select("ordinal", F.left(F.concat(insert, one), F.lit(48)).alias("bases1"), F.left(F.concat(S.revcomp(insert), two), F.lit(48)).alias("bases2"))
    return si.trim_by_overlap(p, min_overlap=20).select("ordinal", "bases1")


@query("scaffold_edges", "dv_aln", sql="with p as (select a.rname as c1, b.rname as c2, a.strand as s1, b.strand as s2 from dv_aln a join dv_aln b on a.aln_id//10=b.aln_id//10 and a.aln_id%10=1 and b.aln_id%10=2), q as (select least(c1,c2) as a, greatest(c1,c2) as b, s1=s2 as same from p where c1<>c2) select a, b, count(*) as weight, count(*) filter (where same) as same, round(greatest(count(*) filter (where same), count(*) filter (where not same))/count(*),6) as orientation_share from q group by all")
def _(a):
    key = F.floor(F.col("aln_id") / 10)
    x = a.where("aln_id % 10 = 1").select(key.alias("k"), F.col("rname").alias("c1"), F.col("strand").alias("strand1"))
    y = a.where("aln_id % 10 = 2").select(key.alias("k"), F.col("rname").alias("c2"), F.col("strand").alias("strand2"))
    return si.scaffold_links(x.join(y, "k"))


@query("fix_gaps", "dv_aln", sql="with m as (select rname as gap, quantile_cont(ref_len,0.5) as m from dv_aln group by all), u as (select quantile_cont(ref_len,0.5) as u from dv_aln) select gap, 10::bigint as length, greatest(1, round(10+(u-m)))::bigint as new_length from m, u")
def _(a):
    i = a.select(F.col("rname").alias("gap"), F.col("ref_len").alias("insert"))
    return si.fix_gaps(i.select("gap").distinct().withColumn("length", F.lit(10).cast("bigint")), i)


@query("trim_contigs", "dv_contigs", "dv_aln", sql=f"with {DEPTH}, b as (select contig, unnest(range(start,stop+1)) as pos from seg where depth>=20), g as (select contig, pos, pos - row_number() over (partition by contig order by pos) as g from b), r as (select contig, min(pos) as start, max(pos) as stop from g group by contig, g) select name || '_' || start::varchar as name, substr(bases,start::int,(least(stop,length(bases))-start+1)::int) as bases from dv_contigs join r on r.contig=name where least(stop,length(bases))-start+1>=5")
def _(c, a):
    r = ag.rangecov(ag.depth_segments(a), 20).withColumnRenamed("contig", "name")
    return si.trim_contigs(c.select("name", "bases"), r, 5)


@query("orf_enumerate", "dv_contigs", sql=f"with f as (select name, unnest(range(0,6)) as frame, bases from dv_contigs), s as (select name, frame, substr(case when frame>2 then {rc('bases')} else bases end, (frame%3+1)::int) as s from f), c as (select name, frame, i, substr(s,(i*3+1)::int,3) as c from (select *, unnest(range(0,length(s)//3)) as i from s)), g as (select *, coalesce(sum((c in ('TAA','TAG','TGA'))::int) over (partition by name, frame order by i rows between unbounded preceding and 1 preceding),0) as seg from c), o as (select name, frame, seg, min(i) filter (where c in ('ATG','GTG','TTG')) as a, max(i) filter (where c in ('TAA','TAG','TGA')) as b from g group by all) select name, frame, a as start, b as stop from o where a is not null and b is not null and (b-a+1)*3>=24")
def _(c):
    return si.find_orfs(c, 24).select("name", "frame", "start", "stop")


@query("best_orf_chain", "dv_contigs")
def _(c):
    o = si.find_orfs(c, 24).select("name", F.col("start"), F.col("stop"), (F.col("frame") > 2).cast("string").alias("strand"), F.length("amino").cast("double").alias("score"))
    return si.chain_orfs(o)


#: Links of k-mers s that do not branch, walked from their first one; reads have no circles of 15-mers.
WALKED = "so as (select substr(kmer,2,14) as j, any_value(kmer) as a from s group by 1 having count(*)=1), si as (select substr(kmer,1,14) as j, any_value(kmer) as b from s group by 1 having count(*)=1), l as (select a, b from so join si using(j) where {where}), w(p, x, d) as (select kmer, kmer, 0 from s where kmer not in (select b from l) union all select p, l.b, d+1 from w join l on l.a=w.x), u as (select substr(p,1,14) || string_agg(right(x,1),'' order by d) as bases, count(*) as kmers from w group by p)"


@query("unitigs", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',15,False)}, s as (select distinct kmer from k), {WALKED.format(where='a<>b')} select * from u")
def _(r):
    return gr.unitigs(ag.kmer_count(r, 15, rcomp=False).select("kmer"), 15)


@query("unitigs_both_strands", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',15,False)}, s as (select kmer from k union select {rc('kmer')} from k), {WALKED.format(where='a<>b and a<>' + rc('b'))} select * from u where bases<={rc('bases')}")
def _(r):
    return gr.unitigs_both(ag.kmer_count(r, 15).select("kmer"), 15)


@query("label_repair", "dv_aln", sql="select aln_id, case when pos%4=3 then -1 when pos%4=2 then 1 else 0 end::bigint as fixed, pos%4<>3 as valid from dv_aln")
def _(a):
    raw = F.when(F.col("pos") % 4 == 0, " ").when(F.col("pos") % 4 == 1, "00").when(F.col("pos") % 4 == 2, " 11 ").otherwise("01")
    return si.fix_labels(a.withColumn("label", raw)).select("aln_id", F.coalesce("fixed", F.lit(-1).cast("bigint")).alias("fixed"), "valid")


@query("train_classifier", "embeddings")
def _(e):
    rows, names = vectors(e)
    held = F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0  # takes no part in training
    return si.evaluate(rows.where(held), si.train(rows.where(~held), names))


@query("cross_cohort_eval", "embeddings")
def _(e):
    rows, names = vectors(e)
    sets = {n: rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(2)) == i) for i, n in enumerate(("even", "odd"))}
    return si.cross_eval({n: si.train(d, names) for n, d in sets.items()}, sets)


# -- streaming flows in batch form ------------------------------------------------------------------------------


@query("stream_cardinality_stop", "dv_reads", sql=f"with {km('k','dv_reads','ordinal',9)}, f as (select kmer, min(ordinal) as o from k group by all), p as (select o, count(*) as n from f group by all), c as (select o, sum(n) over (order by o) as c from p) select ordinal from dv_reads where ordinal <= (select min(o) from c where c>=20000)")
def _(r):
    return flows.kmer_limit(r, 9, 20000).select("ordinal")
