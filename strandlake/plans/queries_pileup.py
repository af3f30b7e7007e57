"""Queries over alignments with their bases: alleles, variants, qualities, consensus, exact codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import pileup as pi
from strandlake.plans.queries_rows import query

#: Operations of each alignment with their offsets in the read (q) and the reference (r), bases along both, and alleles.
WALK = """o0 as (select *, regexp_extract_all(cigar,'[0-9]+[MIDNSHP=X]') as o from dv_sam),
o1 as (select *, unnest(range(1,len(o)+1)) as k from o0),
ops as (select aln_id, rname, seq, quals, strand, mapq, k, op, n, length(seq) as size, coalesce(sum(n) filter (where op in ('M','I','S','=','X')) over w,0)::bigint as q, (pos+coalesce(sum(n) filter (where op in ('M','D','N','=','X')) over w,0))::bigint as r
  from (select *, regexp_extract(o[k],'[0-9]+')::bigint as n, right(o[k],1) as op from o1) window w as (partition by aln_id order by k rows between unbounded preceding and 1 preceding)),
base as (select u.*, seq[q+i+1] as x, c.bases[r+i] as y, (ascii(quals[q+i+1])-33)::bigint as v from (select *, unnest(range(0,n)) as i from ops where op in ('M','=','X')) u join dv_contigs c on c.name=rname),
al as (select aln_id, strand, mapq, rname as chrom, r+i as start, r+i+1 as stop, 'SUB' as type, x as allele, v::double as base_qual, least(q+i,size-1-q-i) as end_distance from base where x<>y and x in ('A','C','G','T') and y in ('A','C','G','T')
  union all select aln_id, strand, mapq, rname, r, r, 'INS', substr(seq,(q+1)::int,n::int), list_avg(list_transform(range(1,n+1), lambda j: ascii(quals[q+j])-33)), least(q,size-q-n) from ops where op='I' and regexp_full_match(substr(seq,(q+1)::int,n::int),'[ACGT]+')
  union all select aln_id, strand, mapq, rname, r, r+n, 'DEL', '', (ascii(quals[q])+ascii(quals[q+1])-66)/2.0, least(q,size-q) from ops where op='D'),
dep as (select rname as chrom, r+i as p, count(*) as d from (select *, unnest(range(0,n)) as i from ops where op in ('M','=','X','D')) group by all)"""
#: Depth of each allele's place.
AT = """atd as (select k.chrom, k.start, k.stop, case when k.stop>k.start then sum(d)/(k.stop-k.start) else ceil(sum(d)/2.0) end as depth from (select distinct chrom, start, stop from al) k
  join dep on dep.chrom=k.chrom and p between case when k.stop>k.start then k.start else k.start-1 end and case when k.stop>k.start then k.stop-1 else k.start end group by k.chrom, k.start, k.stop)"""


@query("allele_pileup", "dv_sam", "dv_contigs", sql=f"with {WALK} select aln_id, strand, mapq, chrom, start, stop, type, allele, round(base_qual,6) as base_qual, end_distance::bigint as end_distance from al")
def _(a, c):
    return pi.alleles(a, c).withColumns({"base_qual": F.round("base_qual", 6), "end_distance": F.col("end_distance").cast("long")})


@query("call_alignments", "dv_sam", "dv_contigs", sql=f"""with {WALK}, {AT},
g as (select chrom, start, stop, type, allele, count(*) as count, count(*) filter (where strand=0) as plus, count(*) filter (where strand<>0) as minus, avg(base_qual) as quality, max(base_qual) as quality_max, max(mapq) as mapq_max, avg(end_distance) as end_mean, max(end_distance)::bigint as end_max from al group by all),
x as (select g.*, greatest(depth,count)::double as depth, count/greatest(depth,count) as fraction from g join atd using (chrom,start,stop)),
y as (select *, 1.0-fraction*least(1.0,quality/40)*least(1.0,depth/10) as doubt from x),
z as (select *, case when doubt<=1e-6 then 60.0 else least(60.0,-10.0*log10(doubt)) end::double as score from y)
select chrom, start, stop, type, allele, count, plus, minus, round(quality,6) as quality, quality_max, mapq_max, round(end_mean,6) as end_mean, end_max, round(depth,6) as depth, round(fraction,6) as fraction, round(score,6) as score,
  case when least(2,greatest(1,round(fraction*2)))=2 then '1/1' else '0/1' end as genotype from z where count>=2 and fraction>=0.1 and score>=0.5 and end_max>=5""")
def _(a, c):
    return pi.call_alignments(a, c, min_score=0.5, min_end_distance=5, ploidy=2).withColumn("end_max", F.col("end_max").cast("long"))


@query("call_samples", "dv_sam", "dv_contigs", sql=f"""with {WALK}, s as (select al.*, mapq%3 as sample from al),
k as (select distinct chrom, start, stop, sample from s), ds as (select rname as chrom, r+i as p, mapq%3 as sample, count(*) as d from (select *, unnest(range(0,n)) as i from ops where op in ('M','=','X','D')) group by all),
atd as (select k.chrom, k.start, k.stop, k.sample, case when k.stop>k.start then sum(d)/(k.stop-k.start) else ceil(sum(d)/2.0) end as depth from k
  join ds on ds.chrom=k.chrom and ds.sample=k.sample and p between case when k.stop>k.start then k.start else k.start-1 end and case when k.stop>k.start then k.stop-1 else k.start end group by k.chrom, k.start, k.stop, k.sample),
g as (select chrom, start, stop, type, allele, sample, count(*) as count from s group by all)
select g.*, round(greatest(depth,count)::double,6) as depth, round(count/greatest(depth,count),6) as fraction from g join atd using (chrom,start,stop,sample) where count/greatest(depth,count)>=0.2""")
def _(a, c):
    rows = a.withColumn("sample", F.pmod("mapq", F.lit(3)))
    return pi.call_alignments(rows, c, min_count=1, min_fraction=0.2, sample="sample", quality=False).select(*pi.ALLELE, "sample", "count", "depth", "fraction")


@query("quality_accuracy", "dv_sam", "dv_contigs", sql=f"with {WALK} select v as quality, count(*) as bases, count(*) filter (where x<>y) as errors, round(-10*log10((count(*) filter (where x<>y)+1)/(count(*)+1)),6) as observed from base where x in ('A','C','G','T') and y in ('A','C','G','T') group by all")
def _(a, c):
    return pi.quality_accuracy(a, c)


@query("quality_accuracy_by_position", "dv_sam", "dv_contigs", sql=f"with {WALK} select v as quality, (q+i)::bigint as position, count(*) as bases, count(*) filter (where x<>y) as errors, round(-10*log10((count(*) filter (where x<>y)+1)/(count(*)+1)),6) as observed from base where x in ('A','C','G','T') and y in ('A','C','G','T') group by all")
def _(a, c):
    return pi.quality_accuracy(a, c, by_position=True)


@query("consensus_alignments", "dv_sam", "dv_contigs", sql=f"""with {WALK},
v as (select chrom, unnest(range(start,stop)) as p, allele from al where type<>'INS'), n as (select chrom, p, allele, count(*) as n from v group by all),
t as (select chrom, p, sum(n) as others, arg_min(allele,(-n,allele)) as put from n group by all),
ch as (select t.chrom, t.p, put from t join dep on dep.chrom=t.chrom and dep.p=t.p where (d-others)*2<d),
i as (select chrom, start as p, arg_min(allele,(-n,allele)) as put, max(n) as n from (select chrom, start, allele, count(*) as n from al where type='INS' group by all) group by all),
di as (select i.chrom, i.p, ceil(sum(d)/2.0) as d from i join dep on dep.chrom=i.chrom and dep.p between i.p-1 and i.p group by i.chrom, i.p),
ii as (select i.chrom, i.p, i.put from i join di using (chrom,p) where n*2>d),
u as (select name, bases, unnest(range(1,length(bases)+1)) as p from dv_contigs)
select name, string_agg(coalesce(ii.put,'') || coalesce(ch.put,bases[u.p]),'' order by u.p) as bases from u left join ch on ch.chrom=name and ch.p=u.p left join ii on ii.chrom=name and ii.p=u.p group by name""")
def _(a, c):
    return pi.consensus_alignments(a, c)


@query("exact_codes", "dv_sam", "dv_contigs", sql=f"""with {WALK}, e as (select aln_id, q, k, case when x=y then '=' else 'X' end as op, i, 1 as n from base union all select aln_id, q, k, op, 0, n from ops where op not in ('M','=','X')),
r as (select *, row_number() over (partition by aln_id order by k, i) as a, row_number() over (partition by aln_id, op order by k, i) as b from e), g as (select aln_id, op, min(a) as a, sum(n) as n from r group by aln_id, op, a-b)
select aln_id, string_agg(n::bigint::varchar || op,'' order by a) as cigar from g group by all""")
def _(a, c):
    return pi.exact_codes(a, c)


@query("filter_bad_alignments", "dv_sam", "dv_contigs", sql=f"""with {WALK}, {AT}, n as (select chrom, start, stop, type, allele, count(*) as n from al group by all),
rare as (select n.* from n left join atd using (chrom,start,stop) where n<=3 or n<=0.15*coalesce(depth,0)) select aln_id, count(*) as unsupported from al join rare using (chrom,start,stop,type,allele) where end_distance>=3 group by all having count(*)>1""")
def _(a, c):
    return pi.filter_bad_reads(a, c, 1, 3, 0.15, 3)
