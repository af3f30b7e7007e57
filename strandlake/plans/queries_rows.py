"""Queries of projections and filters, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import filters as fl
from strandlake.operators import projections as pr
from strandlake.plans.derived import duck, tables
from strandlake.sources import formats as fm

Q: dict = {}
O: dict = {}
RC = "reverse(translate({0},'ACGTUacgtuMRYKVHDBmrykvhdb','TGCAAtgcaaKYRMBDHVkyrmbdhv'))"


def rc(x: str) -> str:
    return RC.format(x)


def query(name: str, *names: str, sql: str | None = None):
    """Registers fn(*tables) under a name, and SQL that sees the derived tables."""

    def keep(fn):
        Q[name] = lambda spark, sf_dir: fn(*tables(spark, sf_dir, *names))
        if sql is not None:
            derived = [n for n in names if n.startswith("dv_")]
            text = sql.strip()
            O[name] = (duck(*derived) + ((", " + text[5:]) if text.startswith("with ") else text)) if derived else text
        return fn

    return keep


@query("revcomp", "dv_reads", sql=f"select ordinal, {rc('bases')} as bases, reverse(quals) as quals from dv_reads")
def _(r):
    return r.select("ordinal", S.revcomp(F.col("bases")).alias("bases"), F.reverse("quals").alias("quals"))


@query("normalize_bases", "dv_reads", sql="select ordinal, translate(regexp_replace(translate(upper(lower(bases) || 'urX-'),'Uu','Tt'),'[^ACGTNacgtn]','N','g'),'CG','TN') as bases from dv_reads")
def _(r):
    return r.select("ordinal", S.normalize_bases(F.concat(F.lower("bases"), F.lit("urX-")), remap="CTGN").alias("bases"))


@query("rename_reads", "dv_reads", sql="select ordinal, 'read_' || ordinal::varchar as name from dv_reads")
def _(r):
    return pr.rename_reads(r, "read").select("ordinal", "name")


@query("header_edit", "dv_reads", sql="select ordinal, regexp_replace(name || ' x', '\\s', '_', 'g') || ' /1' as a, regexp_extract(name || ' x', '^\\S*', 0) as b, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') as c from dv_reads")
def _(r):
    n = F.concat("name", F.lit(" x"))
    return r.select("ordinal", pr.edit_header(n, 1, underscores=True).alias("a"), pr.edit_header(n, truncate=True).alias("b"), pr.edit_header(F.col("name"), sanitize=True).alias("c"))


@query("unique_names", "dv_reads", sql="select ordinal, case when n > 1 then barcode || '_' || (n - 1)::varchar else barcode end as name from (select ordinal, barcode, row_number() over (partition by barcode order by ordinal) as n from dv_reads)")
def _(r):
    return pr.unique_names(r.select("ordinal", F.col("barcode").alias("name"))).select("ordinal", "name")


@query("header_parse_illumina", "dv_reads", sql="select ordinal, split_part(name,':',1) as machine, split_part(name,':',2)::bigint as run, split_part(name,':',3) as flowcell, split_part(name,':',4)::bigint as lane, split_part(name,':',5)::bigint as tile, split_part(name,':',6)::bigint as x, split_part(name,':',7)::bigint as y, 1::bigint as pair, 'N' as chastity, 0::bigint as control, barcode from dv_reads")
def _(r):
    return r.select("ordinal", S.parse_header(F.concat("name", F.lit(" 1:N:0:"), "barcode")).alias("h")).select("ordinal", "h.*")


@query("header_convert", "dv_reads", sql="select ordinal, 'V3:0:V3:' || (1+ordinal%4)::varchar || ':' || (ordinal%900)::varchar || ':' || (1+ordinal%9)::varchar || ':' || (ordinal%50)::varchar || ' 1:N:0:' || barcode as name from dv_reads")
def _(r):
    p = lambda c, n: F.lpad(c.cast("string"), n, "0")
    o = F.col("ordinal")
    bgi = F.concat(F.lit("V3L"), (1 + o % 4).cast("string"), F.lit("C"), p(1 + o % 9, 3), F.lit("R"), p(o % 50, 3), p(o % 900, 7), F.lit("/1"))
    return r.select("ordinal", S.bgi_to_illumina(bgi, F.col("barcode")).alias("name"))


@query("header_tag_value", "dv_reads", sql="select ordinal, ordinal%17 as v from dv_reads where ordinal%17 between 3 and 9")
def _(r):
    named = r.withColumn("name", F.concat("name", F.lit(" depth="), (F.col("ordinal") % 17).cast("string"), F.lit(" z=1")))
    return fl.filter_by_tag(named, "depth", 3, 9).select("ordinal", S.header_tag(F.col("name"), "depth").cast("bigint").alias("v"))


EE = "list_sum(list_transform(string_split(quals,''), lambda c: pow(10.0, -(ascii(c)-33)/10.0)))"


@query("quality_decode", "dv_reads", sql=f"select ordinal, round({EE},6) as ee, round(-10*log10({EE}/length(quals)),6) as aq, round(list_product(list_transform(string_split(quals,''), lambda c: 1-pow(10.0, -(ascii(c)-33)/10.0))),6) as pc from dv_reads")
def _(r):
    return r.select("ordinal", F.round(S.expected_errors(F.col("quals")), 6).alias("ee"), F.round(S.average_quality(F.col("quals")), 6).alias("aq"), F.round(S.prob_correct(F.col("quals")), 6).alias("pc"))


@query("quality_rewrite", "dv_reads", sql="select ordinal, array_to_string(list_transform(range(1,length(quals)+1), lambda i: chr((case when bases[i]='N' then 0 when ascii(quals[i])-33 >= 37 then 37 when ascii(quals[i])-33 >= 25 then 25 when ascii(quals[i])-33>=11 then 11 else 2 end + 33)::int)),'') as quals from dv_reads")
def _(r):
    return r.select("ordinal", S.recode_quality(F.col("bases"), F.col("quals"), 2, 41, [2, 11, 25, 37]).alias("quals"))


#: Prefix sums of gains; the best run ends where the sum stands highest over the lowest sum before it.
TRIM = "g as (select ordinal, bases, quals, i, sum(0.06309573444801933 - pow(10.0, -(ascii(quals[i])-33)/10.0)) over (partition by ordinal order by i) as p from (select *, unnest(range(1,length(quals)+1)) as i from dv_reads)), h as (select *, coalesce(min(p) over (partition by ordinal order by i rows between unbounded preceding and 1 preceding),0.0) as m from g), l as (select ordinal, i, p, least(m, 0.0) as m from h), e as (select ordinal, arg_max(i, p-m) as b, arg_max(m, p-m) as m, max(p-m) as top from l group by all), a as (select e.ordinal, case when top>0 then b else 0 end as b, case when top>0 then coalesce(max(l.i) filter (where l.p=e.m and l.i<e.b),0)+1 else 1 end as a from e join l using(ordinal) group by e.ordinal, top, b)"


@query("quality_trim", "dv_reads", sql=f"with {TRIM} select ordinal, substr(bases,a::int,(b-a+1)::int) as bases, substr(quals,a::int,(b-a+1)::int) as quals, length(bases)-(b-a+1) as trimmed from dv_reads join a using(ordinal)")
def _(r):
    return r.select("ordinal", pr.quality_trim(F.col("bases"), F.col("quals"), 12.0).alias("t")).select("ordinal", "t.*")


@query("quality_trim_ends", "dv_reads", sql=f"with {TRIM} select ordinal, substr(bases,a::int) as left_trimmed, substr(bases,1,b::int) as right_trimmed from dv_reads join a using(ordinal)")
def _(r):
    t = lambda mode: pr.quality_trim(F.col("bases"), F.col("quals"), 12.0, mode=mode)["bases"]
    return r.select("ordinal", t("left").alias("left_trimmed"), t("right").alias("right_trimmed"))


@query("quality_trim_window", "dv_reads", sql="with w as (select ordinal, i, sum(ascii(quals[i])-33) over (partition by ordinal order by i rows between current row and 3 following) as s, count(*) over (partition by ordinal order by i rows between current row and 3 following) as n from (select *, unnest(range(1,length(quals)+1)) as i from dv_reads)), f as (select ordinal, min(i) as i from w where n=4 and s<20*4 group by all) select ordinal, substr(bases,1,coalesce(i-1,length(bases))::int) as bases from dv_reads left join f using(ordinal)")
def _(r):
    return r.select("ordinal", pr.quality_trim(F.col("bases"), F.col("quals"), 20.0, mode="window")["bases"].alias("bases"))


@query("force_trim", "dv_reads", sql="select ordinal, substr(bases, 6, ((81-5-3) - (81-5-3)%4)::int) as bases from dv_reads")
def _(r):
    return r.select("ordinal", S.force_trim(F.col("bases"), 5, 80, 3, 4).alias("bases"))


@query("pad_seq", "dv_reads", sql="select ordinal, 'NN' || bases || 'NNN' as bases from dv_reads")
def _(r):
    return r.select("ordinal", S.pad(F.col("bases"), 2, 3).alias("bases"))


@query("break_long", "dv_contigs", sql="select contig_id, p as part, substr(bases, (p*25+1)::int, 25) as bases from (select *, unnest(range(0, ceil(length(bases)/25.0)::bigint)) as p from dv_contigs)")
def _(c):
    return pr.break_long(c, 25).select("contig_id", "part", "bases")


@query("shred", "dv_contigs", sql="select contig_id, p as shred, p*20 as start, substr(bases,(p*20+1)::int,30) as bases from (select *, unnest(range(0, case when length(bases)<=30 then 1 else ceil((length(bases)-10)/20.0)::bigint end)) as p from dv_contigs) where length(substr(bases,(p*20+1)::int,30)) >= 15")
def _(c):
    return pr.shred(c, 30, 10, 15).select("contig_id", "shred", "start", "bases")


@query("fuse", "dv_contigs", sql="select contig_id%7 as grp, string_agg(bases, 'NNNNN' order by contig_id) as bases, count(*) as parts from dv_contigs group by 1")
def _(c):
    return pr.fuse(c.withColumn("grp", F.col("contig_id") % 7), "grp", "contig_id", 5)


@query("break_scaffolds", "dv_contigs", sql="with s as (select contig_id, string_split(regexp_replace(bases || 'NN' || substr(bases,1,5), '(N{2,})', '#\\1#', 'g'),'#') as p from dv_contigs), u as (select contig_id, unnest(p) as x, generate_subscripts(p,1) as i from s), o as (select contig_id, x, i, coalesce(sum(length(x)) over (partition by contig_id order by i rows between unbounded preceding and 1 preceding),0)::bigint as start from u) select contig_id, row_number() over (partition by contig_id order by i) - 1 as part, start, x as bases from o where length(x)>0 and not regexp_matches(x,'^N{2,}$')")
def _(c):
    return pr.scaffolds_to_contigs(c.select("contig_id", F.concat("bases", F.lit("NN"), F.left("bases", F.lit(5))).alias("bases")), 2).select("contig_id", "part", "start", "bases")


AA = "coalesce(map_extract(m, substr(s,(i*3+1)::int,3))[1],'X')"
CODONS = "map(list_transform(range(0,64), lambda i: 'TCAG'[(i//16+1)::int] || 'TCAG'[(i//4%4+1)::int] || 'TCAG'[(i%4+1)::int]), string_split('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG',''))"


@query("translate_frames", "dv_contigs", sql=f"with k as (select {CODONS} as m), f as (select contig_id, unnest(range(0,6)) as frame, bases from dv_contigs), g as (select contig_id, frame, substr(case when frame>2 then {rc('bases')} else bases end, (frame%3+1)::int) as s from f) select contig_id, frame, array_to_string(list_transform(range(0, length(s)//3), lambda i: {AA}),'') as amino from g, k")
def _(c):
    return pr.translate6(c).select("contig_id", "frame", "amino")


@query("homopolymer_adjust", "dv_contigs", sql="select contig_id, array_to_string(list_transform(regexp_extract_all(bases,'(A+|C+|G+|T+|N+)'), lambda r: case when length(r)>1 then substr(r,2) else r end),'') as bases from dv_contigs")
def _(c):
    return c.select("contig_id", pr.adjust_homopolymers(F.col("bases"), -1).alias("bases"))


@query("mask_low_complexity", "dv_contigs", sql="with b as (select contig_id, repeat('A',30) || bases as s from dv_contigs), w as (select contig_id, st, substr(s,(st+i)::int,3) as x from (select *, unnest(range(1,length(s)-23)) as st from b), (select unnest(range(0,23)) as i)), c as (select contig_id, st, x, count(*) as c from w group by all), h as (select contig_id, st from c group by all having (ln(23)-sum(c*ln(c))/23)/ln(23)<0.7), m as (select distinct contig_id, unnest(range(st,st+25)) as p from h) select b.contig_id, string_agg(case when m.p is null then substr(s,j::int,1) else 'N' end, '' order by j) as bases from (select *, unnest(range(1,length(s)+1)) as j from b) b left join m on m.contig_id=b.contig_id and m.p=b.j group by b.contig_id")
def _(c):
    return pr.mask_entropy(c.withColumn("bases", F.concat(F.repeat(F.lit("A"), F.lit(30)), "bases")), "contig_id", 25, 3).select("contig_id", "bases")


@query("mask_repeats", "dv_contigs", sql="with k as (select contig_id, i, substr(bases,i::int,2) as x from (select *, unnest(range(1,length(bases))) as i from dv_contigs)), f as (select contig_id, x from k group by all having count(*)>=7), h as (select distinct contig_id, i+d as p from k join f using(contig_id,x), (select unnest([0,1]) as d)) select c.contig_id, string_agg(case when h.p is null then substr(bases,j::int,1) else 'N' end, '' order by j) as bases from (select *, unnest(range(1,length(bases)+1)) as j from dv_contigs) c left join h on c.contig_id=h.contig_id and c.j=h.p group by c.contig_id")
def _(c):
    return pr.mask_repeats(c, "contig_id", 2, 7).select("contig_id", "bases")


@query("mask_by_coverage", "dv_contigs", "dv_aln", sql="with e as (select rname as name, pos as p, 1 as d from dv_aln union all select rname, pos+ref_len, -1 from dv_aln), t as (select name, p, sum(sum(d)) over (partition by name order by p) as depth, lead(p) over (partition by name order by p) as q from e group by name, p), m as (select name, unnest(range(p,q)) as i from t where depth>=20) select contig_id, string_agg(case when m.i is null then c.b else 'N' end, '' order by c.i) as bases from (select contig_id, name, i, bases[i] as b from (select *, unnest(range(1,length(bases)+1)) as i from dv_contigs)) c left join m on m.name=c.name and m.i=c.i group by contig_id")
def _(c, a):
    from strandlake.operators.aggregates import depth_segments

    deep = depth_segments(a).where("depth >= 20").select(F.col("contig").alias("name"), "start", "stop")
    return pr.mask_ranges(c, deep).select("contig_id", "bases")


@query("onehot_spectrum", "dv_contigs", sql="with k as (select contig_id, substr(bases,i::int,2) as x from (select *, unnest(range(1,length(bases))) as i from dv_contigs)), v as (select a.a || b.a as x from (select unnest(['A','C','G','T']) as a) a, (select unnest(['A','C','G','T']) as a) b), n as (select contig_id, x, count(*) as n from k where not regexp_matches(x,'[^ACGT]') group by all), t as (select contig_id, sum(n) as t from n group by all) select c.contig_id, v.x as kmer, round(coalesce(n.n,0)/coalesce(t.t,1),6) as share from dv_contigs c cross join v left join n on n.contig_id=c.contig_id and n.x=v.x left join t on t.contig_id=c.contig_id")
def _(c):
    names = [a + b for a in "ACGT" for b in "ACGT"]
    rows = c.select("contig_id", F.posexplode(pr.spectrum(F.col("bases"), 2)).alias("i", "v"))
    return rows.select("contig_id", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("kmer"), F.round("v", 6).alias("share"))


@query("select_columns", "embeddings", sql="select vec_id, (label%2)::bigint as label from embeddings where label%3 <> 2")
def _(e):
    return pr.reduce_columns(e.select("vec_id", F.when(F.col("label") % 3 == 2, 7).otherwise(F.col("label") % 2).cast("bigint").alias("label")), ["vec_id"], "label")


@query("gff_vector_to_tsv", "dv_features", sql="select feature_id, line, round(feature_id*0.5,6)::double as v1, (line*1.5)::double as v2 from dv_features where line%2=0")
def _(f):
    g = f.withColumn("attribute", F.concat(F.lit("ID=x;VECTOR="), (F.col("feature_id") * 0.5).cast("string"), F.when(F.col("line") % 2 == 0, F.concat(F.lit(","), (F.col("line") * 1.5).cast("string"))).otherwise("")))
    out = pr.gff_to_features(g, 2)
    return out.select("feature_id", "line", F.round(F.col("vector")[0], 6).alias("v1"), F.col("vector")[1].alias("v2"))


@query("vcf_to_gff", "dv_var", sql="select chrom as seqid, 'variants' as source, 'SNV' as type, pos as start, pos as stop, round(qual,6)::double as score, '+' as strand, 'ref=' || ref || ';alt=' || alt as attribute from dv_var where ref<>alt")
def _(v):
    return pr.vcf_to_gff(v.where("ref <> alt")).withColumn("score", F.round("score", 6).cast("double"))


@query("split_alleles", "dv_var", sql="select chrom, pos, ref, a as alt, count(*) as n from (select chrom, pos, ref, unnest([alt, ref || 'T']) as a from dv_var) group by all")
def _(v):
    return pr.split_alleles(v.withColumn("alt", F.concat("alt", F.lit(","), "ref", F.lit("T")))).groupBy("chrom", "pos", "ref", "alt").agg(F.count("*").alias("n"))


@query("split_substitutions", "dv_var", sql="select chrom, p as pos, r as ref, a as alt, count(*) as n from (select chrom, unnest([pos,pos+1]) as p, unnest([ref,alt]) as r, unnest([alt,'G']) as a from dv_var) where r<>a group by all")
def _(v):
    w = v.select("chrom", "pos", F.concat("ref", "alt").alias("ref"), F.concat("alt", F.lit("G")).alias("alt"))
    return pr.split_substitutions(w).groupBy("chrom", "pos", "ref", "alt").agg(F.count("*").alias("n"))


@query("canonize", "dv_var", sql="with w as (select chrom, pos, 'C' || ref || 'GT' as ref, 'C' || alt || 'AGT' as alt from dv_var where ref<>alt), t as (select *, (select coalesce(max(n),0) from unnest(range(1,least(length(ref),length(alt)))) u(n) where substr(ref,length(ref)-n+1)=substr(alt,length(alt)-n+1)) as tail from w), u as (select chrom, pos, ref[:length(ref)-tail] as ref, alt[:length(alt)-tail] as alt from t), h as (select *, (select coalesce(max(n),0) from unnest(range(1,least(length(ref),length(alt)))) u(n) where substr(ref,1,n::int)=substr(alt,1,n::int)) as head from u) select chrom, pos+head as pos, substr(ref,(head+1)::int) as ref, substr(alt,(head+1)::int) as alt, count(*) as n from h group by all")
def _(v):
    w = v.where("ref <> alt").select("chrom", "pos", F.concat(F.lit("C"), "ref", F.lit("GT")).alias("ref"), F.concat(F.lit("C"), "alt", F.lit("AGT")).alias("alt"))
    return pr.canonize(w).groupBy("chrom", "pos", "ref", "alt").agg(F.count("*").alias("n"))


@query("unicode_to_ascii", "documents", sql=r"select doc_id, md5(regexp_replace(translate(text,'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜàáâãäåçèéêëìíîïñòóôõöùúûü','AAAAAACEEEEIIIINOOOOOUUUUaaaaaaceeeeiiiinooooouuuu'),'[^\x20-\x7E]','?','g')) as h from documents")
def _(d):
    return d.select("doc_id", F.md5(S.to_ascii(F.col("text"))).alias("h"))


@query("sam_version", "dv_aln", sql="select aln_id, (ref_len+3)::varchar || 'M2I' || (pos)::varchar || 'M' as cigar from dv_aln")
def _(a):
    c = F.concat(F.col("ref_len").cast("string"), F.lit("=3X2I"), F.col("pos").cast("string"), F.lit("="))
    return pr.sam_to_old(a.select("aln_id", c.alias("cigar")))


# -- filters ----------------------------------------------------------------------------------------------------


@query("filter_length_gc_n", "dv_reads", sql=f"select ordinal from dv_reads where (length(bases)-length(translate(bases,'GC','')))/nullif(length(bases)-length(translate(bases,'ACGT','')),0) between 0.45 and 0.6 and length(bases)-length(replace(bases,'N',''))<=6 and regexp_matches(bases,'[ACGT]{{20,}}') and -10*log10({EE}/length(quals)) >= 10")
def _(r):
    return fl.filter_reads(r, minlen=50, mingc=0.45, maxgc=0.6, maxns=6, mcb=20, maq=10).select("ordinal")


@query("filter_pairs", "dv_reads", sql="select ordinal from dv_reads where length(bases)-length(replace(bases,'N',''))<=5 or length(substr(bases,1,48))-length(replace(substr(bases,1,48),'N',''))<=5")
def _(r):
    p = r.select("ordinal", F.col("bases").alias("bases1"), F.col("quals").alias("quals1"), F.left("bases", F.lit(48)).alias("bases2"), F.left("quals", F.lit(48)).alias("quals2"))
    return fl.filter_pairs(p, maxns=5).select("ordinal")


@query("filter_junk", "dv_reads", sql="select ordinal from dv_reads where ordinal%5<>0")
def _(r):
    return fl.filter_junk(r.withColumn("bases", F.when(F.col("ordinal") % 5 == 0, F.concat("bases", F.lit("1"))).otherwise(F.col("bases"))).withColumn("quals", F.when(F.col("ordinal") % 5 == 0, F.concat("quals", F.lit("I"))).otherwise(F.col("quals")))).select("ordinal")


@query("filter_flowcell_side", "dv_reads", sql="select ordinal from dv_reads where 1101+ordinal%8 < 2000")
def _(r):
    return fl.filter_surface(r).select("ordinal")


@query("filter_lines", "pages", "region", sql="select page_id from pages where exists (select 1 from region where contains(lower(url), substr(lower(r_name),1,3)))")
def _(p, r):
    return fl.filter_lines(p.withColumnRenamed("url", "value"), r.select(F.left("r_name", F.lit(3))), "contains", True, True).select("page_id")


@query("clean_tsv", "dv_features", sql="select feature_id, line from dv_features where line<>7")
def _(f):
    v = F.concat_ws("\t", "seqid", "type", F.when(F.col("line") == 7, F.lit("x")), F.lit("\t"))
    return fl.clean_tsv(f.withColumn("value", v)).select("feature_id", "line")


@query("filter_by_id", "dv_reads", "part", sql="select ordinal, name from dv_reads where ordinal in (select p_partkey*3 from part)")
def _(r, p):
    return fl.get_reads(r, p.select((F.col("p_partkey") * 3).alias("id"))).select("ordinal", "name")


@query("filter_by_name", "dv_reads", "part", sql="select ordinal from dv_reads where name not in (select name from dv_reads where ordinal in (select p_partkey*2 from part))")
def _(r, p):
    names = r.join(p.select((F.col("p_partkey") * 2).alias("ordinal")), "ordinal", "left_semi").select("name")
    return fl.filter_by_name(r.withColumn("name", F.concat("name", F.lit(" 1:N"))), names).select("ordinal")


@query("filter_by_sequence", "dv_reads", sql=f"with k as (select distinct least(bases,{rc('bases')}) as b from dv_reads where ordinal<200) select ordinal from dv_reads where least(bases,{rc('bases')}) in (select b from k)")
def _(r):
    return fl.filter_by_sequence(r, r.where("ordinal < 200").select(S.revcomp(F.col("bases")).alias("bases"))).select("ordinal")


@query("filter_by_sequence_inexact", "dv_reads", sql="with k as (select distinct substr(bases,1,12) as b from dv_reads where ordinal<60), q as (select distinct substr(bases,1,12) as s from dv_reads), h as (select distinct s from q join k on hamming(s,b)<=2) select ordinal from dv_reads where substr(bases,1,12) in (select s from h)")
def _(r):
    s = r.select("ordinal", F.left("bases", F.lit(12)).alias("bases"))
    return fl.filter_by_sequence(s, s.where("ordinal < 60").select("bases"), subs=2, rcomp=False).select("ordinal")


def sam_like(a):
    cigar = F.concat(F.col("ref_len").cast("string"), F.lit("="), (1 + F.col("pos") % 3).cast("string"), F.lit("X2I1D4S"))
    flag = (F.col("strand") * 16 + F.when(F.col("rf") == "R", 4).otherwise(0) + F.when(F.col("pos") % 7 == 0, 1024).otherwise(0)).cast("int")
    return a.withColumns({"cigar": cigar, "flag": flag})


@query("filter_alignments", "dv_aln", sql="select aln_id from dv_aln where rf<>'R' and pos%7<>0 and mapq between 10 and 30 and pos<=20 and pos+ref_len+1+pos%3+1-1>=15")
def _(a):
    return fl.filter_sam(sam_like(a), mapped=True, duplicate=False, min_mapq=10, max_mapq=30, start=15, stop=20).select("aln_id")


@query("split_alignments", "dv_aln", sql="select case when rf='R' then 'unmapped' when strand=1 then 'minus' else 'plus' end as route, count(*) as n from dv_aln group by all")
def _(a):
    return fl.split_sam(sam_like(a)).groupBy("route").agg(F.count("*").alias("n"))


@query("filter_edits", "dv_aln", sql="select aln_id from dv_aln where 1+pos%3<=2 and ref_len/(ref_len+1+pos%3+3) >= 0.8")
def _(a):
    return fl.filter_edits(sam_like(a), max_subs=2, max_clips=4, min_identity=0.8).select("aln_id")


@query("filter_sub_quality", "dv_reads", sql="select ordinal from (select ordinal, unnest(range(1,length(bases)+1)) as i, bases, reverse(bases) as r, quals from dv_reads) where bases[i]<>r[i] and ascii(quals[i])-33 between 30 and 40 group by ordinal having count(*)>=55")
def _(r):
    return fl.filter_subs(r.withColumn("ref_bases", F.reverse("bases")), 30, 40, 55).select("ordinal")


@query("filter_vcf", "dv_var", sql="select chrom, pos, ref, alt, sample, round(qual,6)::double as qual from dv_var where ref<>alt and pos between 5 and 25 and qual>=100")
def _(v):
    return fl.filter_vcf(v, min_qual=100, start=5, stop=25).withColumn("qual", F.round("qual", 6).cast("double"))


@query("filter_poly", "dv_reads", sql="with k as (select ordinal, least(x," + rc("x") + ") as kmer from (select ordinal, substr(bases,(i+1)::int,12) as x from (select *, unnest(range(0,length(bases)-11)) as i from dv_reads)) where not regexp_matches(x,'[^ACGT]')), r as (select kmer from k group by all having count(*)<12), l as (select ordinal, count(r.kmer)/count(*) as low from k left join r using(kmer) group by all), e as (select ordinal, x, count(*) as c from (select ordinal, substr(bases,(i+1)::int,3) as x from (select *, unnest(range(0,length(bases)-2)) as i from dv_reads)) where not regexp_matches(x,'[^ACGT]') group by all), h as (select ordinal, round((ln(sum(c))-sum(c*ln(c))/sum(c))/ln(least(sum(c),64)),9) as entropy from e group by all), q as (select ordinal, round(-10*log10(list_sum(list_transform(string_split(quals,''), lambda c: pow(10.0,-(ascii(c)-33)/10.0)))/length(quals)),9) as q from dv_reads) select ordinal from dv_reads join q using(ordinal) left join l using(ordinal) left join h using(ordinal) where not (regexp_matches(bases,'G{6,}|C{6,}') or low>=0.9 or coalesce(entropy,1)<0.2 or q<9 or (regexp_matches(bases,'G{4,}|C{4,}') and (coalesce(low,0)>=0.24 or coalesce(entropy,1)<0.9 or q<10)))")
def _(r):
    return fl.filter_poly(r, "GC", 12, 12, 4, 6, 0.24, 0.9, 0.9, 0.2, 10, 9, 3).select("ordinal")


@query("filter_homopolymer", "dv_reads", sql="select ordinal from dv_reads where not regexp_matches(bases,'G{4,}|C{4,}')")
def _(r):
    return fl.filter_homopolymer(r, "GC", 4).select("ordinal")


TILE = "with t as (select ordinal, 1+ordinal%4 as lane, 1101+ordinal%8 as tile, ((ordinal*37)%5000)//1000 as bx, ((ordinal*91)%5000)//1000 as cy, ordinal%13 as q from dv_reads), g as (select lane,tile,bx,cy,count(*) as reads,avg(q) as q from t group by all), m as (select avg(reads) as mr from g), c as (select g.*, reads>=least(20, mr/4) as ok from g, m), s as (select avg(q) as a, stddev_pop(q) as d from c where ok), b as (select lane,tile,bx,cy from c, s where ok and a-q>1.0*d and a-q>0.02*abs(a) and a-q>0) select ordinal from t where not exists (select 1 from b where b.lane=t.lane and b.tile=t.tile and b.bx=t.bx and b.cy=t.cy)"


@query("filter_tile_outliers", "dv_reads", sql=TILE)
def _(r):
    rows = r.select("ordinal", S.parse_header(F.col("name")).alias("h"), (F.col("ordinal") % 13).alias("q")).select("ordinal", "q", "h.lane", "h.tile", "h.x", "h.y")
    return fl.filter_by_tile(rows, ["q"], 1000, 1000, [1.0], [0.02], [0.0], 20).select("ordinal")


@query("filter_by_coverage", "dv_contigs", "dv_aln", sql="with g as (select rname as name, count(*) as reads, sum(ref_len) as b from dv_aln group by all) select c.name, coalesce(g.reads<30 or length(bases)<50 or g.b/length(bases)<15 or false, true) as dirty from dv_contigs c left join g using(name)")
def _(c, a):
    n = a.groupBy(F.col("rname").alias("name")).agg(F.count("*").alias("reads"), F.sum("ref_len").alias("b"))
    cov = n.join(c.select("name", F.length("bases").alias("len")), "name").select("name", "reads", F.lit(100.0).alias("percent"), (F.col("b") / F.col("len")).alias("fold"))
    return fl.coverage_verdict(c.select("name", F.length("bases").alias("length")), cov, None, 30, 50, 40.0, 15.0).select("name", "dirty")


@query("filter_hits", "dv_var", sql="select sample, chrom, pos from dv_var where qual>=250")
def _(v):
    return fl.filter_hits(v.withColumnRenamed("qual", "score"), 250).select("sample", "chrom", "pos")


@query("sink_demux", "dv_reads", sql="select case when ordinal%24<10 then barcode else 'unmatched' end as route, count(*) as n from dv_reads group by all")
def _(r):
    return fm.demux(r, F.col("barcode"), r.where("ordinal % 24 < 10").select("barcode")).groupBy("route").agg(F.count("*").alias("n"))


@query("sink_partition", "dv_reads", sql="select ordinal%7 as part, count(*) as n, min(ordinal) as first from dv_reads group by all")
def _(r):
    return fm.partition_evenly(r, 7).groupBy("part").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))


@query("sink_report_json", "nation", sql="""select '{"n_nationkey":' || n_nationkey::varchar || ',"n_name":"' || n_name || '"}' as json from nation""")
def _(n):
    return fm.to_json_report(n.select("n_nationkey", "n_name"))
