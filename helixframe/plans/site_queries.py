"""More registered queries: annotations, strata and readers over the star-schema tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotypes as g
from ..operators import ancestral, coding, filters, project, strata
from ..operators.spectra import Spectra, TwoSFS
from ..sources import formats, reference, vcf
from . import tables
from .queries import ALT1, CALL, REF, counted, filtered, kept, out, query, r6, spectrum, sql_bins, sql_counted, sql_kept, sql_pmf, sql_round, sql_sfs, sql_two, sql_amino, sql_with_base, two

# ---- filters and strata that look at the reference sequence


def context(spark, d) -> filters.Context:
    return filters.Context(samples=tables.SAMPLES, fasta=tables.fasta(spark, d), cds=tables.stranded(spark, d))


@query("filter_none", sql_kept("true"))
def filter_none(spark, d):
    return filtered(spark, d, filters.NoFilter())


@query("filter_cpg", sql_kept("pos%4 IN (0,3)"))
def filter_cpg(spark, d):
    return kept(filters.apply_filters(tables.sites(spark, d), [filters.CpGFilter()], context(spark, d)))


@query("filter_coding", "WITH cds AS (SELECT p_brand AS c, p_partkey AS s, p_partkey+p_size AS e FROM part WHERE p_size%10=0), st AS (SELECT p_brand AS chrom, p_partkey AS pos FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND EXISTS (SELECT 1 FROM cds WHERE c=p_brand AND p_partkey BETWEEN s AND e)) SELECT chrom, count(*) AS n_sites, CAST(sum(pos) AS BIGINT) AS pos_sum FROM st GROUP BY chrom")
def filter_coding(spark, d):
    return kept(filters.apply_filters(tables.sites(spark, d), [filters.CodingSequenceFilter()], context(spark, d)))


ANCESTOR = f"CASE WHEN size%5=0 THEN {ALT1} ELSE {REF} END"


@query("stratum_context", sql_counted(f"CASE WHEN pos>1 THEN substr('ACGT', CAST((pos-1)%4+1 AS INTEGER), 1) || {ANCESTOR} || substr('ACGT', CAST((pos+1)%4+1 AS INTEGER), 1) END"))
def stratum_context(spark, d):
    ctx, stratum = context(spark, d), strata.BaseContext(1)
    s = stratum.prepare(tables.sites(spark, d), ctx)
    return s.withColumn("type", stratum.label(ctx)).where("type is not null").groupBy("type").agg(F.count("*").alias("n_sites"), F.sum("pos").alias("pos_sum"))


@query("stratum_snpeff", sql_counted("CASE size%3 WHEN 0 THEN 'neutral' WHEN 1 THEN 'selected' END"))
def stratum_snpeff(spark, d):
    ctx, stratum = filters.Context(samples=tables.SAMPLES), strata.SnpEff()
    s = tables.sites(spark, d).withColumn("info", F.map_concat(F.map_filter("info", lambda k, _: k != "CSQ"), F.create_map(F.lit("ANN"), F.col("info")["CSQ"])))
    return s.withColumn("type", stratum.label(ctx)).where("type is not null").groupBy("type").agg(F.count("*").alias("n_sites"), F.sum("pos").alias("pos_sum"))


@query("stratum_degeneracy_callback", sql_counted("CASE size%4 WHEN 1 THEN 'twofold' WHEN 3 THEN 'unknown' END"))
def stratum_degeneracy_callback(spark, d):
    tag = strata.info("Degeneracy")
    return counted(spark, d, strata.Degeneracy(lambda: F.when(tag == "2", "twofold").when(tag == ".", "unknown")))


# ---- codons


def sql_strand(x: str) -> str:
    return f"(CASE WHEN st='+' THEN substr('ACGT', CAST(({x})%4+1 AS INTEGER), 1) ELSE substr('TGCA', CAST(({x})%4+1 AS INTEGER), 1) END)"


CODON = f"""cds AS (SELECT p_brand AS chrom, p_partkey AS s, p_partkey+p_size AS e, CASE WHEN p_size%20=0 THEN '-' ELSE '+' END AS st FROM part WHERE p_size%10=0),
 site AS (SELECT p_brand AS chrom, p_partkey AS pos, p_size AS size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
 hit AS (SELECT * FROM (SELECT site.*, s, e, st, row_number() OVER (PARTITION BY site.pos ORDER BY s, e) AS k FROM site LEFT JOIN cds ON cds.chrom=site.chrom AND pos BETWEEN s AND e) WHERE k=1),
 placed AS (SELECT *, CASE WHEN st='+' THEN (pos-s)%3 ELSE (e-pos)%3 END AS place, CASE WHEN st='+' THEN 1 ELSE -1 END AS dir FROM hit),
 read_at AS (SELECT *, pos-dir*place AS a FROM placed),
 codon AS (SELECT *, CASE WHEN st IS NOT NULL AND a BETWEEN s AND e AND a+2*dir BETWEEN s AND e THEN {sql_strand('a')}||{sql_strand('a+dir')}||{sql_strand('a+2*dir')} END AS codon FROM read_at)"""


@query("degeneracy_annotated", f"WITH {CODON}, alt AS (SELECT *, (SELECT count(*) FROM (VALUES ('A'),('C'),('G'),('T')) v(b) WHERE b<>substr(codon,CAST(place AS INTEGER)+1,1) AND {sql_amino(sql_with_base('codon', 'place', 'b'))}={sql_amino('codon')}) AS n FROM codon) SELECT CASE WHEN codon IS NULL THEN '.' ELSE CASE n WHEN 0 THEN '0' WHEN 3 THEN '4' ELSE '2' END END AS degeneracy, CASE WHEN codon IS NULL THEN '.' ELSE CAST(place AS VARCHAR)||','||st||','||codon END AS info, count(*) AS n_sites, CAST(sum(pos) AS BIGINT) AS pos_sum FROM alt GROUP BY 1,2")
def degeneracy_annotated(spark, d):
    s = coding.annotate_degeneracy(tables.sites(spark, d), context(spark, d))
    return s.groupBy(F.col("info")["Degeneracy"].alias("degeneracy"), F.col("info")["Degeneracy_Info"].alias("info")).agg(F.count("*").alias("n_sites"), F.sum("pos").alias("pos_sum"))


@query("synonymy_annotated", f"WITH {CODON}, alt AS (SELECT *, {sql_with_base('codon', 'place', sql_strand('pos+1+size%3'))} AS other FROM codon) SELECT CASE WHEN codon IS NULL THEN '.' WHEN {sql_amino('codon')}={sql_amino('other')} THEN '1' ELSE '0' END AS synonymy, CASE WHEN codon IS NULL THEN '.' ELSE codon||'/'||other||CASE WHEN other='ATG' THEN ',start_gained' ELSE '' END||CASE WHEN {sql_amino('other')}='*' THEN ',stop_gained' ELSE '' END END AS info, count(*) AS n_sites, CAST(sum(pos) AS BIGINT) AS pos_sum FROM alt GROUP BY 1,2")
def synonymy_annotated(spark, d):
    s = coding.annotate_synonymy(tables.sites(spark, d), context(spark, d))
    return s.groupBy(F.col("info")["Synonymy"].alias("synonymy"), F.col("info")["Synonymy_Info"].alias("info")).agg(F.count("*").alias("n_sites"), F.sum("pos").alias("pos_sum"))


# ---- keys from sites


HAPS = f"WITH {CALL}, h AS (SELECT pos, size, count(*) AS m, count(*) FILTER (WHERE code=CASE WHEN size%5=0 THEN 1 ELSE 0 END) AS anc, count(DISTINCT code) FILTER (WHERE code<>CASE WHEN size%5=0 THEN 1 ELSE 0 END) AS others FROM call GROUP BY ALL)"


@query("sfs_prob_sites", f"{HAPS}, w AS (SELECT *, 1-(size%10)/20.0 AS p FROM h WHERE m>=8 AND size%5<>1 AND others<=1), sfs AS (SELECT 'all' AS type, k AS bin, sum(p*{sql_pmf('m', '(m-anc)', 'k', 8)}+(1-p)*{sql_pmf('m', 'anc', 'k', 8)}) AS mass FROM w, range(0,9) t(k) GROUP BY k) {sql_bins()}")
def sfs_prob_sites(spark, d):
    k = project.site_keys(tables.sites(spark, d), [None], [8], F.lit("all"), prob_tag="AA_prob")
    return out(project.spectrum_1d(k, 8), "type", "bin")


@query("sfs_unpolarized_sites", f"WITH {CALL}, h AS (SELECT pos, size, count(*) AS m, count(*) FILTER (WHERE code=CASE WHEN size%5=0 THEN 1 ELSE 0 END) AS anc, count(DISTINCT code) FILTER (WHERE code<>CASE WHEN size%5=0 THEN 1 ELSE 0 END) AS others FROM call GROUP BY ALL), sfs AS (SELECT 'all' AS type, k AS bin, sum({sql_pmf('m', '(m-anc)', 'k', 8)}) AS mass FROM h, range(0,9) t(k) WHERE m>=8 AND others<=1 GROUP BY k) {sql_bins()}")
def sfs_unpolarized_sites(spark, d):
    k = project.site_keys(tables.sites(spark, d), [None], [8], F.lit("all"), skip_unpolarized=False)
    return out(project.spectrum_1d(k, 8), "type", "bin")


@query("site_classes", f"WITH {CALL}, st AS (SELECT DISTINCT pos, size FROM call) SELECT count(*) AS n, count(*) FILTER (WHERE true) AS snps, CAST(0 AS BIGINT) AS monomorphic, CAST(sum(14) AS BIGINT) AS dummy_haplotypes FROM st")
def site_classes(spark, d):
    s = tables.sites(spark, d).withColumns({"snp": g.snp_flag(), "quiet": g.is_monomorphic(), "dummy": g.dummy_genotypes(7)})
    return s.agg(F.count("*").alias("n"), F.count_if("snp").alias("snps"), F.count_if("quiet").alias("monomorphic"), F.sum(F.size(F.flatten("dummy"))).alias("dummy_haplotypes"))


# ---- text formats, written from the tables and read back


@query("vcf_round_trip", f"WITH {CALL} SELECT pos, count(*) AS n_called, count(DISTINCT code) AS n_alleles, CASE min(size%5) WHEN 1 THEN '.' WHEN 0 THEN min({ALT1}) ELSE min({REF}) END AS aa FROM call GROUP BY pos")
def vcf_round_trip(spark, d):
    path = tables.scratch(spark, "vcf")
    vcf.write_vcf(vcf.from_table(tables.sites(spark, d), tables.SAMPLES), path)
    s = vcf.read_vcf(spark, path).sites
    return s.select("pos", g.n_called().cast("bigint").alias("n_called"), F.size(g.distinct_alleles()).cast("bigint").alias("n_alleles"), F.col("info")["AA"].alias("aa"))


@query("fasta_read", "SELECT p_brand AS contig, CAST(4*(max(p_partkey)//4+30) AS BIGINT) AS length, CAST(max(p_partkey)//4+30 AS BIGINT) AS n_g, substr('ACGT', CAST(max(p_partkey)%4+1 AS INTEGER), 1) AS last FROM part GROUP BY 1")
def fasta_read(spark, d):
    path = tables.scratch(spark, "fasta")
    lines = F.concat(F.lit(">"), "contig", F.lit(" a brand\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    tables.fasta(spark, d).select(lines.alias("value")).write.text(path)
    read = reference.read_fasta(spark, path)
    last = tables.table(spark, d, "part").groupBy(F.col("p_brand").alias("contig")).agg(F.max("p_partkey").alias("pos")).withColumn("chunk", F.floor((F.col("pos") - 1) / reference.CHUNK).cast("int"))
    at = last.join(reference.sequence_chunks(read), ["contig", "chunk"]).select("contig", reference.base_at(F.col("pos")).alias("last"))
    return read.join(at, "contig").select("contig", F.length("seq").cast("bigint").alias("length"), (F.length("seq") - F.length(F.replace("seq", F.lit("G"), F.lit("")))).cast("bigint").alias("n_g"), "last")


@query("gff_read", "SELECT replace(p_brand,'#','_') AS seqid, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS starts, CAST(sum(p_partkey+p_size) AS BIGINT) AS ends, count(*) FILTER (WHERE p_size%20=0) AS minus, min('t'||CAST(p_partkey AS VARCHAR)) AS first_parent FROM part WHERE p_size%10=0 GROUP BY 1")
def gff_read(spark, d):
    path = tables.scratch(spark, "gff")
    cds = tables.stranded(spark, d).withColumn("seqid", F.replace("seqid", F.lit("#"), F.lit("_")))  # a comment starts at #
    fields = ["seqid", F.lit("x"), F.lit("CDS"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("0"), F.concat(F.lit("ID=c;Parent="), "parent")]
    gene = cds.select(F.concat_ws("\t", "seqid", F.lit("x"), F.lit("gene"), F.lit("1"), F.lit("2"), F.lit("."), F.lit("+"), F.lit("."), F.lit("ID=g")).alias("value")).limit(3)
    cds.select(F.concat_ws("\t", *fields).alias("value")).unionByName(gene).write.text(path)
    read = reference.read_cds(spark, path)
    return read.groupBy("seqid").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.count_if(F.col("strand") == "-").alias("minus"), F.min("parent").alias("first_parent"))


@query("polydfe_read", f"WITH {sql_sfs(10, 'CASE WHEN size%2=0 THEN chr(115) ELSE chr(110) END')}, f AS (SELECT CASE type WHEN 'n' THEN 'neutral' ELSE 'selected' END AS type, bin, round(mass, 6) AS mass FROM sfs) SELECT type, CAST(bin AS BIGINT) AS bin, {sql_round('CASE WHEN bin BETWEEN 1 AND 9 THEN mass WHEN bin=0 THEN 1000000-sum(CASE WHEN bin BETWEEN 1 AND 9 THEN mass ELSE 0 END) OVER (PARTITION BY type) ELSE 0 END')} AS mass FROM f")
def polydfe_read(spark, d):
    rows = out(spectrum(spark, d, label=F.when(F.col("size") % 2 == 0, "s").otherwise("n")), "type", "bin").where("bin between 1 and 9")
    counts = rows.groupBy("type").agg(F.sort_array(F.collect_list(F.struct("bin", "mass"))).alias("x"))
    text = counts.select("type", F.concat_ws(" ", F.transform("x", lambda e: e["mass"].cast("string")), F.lit("1000000")).alias("value"))
    path = tables.scratch(spark, "polydfe")
    head = spark.createDataFrame([("", "1 1 10")], "type string, value string")
    head.unionByName(text).repartition(1).sortWithinPartitions("type").select("value").write.text(path)
    return long(spark, formats.read_polydfe(spark, path))


def long(spark, spectra: Spectra):
    rows = [(t, k, float(x)) for t, s in spectra.to_dict().items() for k, x in enumerate(s)]
    return spark.createDataFrame(rows, "type string, bin bigint, mass double").select("type", "bin", r6("mass").alias("mass"))


@query("spectra_csv", f"WITH {sql_sfs(10, 'CASE WHEN size%2=0 THEN chr(115) ELSE chr(110) END')}, f AS (SELECT type, bin, round(mass, 6) AS mass FROM sfs) SELECT type, CAST(bin AS BIGINT) AS bin, {sql_round('mass')} AS mass FROM f")
def spectra_csv(spark, d):
    path = tables.scratch(spark, "csv")
    wide = out(spectrum(spark, d, label=F.when(F.col("size") % 2 == 0, "s").otherwise("n")), "type", "bin").groupBy("bin").pivot("type", ["n", "s"]).agg(F.sum("mass")).orderBy("bin")
    wide.drop("bin").coalesce(1).write.csv(path, header=True)
    return out(formats.spectra_frame(spark, path), "type", "bin")


@query("est_sfs_round_trip", f"WITH {CALL}, cnt AS (SELECT pos, count(*) FILTER (WHERE s<5) AS m, count(DISTINCT code) AS kinds, min(CASE WHEN s=5 THEN code END) AS o1 FROM call GROUP BY pos) SELECT count(*) AS n, count(*) FILTER (WHERE o1 IS NULL) AS n_without_first, CAST(sum(CASE WHEN o1 IS NULL THEN 0 WHEN o1=0 THEN pos%4 ELSE (pos+1+(SELECT p_size FROM part WHERE p_partkey=pos)%3)%4 END) AS BIGINT) AS first_sum FROM cnt WHERE m>=6 AND kinds<=2 AND coalesce(o1,0)<2")
def est_sfs_round_trip(spark, d):
    path = tables.scratch(spark, "est")
    s = tables.sites(spark, d).withColumn("_second", F.expr("exists(gt[5], c -> c = 2) and not exists(gt[5], c -> c < 2)")).where("not coalesce(_second, false)").drop("_second")
    formats.write_est_sfs(ancestral.site_configs(s, [0, 1, 2, 3, 4], [[5], [6]], 6), 6, path)
    first = F.col("outgroup_bases")[0]
    return formats.read_est_sfs(spark, path).agg(F.count("*").alias("n"), F.count_if(first < 0).alias("n_without_first"), F.sum(F.greatest(first, F.lit(0))).cast("bigint").alias("first_sum"))


# ---- containers, filled from a query's few rows


def container(spark, d, n=10) -> Spectra:
    return Spectra.from_long(spectrum(spark, d, n).toPandas(), n)


@query("container_fold", f"WITH {sql_sfs(10)}, f AS (SELECT type, least(bin,10-bin) AS bin, sum(mass) AS mass FROM sfs GROUP BY 1,2) SELECT type, CAST(k AS BIGINT) AS bin, {sql_round('coalesce(mass,0)')} AS mass FROM (SELECT DISTINCT type FROM sfs) t CROSS JOIN range(0,11) r(k) LEFT JOIN f USING (type) WHERE f.bin=k UNION ALL SELECT type, CAST(k AS BIGINT), 0.0 FROM (SELECT DISTINCT type FROM sfs) t CROSS JOIN range(6,11) r(k)")
def container_fold(spark, d):
    return long(spark, container(spark, d).fold())


@query("container_arithmetic", f"WITH {sql_sfs(10)} SELECT type, CAST(bin AS BIGINT) AS bin, {sql_round('(mass*3+mass)/2')} AS mass FROM sfs")
def container_arithmetic(spark, d):
    s = container(spark, d)
    return long(spark, (s * 3 + s) / 2)


@query("container_all", f"WITH {sql_sfs(10)} SELECT 'all' AS type, CAST(bin AS BIGINT) AS bin, {sql_round('sum(mass)')} AS mass FROM sfs GROUP BY bin")
def container_all(spark, d):
    return long(spark, Spectra.from_json(Spectra({"all": container(spark, d).all}).to_json()))


@query("container_subsample", f"WITH {sql_sfs(12)} SELECT type, CAST(k AS BIGINT) AS bin, {sql_round('sum(mass*' + sql_pmf('12', 'bin', 'k', 5) + ')')} AS mass FROM sfs, range(0,6) t(k) GROUP BY 1,2")
def container_subsample(spark, d):
    return long(spark, container(spark, d, 12).subsample(5))


@query("container_normalized", f"WITH {sql_sfs(10)} SELECT type, CAST(bin AS BIGINT) AS bin, {sql_round('mass/sum(mass) OVER (PARTITION BY type)')} AS mass FROM sfs")
def container_normalized(spark, d):
    return long(spark, container(spark, d).normalize())


def matrix(two_frame, n: int) -> TwoSFS:
    data = [[0.0] * (n + 1) for _ in range(n + 1)]
    for r in two_frame.collect():
        data[r["i"]][r["j"]] = r["mass"]
    return TwoSFS(data)


def cells(spark, m, value: str):
    rows = [(i, j, float(x)) for i, row in enumerate(m.data.tolist()) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, f"i bigint, j bigint, {value} double").select("i", "j", r6(value).alias(value))


ALL_TWO = sql_two(6, 200, 0, "chr(97)||chr(108)||chr(108)")
GRID = "range(0,7) a(i), range(0,7) b(j)"


@query("container_two_interior", f"WITH {ALL_TWO} SELECT CAST(a.i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, {sql_round('coalesce((SELECT sum(mass) FROM two WHERE two.i=a.i AND two.j=b.j AND a.i BETWEEN 1 AND 5 AND b.j BETWEEN 1 AND 5),0)')} AS mass FROM {GRID}")
def container_two_interior(spark, d):
    return cells(spark, matrix(two(spark, d), 6).interior(), "mass")


@query("container_two_cov", f"WITH {ALL_TWO}, p AS (SELECT i, j, mass/(SELECT sum(mass) FROM two) AS p FROM two), m AS (SELECT i, sum(p) AS m FROM p GROUP BY 1), g AS (SELECT a.i, b.j, coalesce((SELECT sum(p) FROM p WHERE p.i=a.i AND p.j=b.j),0) AS p, coalesce((SELECT sum(m) FROM m WHERE m.i=a.i),0) AS mi, coalesce((SELECT sum(m) FROM m WHERE m.i=b.j),0) AS mj FROM {GRID}) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {sql_round('CASE WHEN i BETWEEN 1 AND 5 AND j BETWEEN 1 AND 5 THEN p-mi*mj ELSE 0 END')} AS cov FROM g")
def container_two_cov(spark, d):
    return cells(spark, matrix(two(spark, d), 6).cov(), "cov")
