"""Sites from the star-schema tables: a part is a site, its line items are haplotypes.

contig = brand, position = part key, stratum = part type; a line item with status F carries an
alternative allele (the second one for return flag R at every seventh size), its sample is the
supplier key modulo 7. Reference and alternative bases, tags and coding intervals follow from keys.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = [f"s{i}" for i in range(7)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys(spark: SparkSession, sf_dir: str, label=None) -> DataFrame:
    """(type, chrom, pos, site_id, size, m_0, der_0, w) without building genotypes: one aggregation by part."""
    calls = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("m_0"), F.count_if(F.col("l_linestatus") == "F").alias("der_0"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    out = part.join(calls, part["p_partkey"] == calls["l_partkey"]).select(F.col("p_type").alias("type"), F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("site_id"), F.col("p_size").cast("bigint").alias("size"), "m_0", "der_0", F.lit(1.0).alias("w"))
    return out if label is None else out.withColumn("type", label)


def joint_keys(spark: SparkSession, sf_dir: str, flags: str, ns: list[int]) -> DataFrame:
    """Keys of populations given by return flags, of sites where each has enough haplotypes."""
    counts = [x for p, f in enumerate(flags) for x in (F.count_if(F.col("l_returnflag") == f).alias(f"m_{p}"), F.count_if((F.col("l_returnflag") == f) & (F.col("l_linestatus") == "F")).alias(f"der_{p}"))]
    calls = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*counts)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    out = part.join(calls, part["p_partkey"] == calls["l_partkey"])
    for p, n in enumerate(ns):
        out = out.where(F.col(f"m_{p}") >= n)
    return out.select(F.lit("all").alias("type"), F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("pos"), *(x for p in range(len(ns)) for x in (f"m_{p}", f"der_{p}")), F.lit(1.0).alias("w"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site schema with genotypes, one array of allele codes per sample."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    code = F.when(F.col("l_linestatus") == "O", 0).when((F.col("p_size") % 7 == 0) & (F.col("l_returnflag") == "R"), 2).otherwise(1)
    called = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "p_brand", "p_type", "p_size", F.pmod("l_suppkey", F.lit(7)).alias("s"), code.cast("int").alias("code"))
    per_sample = [F.sort_array(F.collect_list(F.when(F.col("s") == i, F.col("code")))).alias(f"g{i}") for i in range(7)]
    grouped = called.groupBy("p_partkey", "p_brand", "p_type", "p_size").agg(*per_sample)

    def base(x):
        return F.element_at(F.array(*(F.lit(b) for b in "ACGT")), (F.pmod(x, F.lit(4)) + 1).cast("int"))

    pos, size = F.col("p_partkey"), F.col("p_size")
    first, second = base(pos + 1 + size % 3), base(pos + 1 + (size + 1) % 3)
    alt = F.when(size % 7 == 0, F.array(first, second)).otherwise(F.array(first))
    aa = F.when(size % 5 == 0, first).when(size % 5 == 1, F.lit(".")).otherwise(base(pos))
    info = F.create_map(
        F.lit("AA"), aa, F.lit("AA_prob"), (1 - (size % 10) / 20).cast("string"), F.lit("Degeneracy"), F.element_at(F.array(*(F.lit(x) for x in ("0", "2", "4", "."))), (size % 4 + 1).cast("int")),
        F.lit("Synonymy"), (size % 2).cast("string"), F.lit("CSQ"), F.when(size % 3 == 0, "synonymous_variant").when(size % 3 == 1, "missense_variant").otherwise("intron_variant"), F.lit("type"), F.col("p_type"),
    )
    no = F.lit(False)
    return grouped.select(
        F.col("p_partkey").alias("site_id"), F.col("p_brand").alias("chrom"), pos.alias("pos"), base(pos).alias("ref"), alt.alias("alt"), F.array(*(f"g{i}" for i in range(7))).alias("gt"),
        F.expr("cast(null as array<boolean>)").alias("phased"), F.lit(True).alias("is_snp"), no.alias("is_mnp"), no.alias("is_indel"), no.alias("is_deletion"), no.alias("is_sv"), no.alias("is_dummy"), info.alias("info"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding intervals: parts of sizes divisible by 10 start one as long as their size."""
    part = table(spark, sf_dir, "part").where(F.col("p_size") % 10 == 0)
    return part.select(F.col("p_brand").alias("seqid"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).cast("bigint").alias("end"), F.lit("+").alias("strand"), F.lit(0).alias("phase"), F.col("p_name").alias("parent"))


def stranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals as transcripts of their own, those of sizes divisible by 20 on the other strand."""
    cds = intervals(spark, sf_dir)
    return cds.withColumns({"strand": F.when((F.col("end") - F.col("start")) % 20 == 0, "-").otherwise("+"), "parent": F.concat(F.lit("t"), F.col("start").cast("string"))})


def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, seq): a sequence per brand that has the reference base of every position, and some more."""
    longest = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("contig")).agg(F.max("p_partkey").alias("_n"))
    return longest.select("contig", F.expr("repeat('CGTA', cast(_n div 4 + 30 as int))").alias("seq"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see; a local master may go without a configured one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset")
        folder = "file://" + tempfile.mkdtemp(prefix="helixframe-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
