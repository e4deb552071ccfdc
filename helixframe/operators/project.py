"""From sites to spectra.

Sites are reduced to (stratum, haplotypes called, derived) first and counted; only the few different
keys are then projected to ``n`` and exploded into bins. The cost of a projection so depends on the
number of different keys and not on that of the sites, and one shuffle of keys is all that moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotypes as g
from ..functions import hypergeometric as h
from .strata import info


def ancestral_allele(tag: str, skip_unpolarized: bool) -> Column:
    """SNPs: the tag where it is a base, else null when such sites are skipped; otherwise the reference base."""
    aa = F.upper(info(tag))
    ref = F.when(g.is_base(F.col("ref")), F.col("ref"))
    snp = F.when(g.is_base(aa), aa) if skip_unpolarized else F.when(g.is_base(aa), aa).otherwise(ref)
    return F.when(F.col("is_snp"), snp).otherwise(ref)


def ancestral_probability(tag: str) -> Column:
    raw = info(tag)
    p = F.when(raw.isNull() | raw.isin("", "."), F.lit(1.0)).otherwise(raw.try_cast("double"))
    return F.when((p >= 0) & (p <= 1), p).otherwise(F.raise_error(F.concat(F.lit("not a probability: "), raw)).cast("double"))


def site_keys(sites: DataFrame, masks: Sequence[Sequence[int] | None], ns: Sequence[int], label: Column, tag: str = "AA", prob_tag: str | None = None, skip_unpolarized: bool = True) -> DataFrame:
    """(type, chrom, pos, site_id, m_0, der_0, m_1, ..., w): one or two weighted keys per site that projects.

    A site needs ``ns`` called haplotypes in every population, an ancestral allele, and at most two
    alleles counting that one. A site without variation puts all its haplotypes at the reference, or
    at the derived end where the ancestral tag names another base. With ``prob_tag`` a site's weight
    is split between its key and the key with ancestral and derived exchanged.
    """
    pops = range(len(ns))
    haps = {f"_h{p}": g.haplotypes(masks[p]) for p in pops}
    df = sites.withColumns(haps)
    df = df.withColumns({f"m_{p}": F.size(f"_h{p}") for p in pops})
    enough = F.lit(True)
    for p in pops:
        enough &= F.col(f"m_{p}") >= ns[p]
    df = df.where(enough & (F.col("is_snp") | g.is_monomorphic()))
    df = df.withColumn("_aa", ancestral_allele(tag, skip_unpolarized)).where(F.col("_aa").isNotNull())
    seen = F.array_distinct(F.concat(F.array("_aa"), *(F.col(f"_h{p}") for p in pops)))
    df = df.where(~F.col("is_snp") | (F.size(seen) <= 2))
    aa = F.upper(info(tag))
    fixed = g.is_base(aa) & (aa != F.col("ref"))
    der = {f"der_{p}": F.when(F.col("is_snp"), F.col(f"m_{p}") - g.count_of(F.col(f"_h{p}"), F.col("_aa"))).otherwise(F.when(fixed, F.col(f"m_{p}")).otherwise(0)) for p in pops}
    df = df.withColumns(der).withColumn("type", label).where(F.col("type").isNotNull())
    names = [x for p in pops for x in (f"m_{p}", f"der_{p}")]
    if prob_tag is None:
        return df.select("type", "chrom", "pos", "site_id", *names, F.lit(1.0).alias("w"))
    flipped = F.struct(*(x for p in pops for x in (F.col(f"m_{p}").alias(f"m_{p}"), (F.col(f"m_{p}") - F.col(f"der_{p}")).alias(f"der_{p}"))), (1 - F.col("_p")).alias("w"))
    plain = F.struct(*names, F.col("_p").alias("w"))
    both = df.withColumn("_p", ancestral_probability(prob_tag)).withColumn("_k", F.explode(F.array(plain, flipped)))
    return both.select("type", "chrom", "pos", "site_id", *(F.col(f"_k.{x}").alias(x) for x in [*names, "w"])).where("w > 0")


def drawn(keys: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Keys of ``n`` haplotypes: each site's derived count is one draw, the same that a random ``spectrum_1d`` makes."""
    return keys.withColumn("der_0", h.draw(F.col("m_0"), F.col("der_0"), n, "chrom", "pos", "der_0", seed=seed)).withColumn("m_0", F.lit(n))


def spectrum_1d(keys: DataFrame, n: int, mode: str = "probabilistic", seed: int = 0) -> DataFrame:
    """(type, bin, mass) over keys (type, m_0, der_0, w). ``random`` draws each site once."""
    if mode == "random":
        drawn = keys.withColumn("bin", h.draw(F.col("m_0"), F.col("der_0"), n, "chrom", "pos", "der_0", seed=seed))
        return drawn.groupBy("type", "bin").agg(F.sum("w").alias("mass"))
    counted = keys.groupBy("type", "m_0", "der_0").agg(F.sum("w").alias("w"))
    bins = counted.select("type", "w", F.posexplode(h.pmf_array(F.col("m_0"), F.col("der_0"), n)).alias("bin", "p"))
    return bins.groupBy("type", "bin").agg(F.sum(F.col("w") * F.col("p")).alias("mass"))


def spectrum_joint(keys: DataFrame, ns: Sequence[int], mode: str = "probabilistic", seed: int = 0) -> DataFrame:
    """(type, k_0, k_1, ..., mass): the outer product of the populations' projections, summed over sites."""
    pops = range(len(ns))
    if mode == "random":
        out = keys.withColumns({f"k_{p}": h.draw(F.col(f"m_{p}"), F.col(f"der_{p}"), ns[p], "chrom", "pos", f"der_{p}", seed=seed + p) for p in pops})
        return out.groupBy("type", *(f"k_{p}" for p in pops)).agg(F.sum("w").alias("mass"))
    out = keys.groupBy("type", *(x for p in pops for x in (f"m_{p}", f"der_{p}"))).agg(F.sum("w").alias("w"))
    for p in pops:
        # sum over this population's keys before the next one is exploded: keys that agree from here on become one
        left = [x for q in pops[p + 1 :] for x in (f"m_{q}", f"der_{q}")]
        bins = out.select("type", "w", *(f"k_{q}" for q in pops[:p]), *left, F.posexplode(h.pmf_array(F.col(f"m_{p}"), F.col(f"der_{p}"), ns[p])).alias(f"k_{p}", "_p")).where("_p > 0")
        out = bins.groupBy("type", *(f"k_{q}" for q in pops[: p + 1]), *left).agg(F.sum(F.col("w") * F.col("_p")).alias("w"))
    return out.withColumnRenamed("w", "mass")


def two_site(keys: DataFrame, n: int, d: int, offset: int = 0) -> DataFrame:
    """(type, i, j, mass): ordered pairs on a contig and stratum at a distance in (offset, offset + d], symmetrised.

    A range join on bins as wide as the reach: the later site meets the one or two bins in which an
    earlier one can lie, so a long contig is spread over as many tasks as it has bins. Pairs are
    counted by their sites' keys before any bin is made.
    """
    if d < 1 or offset < 0:
        raise ValueError("the distance must be positive and the offset not negative")
    width = offset + d
    key = ["type", "m_0", "der_0"]
    # sites of one place and key act together
    sites = keys.groupBy("chrom", "pos", *key).agg(F.sum("w").alias("w"))
    early = sites.select(*(F.col(c).alias(f"a_{c}") for c in ["chrom", "pos", *key, "w"]), F.floor(F.col("pos") / width).alias("bin"))
    reach = F.array_distinct(F.array(F.floor((F.col("pos") - width) / width), F.floor((F.col("pos") - offset - 1) / width)))
    late = sites.withColumn("bin", F.explode(reach))
    gap = F.col("pos") - F.col("a_pos")
    pairs = late.join(early, (F.col("chrom") == F.col("a_chrom")) & (F.col("type") == F.col("a_type")) & (late["bin"] == early["bin"]) & (gap > offset) & (gap <= width))
    counted = pairs.groupBy("type", "a_m_0", "a_der_0", "m_0", "der_0").agg(F.sum(F.col("w") * F.col("a_w")).alias("w"))
    return _outer(counted, n)


def _outer(counted: DataFrame, n: int) -> DataFrame:
    out = counted.select("type", "w", "m_0", "der_0", F.posexplode(h.pmf_array(F.col("a_m_0"), F.col("a_der_0"), n)).alias("i", "p")).where("p > 0")
    # sum over the earlier site's keys before the later one is exploded
    out = out.groupBy("type", "i", "m_0", "der_0").agg(F.sum(F.col("w") * F.col("p")).alias("w"))
    out = out.select("type", "i", "w", F.posexplode(h.pmf_array(F.col("m_0"), F.col("der_0"), n)).alias("j", "q")).where("q > 0")
    half = out.groupBy("type", "i", "j").agg(F.sum(F.col("w") * F.col("q")).alias("mass"))
    cells = half.select("type", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("c"), (F.col("mass") / 2).alias("mass"))
    return cells.groupBy("type", F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(F.sum("mass").alias("mass"))


def two_site_window(keys: DataFrame, n: int, d: int, offset: int = 0) -> DataFrame:
    """The same as ``two_site`` for dense sites: running sums of the earlier sites' projections.

    One range frame over ``n + 1`` columns. Contigs are cut into blocks of many reaches, each with a
    copy of the reach before it, so a contig is as many tasks as it has blocks.
    """
    from pyspark.sql import Window

    width = offset + d
    block = 64 * width
    sites = keys.withColumn("_v", h.pmf_array(F.col("m_0"), F.col("der_0"), n)).withColumn("_own", F.floor(F.col("pos") / block))
    copies = F.array_distinct(F.array(F.col("_own"), F.floor((F.col("pos") + width) / block)))
    cut = sites.withColumn("_block", F.explode(copies))
    frame = Window.partitionBy("type", "chrom", "_block").orderBy("pos").rangeBetween(-width, -(offset + 1))
    sums = F.array(*(F.coalesce(F.sum(F.col("w") * F.col("_v")[k]).over(frame), F.lit(0.0)) for k in range(n + 1)))
    seen = cut.withColumn("_before", sums).where(F.col("_block") == F.col("_own"))
    cells = seen.select("type", "w", F.col("_v"), F.posexplode("_before").alias("i", "p")).where("p > 0").select("type", "i", (F.col("w") * F.col("p")).alias("p"), F.posexplode("_v").alias("j", "q")).where("q > 0")
    half = cells.groupBy("type", "i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("mass"))
    both = half.select("type", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("c"), (F.col("mass") / 2).alias("mass"))
    return both.groupBy("type", F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(F.sum("mass").alias("mass"))
