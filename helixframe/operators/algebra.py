"""Spectrum algebra over long frames: (type, bin, mass), (type, k_0, ..., mass) and (type, i, j, mass)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hypergeometric as h


def dense(sfs: DataFrame, n: int) -> DataFrame:
    """Every bin 0..n of every type, absent ones with mass 0."""
    grid = sfs.select("type").distinct().select("type", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("bin"))
    return grid.join(sfs, ["type", "bin"], "left").select("type", "bin", F.coalesce("mass", F.lit(0.0)).alias("mass"))


def interior(n: int) -> Column:
    return F.col("bin").between(1, n - 1)


def fold(sfs: DataFrame, n: int) -> DataFrame:
    return sfs.groupBy("type", F.least(F.col("bin"), n - F.col("bin")).alias("bin")).agg(F.sum("mass").alias("mass"))


def misidentify(sfs: DataFrame, n: int, epsilon: float) -> DataFrame:
    """Each interior bin gives ``epsilon`` of its mass to its mirror bin."""
    moved = F.explode(F.when(interior(n), F.array(F.struct(F.col("bin").alias("b"), (F.col("mass") * (1 - epsilon)).alias("x")), F.struct((n - F.col("bin")).alias("b"), (F.col("mass") * epsilon).alias("x")))).otherwise(F.array(F.struct(F.col("bin").alias("b"), F.col("mass").alias("x")))))
    return sfs.select("type", moved.alias("e")).groupBy("type", F.col("e.b").alias("bin")).agg(F.sum("e.x").alias("mass"))


def subsample(sfs: DataFrame, n: int, to: int) -> DataFrame:
    """Project a spectrum of ``n`` down to ``to``."""
    if not 0 < to < n:
        raise ValueError("the new sample size must be smaller")
    out = sfs.select("type", "mass", F.posexplode(h.pmf_array(F.lit(n), F.col("bin"), to)).alias("k", "p"))
    return out.groupBy("type", F.col("k").alias("bin")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))


def normalize_interior(sfs: DataFrame, n: int) -> DataFrame:
    """Interior bins divided by their sum; the monomorphic bins stay."""
    total = F.sum(F.when(interior(n), F.col("mass")).otherwise(0.0)).over(Window.partitionBy("type"))
    return sfs.select("type", "bin", F.when(interior(n), F.col("mass") / total).otherwise(F.col("mass")).alias("mass"))


def normalize_all(sfs: DataFrame) -> DataFrame:
    total = F.sum("mass").over(Window.partitionBy("type"))
    return sfs.select("type", "bin", (F.col("mass") / F.when(total == 0, 1.0).otherwise(total)).alias("mass"))


def summary(sfs: DataFrame, n: int) -> DataFrame:
    """Per type: n_sites, n_monomorphic, n_polymorphic, n_div and Watterson's theta, total and per site."""
    harmonic = sum(1 / i for i in range(1, n))
    out = sfs.groupBy("type").agg(
        F.sum("mass").alias("n_sites"), F.sum(F.when(interior(n), F.col("mass")).otherwise(0.0)).alias("n_polymorphic"), F.sum(F.when(F.col("bin") == n, F.col("mass")).otherwise(0.0)).alias("n_div")
    )
    return out.select("type", "n_sites", (F.col("n_sites") - F.col("n_polymorphic")).alias("n_monomorphic"), "n_polymorphic", "n_div", (F.col("n_polymorphic") / harmonic).alias("theta_total"), (F.col("n_polymorphic") / harmonic / F.col("n_sites")).alias("theta"))


def scale_theta(sfs: DataFrame, n: int, theta: float) -> DataFrame:
    """Interior scaled to ``theta`` per site; bin 0 takes up the difference, so the total stays."""
    w = Window.partitionBy("type")
    harmonic = sum(1 / i for i in range(1, n))
    poly = F.sum(F.when(interior(n), F.col("mass")).otherwise(0.0)).over(w)
    factor = theta / (poly / harmonic / F.sum("mass").over(w))
    return sfs.select("type", "bin", F.when(interior(n), F.col("mass") * factor).when(F.col("bin") == 0, F.col("mass") + poly * (1 - factor)).otherwise(F.col("mass")).alias("mass"))


def merge_groups(sfs: DataFrame, levels: Sequence[int], keys: Sequence[str] = ("bin",)) -> DataFrame:
    """Sum over all but the given dot-separated levels of the type."""
    parts = F.split("type", r"\.")
    name = F.concat_ws(".", *(F.get(parts, F.lit(k)) for k in levels))
    checked = F.when(F.size(parts) > max(levels), name).otherwise(F.raise_error(F.concat(F.lit("too few levels: "), F.col("type"))).cast("string"))
    return sfs.groupBy(checked.alias("type"), *keys).agg(F.sum("mass").alias("mass"))


def select(sfs: DataFrame, patterns: str | Sequence[str], regex: bool = True) -> DataFrame:
    """Types that match one of the patterns as a whole."""
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    return sfs.where(F.col("type").rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$") if regex else F.col("type").isin(*patterns))


def rename(sfs: DataFrame, names: dict[str, str]) -> DataFrame:
    new = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else None
    return sfs if new is None else sfs.withColumn("type", F.coalesce(F.try_element_at(new, F.col("type")), F.col("type")))


def prefix(sfs: DataFrame, text: str) -> DataFrame:
    return sfs.withColumn("type", F.concat(F.lit(text + "."), F.col("type")))


def replace_dots(sfs: DataFrame, by: str = "_") -> DataFrame:
    return sfs.withColumn("type", F.replace(F.col("type"), F.lit("."), F.lit(by)))


def reorder_levels(sfs: DataFrame, order: Sequence[int]) -> DataFrame:
    parts = F.split("type", r"\.")
    return sfs.withColumn("type", F.concat_ws(".", *(F.get(parts, F.lit(k)) for k in order)))


def total(sfs: DataFrame, keys: Sequence[str] = ("bin",)) -> DataFrame:
    return sfs.groupBy(*keys).agg(F.sum("mass").alias("mass")).select(F.lit("all").alias("type"), *keys, "mass")


def add(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("bin",)) -> DataFrame:
    """Sum by type, absent bins as 0."""
    return a.unionByName(b).groupBy("type", *keys).agg(F.sum("mass").alias("mass"))


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """All types of both; those of ``b`` win."""
    return a.join(b.select("type").distinct(), "type", "left_anti").unionByName(b.select(*a.columns))


def drop_empty(sfs: DataFrame) -> DataFrame:
    return sfs.withColumn("_any", F.max(F.abs("mass")).over(Window.partitionBy("type"))).where("_any > 0").drop("_any")


def drop_zero_entries(sfs: DataFrame, n: int) -> DataFrame:
    """Types none of whose bins 0..n-1 is 0."""
    least = F.min(F.when(F.col("bin") < n, F.abs("mass"))).over(Window.partitionBy("type"))
    return dense(sfs, n).withColumn("_least", least).where("_least > 0").drop("_least")


def drop_sparse(sfs: DataFrame, n: int, least: float) -> DataFrame:
    """Types whose interior holds more than ``least``."""
    inside = F.sum(F.when(interior(n), F.col("mass")).otherwise(0.0)).over(Window.partitionBy("type"))
    return sfs.withColumn("_inside", inside).where(F.col("_inside") > least).drop("_inside")


def marginalize(joint: DataFrame, axes: Sequence[int]) -> DataFrame:
    """Sum out all axes but the given ones, which are renumbered in the given order."""
    return joint.groupBy("type", *(F.col(f"k_{a}").alias(f"k_{i}") for i, a in enumerate(axes))).agg(F.sum("mass").alias("mass"))


def fold_joint(joint: DataFrame, ns: Sequence[int]) -> DataFrame:
    """Cells with more than half of all alleles derived move to their complement; at exactly half both share."""
    ks = [f"k_{p}" for p in range(len(ns))]
    count = sum((F.col(k) for k in ks), F.lit(0))
    whole = F.struct(*ks, F.col("mass").alias("x"))
    flipped = F.struct(*((n - F.col(k)).alias(k) for k, n in zip(ks, ns, strict=True)), F.col("mass").alias("x"))
    halves = F.array(F.struct(*ks, (F.col("mass") / 2).alias("x")), F.struct(*((n - F.col(k)).alias(k) for k, n in zip(ks, ns, strict=True)), (F.col("mass") / 2).alias("x")))
    half = sum(ns)
    e = F.explode(F.when(2 * count < half, F.array(whole)).when(2 * count > half, F.array(flipped)).otherwise(halves)).alias("e")
    return joint.select("type", e).groupBy("type", *(F.col(f"e.{k}").alias(k) for k in ks)).agg(F.sum("e.x").alias("mass"))


def _probabilities(two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(type, i, j, p) symmetrised and normalised, and its marginals (type, i, m)."""
    cells = two.select("type", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("c"), (F.col("mass") / 2).alias("x"))
    cells = cells.groupBy("type", F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(F.sum("x").alias("x"))
    p = cells.select("type", "i", "j", (F.col("x") / F.sum("x").over(Window.partitionBy("type"))).alias("p"))
    return p, p.groupBy("type", "i").agg(F.sum("p").alias("m"))


def covariance(two: DataFrame, n: int) -> DataFrame:
    """(type, i, j, cov) for interior bins: p_ij - m_i m_j.

    A type's cells, (n + 1)**2 at most, come together in one map, from which marginals and products are read.
    """
    sides = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("c")
    cells = two.select("type", sides, (F.col("mass") / 2).alias("x")).groupBy("type", (F.col("c.i") * (n + 1) + F.col("c.j")).alias("cell")).agg(F.sum("x").alias("x"))
    packed = cells.groupBy("type").agg(F.map_from_entries(F.collect_list(F.struct("cell", "x"))).alias("_x"), F.sum("x").alias("_all"))
    bins = F.sequence(F.lit(0), F.lit(n))
    own = F.transform(bins, lambda i: F.aggregate(bins, F.lit(0.0), lambda acc, j: acc + F.coalesce(F.try_element_at(F.col("_x"), i * (n + 1) + j), F.lit(0.0))) / F.col("_all"))
    inside = F.sequence(F.lit(1), F.lit(n - 1))
    grid = packed.withColumn("_m", own).withColumn("i", F.explode(inside)).withColumn("j", F.explode(inside))
    mi, mj = F.get("_m", F.col("i")), F.get("_m", F.col("j"))
    p = F.coalesce(F.try_element_at(F.col("_x"), F.col("i") * (n + 1) + F.col("j")), F.lit(0.0)) / F.col("_all")
    return grid.select("type", "i", "j", (p - mi * mj).alias("cov"), mi.alias("mi"), mj.alias("mj")).where("mi > 0 and mj > 0")


def correlation(two: DataFrame, n: int) -> DataFrame:
    """cov / sqrt(var var), clipped to [-1, 1]; 0 where a variance is within rounding of 0."""
    c = covariance(two, n)
    var = c.where("i = j").select("type", "i", F.when(F.col("cov") > 1e-12 * F.col("mi") * F.col("mj"), F.col("cov")).otherwise(0.0).alias("var"))
    out = c.join(var.select("type", "i", F.col("var").alias("vi")), ["type", "i"]).join(var.select("type", F.col("i").alias("j"), F.col("var").alias("vj")), ["type", "j"])
    signal = F.abs("cov") > 1e-12 * F.col("mi") * F.col("mj")
    r = F.when(signal & (F.col("vi") > 0) & (F.col("vj") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / F.sqrt(F.col("vi") * F.col("vj"))))).otherwise(0.0)
    return out.select("type", "i", "j", r.alias("corr"))


def fpmi(two: DataFrame, n: int) -> DataFrame:
    """log(p_ij / (p_i p_j)) of the interior taken by itself; 0 where a probability is 0."""
    inside = two.where(F.col("i").between(1, n - 1) & F.col("j").between(1, n - 1))
    p, m = _probabilities(inside)
    out = p.join(m.select("type", "i", F.col("m").alias("mi")), ["type", "i"]).join(m.select("type", F.col("i").alias("j"), F.col("m").alias("mj")), ["type", "j"])
    return out.select("type", "i", "j", F.when(F.col("p") > 0, F.log(F.col("p") / (F.col("mi") * F.col("mj")))).otherwise(0.0).alias("fpmi"))


def fold_two(two: DataFrame, n: int) -> DataFrame:
    i, j = (F.least(F.col(c), n - F.col(c)) for c in "ij")
    return two.groupBy("type", i.alias("i"), j.alias("j")).agg(F.sum("mass").alias("mass"))


def _target_sites(spectra: DataFrame, sampled: DataFrame, cell: list[str], derived: Column, n_target: float, types: str, keep: bool) -> DataFrame:
    """The all-ancestral cell of each type gets its share of the target less what was observed of the type."""
    mass, origin = F.col("mass"), sum((F.col(k) for k in cell), F.lit(0)) == 0
    seen = spectra.groupBy("type").agg(F.sum(F.when(origin, 0.0).otherwise(mass)).alias("observed"), F.sum(F.when(origin | derived, 0.0).otherwise(mass)).alias("polymorphic"))
    both = seen.join(sampled, "type", types).select("type", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("observed", "sampled")))
    changes = F.col("s") > 0
    both = both.join(F.broadcast(sampled.agg(F.sum("sampled").alias("s"))))
    if keep:
        both = both.join(F.broadcast(seen.agg(F.coalesce(F.sum("polymorphic"), F.lit(0.0)).alias("p"))))
        changes &= F.lit(float(n_target)) >= F.col("p")
    new = both.select("type", F.when(changes, F.greatest(F.col("sampled") * F.lit(float(n_target)) / F.col("s") - F.col("observed"), F.lit(0.0))).alias("new"))
    if types == "inner":
        return spectra.join(new, "type").select("type", *cell, F.when(origin, F.coalesce("new", "mass")).otherwise(mass).alias("mass"))
    zero = new.where("new is not null").select("type", *(F.lit(0).alias(k) for k in cell), "new")
    return spectra.join(zero, ["type", *cell], types).select("type", *cell, F.coalesce("new", "mass").alias("mass"))


def target_sites_1d(sfs: DataFrame, sampled: DataFrame, n: int, n_target: float, types: str = "full", keep: bool = True) -> DataFrame:
    """Bin 0 of each type from sampled opportunities: sampled * x - observed, not below 0.

    x = (target + polymorphic before sampling - polymorphic) / all sampled; here sampling adds no
    polymorphic mass. Nothing changes when nothing was sampled nor, with ``keep``, when the target is
    below the polymorphic mass (bins 1 to n - 1); without ``keep`` the formula holds for any target.
    ``sampled``: (type, sampled). ``types``: ``full``, a type that only sampling shows gets a bin 0;
    ``inner``, the rows are those of ``sfs`` whose type was sampled. x counts all that was sampled.
    """
    return _target_sites(sfs, sampled, ["bin"], F.col("bin") == n, n_target, types, keep)


def target_sites_joint(joint: DataFrame, sampled: DataFrame, ns: Sequence[int], n_target: float, types: str = "full", keep: bool = True) -> DataFrame:
    """The same for the origin cell of joint spectra; every other cell counts as observed, all but the last as polymorphic."""
    ks = [f"k_{p}" for p in range(len(ns))]
    return _target_sites(joint, sampled, ks, sum((F.col(k) for k in ks), F.lit(0)) == sum(ns), n_target, types, keep)


def window_factor(spans: DataFrame, d: int) -> DataFrame:
    """Span-weighted mean share of the window that lies inside its contig."""
    s = F.col("span").cast("double")
    inside = F.when(F.lit(d) <= s, 1 - d / (2 * s)).otherwise(s / (2 * d))
    return spans.where("span > 0").agg((F.sum(inside * s) / F.sum(s)).alias("factor"))


def extrapolate_two(two: DataFrame, marginal: DataFrame, n_target: float, n_observed: float, region: float, d: int, factor: float) -> DataFrame:
    """Add the pairs of unobserved monomorphic sites to the border of an unstratified pair spectrum."""
    density = (n_target - n_observed) / region
    border = (F.col("mass") * density * d * factor).alias("mass")
    row = marginal.select(F.lit("all").alias("type"), F.lit(0).alias("i"), F.col("bin").alias("j"), border)
    column = marginal.select(F.lit("all").alias("type"), F.col("bin").alias("i"), F.lit(0).alias("j"), border)
    corner = two.sparkSession.createDataFrame([("all", 0, 0, (n_target - n_observed) * density * d * factor)], "type string, i int, j int, mass double")
    return two.unionByName(row).unionByName(column).unionByName(corner).groupBy("type", "i", "j").agg(F.sum("mass").alias("mass"))
