"""Ancestral alleles: parsimony, and maximum likelihood on a caterpillar tree of outgroups."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotypes as g
from ..functions.hypergeometric import pmf_array
from .filters import Context

LETTERS = "ACGT"
CONFIG_KEY = ["major_base", "minor_base", "outgroup_bases", "n_major"]


def set_info(sites: DataFrame, tag: str, value) -> DataFrame:
    rest = F.map_filter(F.coalesce("info", F.expr("map()").cast("map<string,string>")), lambda k, _: k != tag)
    return sites.withColumn("info", F.map_concat(rest, F.create_map(F.lit(tag), value)))


def annotate_parsimony(sites: DataFrame, ctx: Context, samples: Sequence[str] | None = None, tag: str = "AA") -> DataFrame:
    """The major called base of a SNP, the only base of another site, the reference of a dummy; else a dot."""
    bases = g.called_bases(ctx.indices(samples))
    kinds = F.array_distinct(bases)
    value = F.when(F.col("is_dummy"), F.col("ref")).when(F.col("is_snp"), g.major_of(bases)).when(F.size(kinds) == 1, kinds[0])
    return set_info(sites, tag, F.coalesce(value, F.lit(".")))


# ---- site configurations


def base_index(c):
    return F.coalesce(F.array_position(F.array(*(F.lit(b) for b in LETTERS)), c), F.lit(0)).cast("int") - 1


def site_configs(sites: DataFrame, ingroups: Sequence[int], outgroups: Sequence[Sequence[int]], n: int) -> DataFrame:
    """(site_id, major_base, minor_base, outgroup_bases, n_major, multiplicity): a site's weighted patterns.

    Sites with at least ``n`` called ingroup haplotypes and at most two alleles overall. The ingroup is
    projected to ``n``; below half, the alleles change places. An outgroup's base is its first called one.
    """
    if n < 2:
        raise ValueError("at least two ingroup haplotypes")
    inside = g.called_bases(ingroups)
    outs = [g.called_bases(o) for o in outgroups]
    df = sites.withColumns({"_in": inside, "_out": F.array(*(F.get(o, F.lit(0)) for o in outs)), "_all": F.array_distinct(F.concat(inside, *outs))})
    df = df.where((F.size("_in") >= n) & (F.size("_all") <= 2))
    first = g.major_of(F.col("_in"))
    df = df.withColumn("_first", first).withColumn("_second", F.get(F.array_except(F.array_distinct("_in"), F.array("_first")), F.lit(0)))
    df = df.withColumns({"_m": F.size("_in"), "_n1": g.count_of(F.col("_in"), F.col("_first"))})
    p = F.when(F.col("_second").isNull(), F.array(*[F.lit(0.0)] * n, F.lit(1.0))).otherwise(pmf_array(F.col("_m"), F.col("_n1"), n))
    out = df.select("site_id", "_first", "_second", "_out", F.posexplode(p).alias("k", "multiplicity")).where("multiplicity > 0")
    flip = F.col("k") < (n + 1) // 2
    return out.select(
        "site_id", base_index(F.when(flip, F.col("_second")).otherwise(F.col("_first"))).alias("major_base"), base_index(F.when(flip, F.col("_first")).otherwise(F.col("_second"))).alias("minor_base"),
        F.transform("_out", base_index).alias("outgroup_bases"), F.when(flip, n - F.col("k")).otherwise(F.col("k")).alias("n_major"), "multiplicity",
    )


def group_configs(configs: DataFrame) -> pd.DataFrame:
    """Different patterns with their summed multiplicity: few, whatever the number of sites."""
    rows = configs.groupBy(*CONFIG_KEY).agg(F.sum("multiplicity").alias("multiplicity")).toPandas()
    rows["outgroup_bases"] = [tuple(int(b) for b in x) for x in rows["outgroup_bases"]]
    return rows.sort_values(CONFIG_KEY, ignore_index=True)


# ---- substitution models: 4 x 4 transition probabilities with at most two events per branch


def jc_matrix(rate: float) -> np.ndarray:
    e = np.exp(-rate)
    out = np.full((4, 4), e * (rate / 3 + rate**2 / 9))
    np.fill_diagonal(out, e * (1 + rate**2 / 6))
    return out


def k2_matrix(rate: float, kappa: float) -> np.ndarray:
    e, norm = np.exp(-rate), (kappa + 2) ** 2
    out = np.full((4, 4), rate * e * (1 / (kappa + 2) + rate * kappa / norm))
    for a, b in ((0, 2), (2, 0), (1, 3), (3, 1)):
        out[a, b] = rate * e * (kappa / (kappa + 2) + rate / norm)
    np.fill_diagonal(out, e * (1 + rate**2 * (2 + kappa**2) / (2 * norm)))
    return out


def tip(base: int) -> np.ndarray:
    """Probabilities of the data below a tip; a missing base may be any."""
    return np.ones(4) if base < 0 else np.eye(4)[base]


def tree_vector(outgroups: Sequence[int], branches: Sequence[np.ndarray]) -> np.ndarray:
    """For each ingroup base the probability of the outgroups, by pruning from the last internal node.

    The ingroup hangs on the first internal node (branch 0); node ``k`` carries outgroup ``k`` (branch
    ``2k + 1``) and the next node (branch ``2k + 2``), the last one its two outgroups.
    """
    n = len(outgroups)
    if n == 0:
        return np.zeros(4)
    if n == 1:
        return branches[0] @ tip(outgroups[0])
    below = branches[2 * n - 2] @ tip(outgroups[-1])
    for k in range(n - 2, -1, -1):
        node = (branches[2 * k + 1] @ tip(outgroups[k])) * below
        below = branches[2 * k] @ node
    return below


def node_vector(base: int, outgroups: Sequence[int], branches: Sequence[np.ndarray]) -> np.ndarray:
    """Probabilities of the bases at the first internal node, given the ingroup's base."""
    n = len(outgroups)
    if n < 2:
        return tip(base)
    below = branches[2 * n - 2] @ tip(outgroups[-1])
    for k in range(n - 2, 0, -1):
        below = branches[2 * k] @ ((branches[2 * k + 1] @ tip(outgroups[k])) * below)
    joint = branches[0][base] * (branches[1] @ tip(outgroups[0])) * below
    return joint / joint.sum()


def kingman(n: int, divergence: bool = False) -> np.ndarray:
    """Prior that the major allele is ancestral, by minor allele count; fixed sites are certain, or take their neighbour's."""
    i = np.arange(1, n)
    inner = (1 / i) / (1 / i + 1 / (n - i))
    return np.concatenate([[inner[0] if divergence else 1.0], inner, [inner[-1] if divergence else 0.0]])


@dataclass
class AncestralModel:
    """Rates of a fitted tree. ``rates`` has one entry per branch, or one for all (pooled)."""

    n_ingroups: int
    n_outgroups: int
    substitution: str = "K2"
    pooled: bool = False
    prior: np.ndarray | None = None
    rates: Sequence[float] = ()
    kappa: float = 1.0
    likelihood: float = np.nan

    BOUNDS = {"rate": (1e-5, 10.0), "kappa": (0.1, 10.0)}

    @property
    def n_branches(self) -> int:
        return 2 * self.n_outgroups - 1

    def branches(self, rates=None, kappa=None) -> list[np.ndarray]:
        rates, kappa = self.rates if rates is None else rates, self.kappa if kappa is None else kappa
        rates = [rates[0]] * self.n_branches if self.pooled else rates
        return [jc_matrix(r) if self.substitution == "JC" else k2_matrix(r, kappa) for r in rates]

    def pattern_probabilities(self, configs: pd.DataFrame, branches) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each pattern with the major and with the minor base ancestral; 0 for a missing base."""
        known = {o: tree_vector(o, branches) for o in set(configs["outgroup_bases"])}
        rows = np.stack([known[o] for o in configs["outgroup_bases"]]) if len(configs) else np.zeros((0, 4))
        at = np.arange(len(configs))
        out = []
        for name in ("major_base", "minor_base"):
            base = configs[name].to_numpy()
            out.append(np.where(base >= 0, rows[at, np.maximum(base, 0)], 0.0))
        return out[0], out[1]

    def fit(self, configs: pd.DataFrame, n_runs: int = 10, seed: int = 0) -> AncestralModel:
        """Maximum likelihood rates from patterns whose outgroups are all called; the best of ``n_runs`` random starts."""
        rows = configs[[all(b >= 0 for b in o) for o in configs["outgroup_bases"]]].copy()
        if rows.empty:
            raise RuntimeError("no site has all its outgroups")
        rows.loc[rows["n_major"] == self.n_ingroups, "minor_base"] = -1
        weight = rows["multiplicity"].to_numpy(float)
        n_rates = 1 if self.pooled else self.n_branches
        bounds = [self.BOUNDS["rate"]] * n_rates + ([self.BOUNDS["kappa"]] if self.substitution == "K2" else [])

        def loss(x: np.ndarray) -> float:
            x = np.exp(x)
            a, b = self.pattern_probabilities(rows, self.branches(x[:n_rates], x[n_rates] if len(x) > n_rates else 1.0))
            with np.errstate(divide="ignore"):
                return float(-(np.log((a + b) / 2) * weight).sum())

        lo, hi = np.log(np.array(bounds)).T
        rng = np.random.default_rng(seed)
        runs = [minimize_box(loss, rng.uniform(lo, hi), lo, hi) for _ in range(n_runs)]
        runs = [r for r in runs if np.isfinite(r[1])]
        if not runs:
            raise RuntimeError("no run of the fit converged")
        x, value = min(runs, key=lambda r: r[1])
        x = np.exp(x)
        return AncestralModel(self.n_ingroups, self.n_outgroups, self.substitution, self.pooled, self.prior, x[:n_rates].tolist(), float(x[n_rates]) if len(x) > n_rates else 1.0, -value)

    def p_major(self, configs: pd.DataFrame) -> np.ndarray:
        """Posterior that the major allele is ancestral."""
        a, b = self.pattern_probabilities(configs, self.branches())
        pi = self.prior[self.n_ingroups - configs["n_major"].to_numpy()] if self.prior is not None else 0.5
        with np.errstate(invalid="ignore", divide="ignore"):
            return pi * a / (pi * a + (1 - pi) * b)

    def to_json(self) -> str:
        return json.dumps({k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in self.__dict__.items()})

    @classmethod
    def from_json(cls, text: str) -> AncestralModel:
        values = json.loads(text)
        values["prior"] = None if values["prior"] is None else np.array(values["prior"])
        return cls(**values)


def minimize_box(f, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, steps: int = 200, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Projected quasi-Newton descent: BFGS on the coordinates that are not held at a bound, with backtracking."""

    def gradient(x):
        out = np.empty_like(x)
        for i in range(len(x)):
            h = 1e-6
            up, down = x.copy(), x.copy()
            up[i], down[i] = min(x[i] + h, hi[i]), max(x[i] - h, lo[i])
            out[i] = (f(up) - f(down)) / (up[i] - down[i])
        return out

    x = np.clip(x, lo, hi)
    value, grad, inverse = f(x), gradient(x), np.eye(len(x))
    for _ in range(steps):
        held = ((x <= lo) & (grad > 0)) | ((x >= hi) & (grad < 0))
        free = ~held
        if not free.any() or np.abs(grad[free]).max() < 1e-7 * max(1.0, abs(value)):
            break
        step = np.zeros_like(x)
        step[free] = -(inverse[np.ix_(free, free)] @ grad[free])
        if step @ grad >= 0:
            inverse = np.eye(len(x))
            step[free] = -grad[free]
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        size = 1.0
        while size > 1e-12:
            new = np.clip(x + size * step, lo, hi)
            now = f(new)
            if now <= value + 1e-4 * (grad @ (new - x)):
                break
            size /= 2
        else:
            break
        change, new_grad = new - x, gradient(new)
        y = new_grad - grad
        if change @ y > 1e-14:
            rho = 1 / (change @ y)
            left = np.eye(len(x)) - rho * np.outer(change, y)
            inverse = left @ inverse @ left.T + rho * np.outer(change, change)
        done = value - now < tol * max(1.0, abs(value))
        x, value, grad = new, now, new_grad
        if done:
            break
    return x, value


def adaptive_prior(configs: pd.DataFrame, model: AncestralModel, divergence: bool = False) -> np.ndarray:
    """For each minor allele count the share of ancestral major alleles of maximum likelihood, mirrored."""
    n = model.n_ingroups
    a, b = model.pattern_probabilities(configs, model.branches())
    minor, weight = n - configs["n_major"].to_numpy(), configs["multiplicity"].to_numpy(float)
    pi = np.full(n + 1, 0.5)
    for i in range(1, (n + 1) // 2):
        rows = (minor == i) & (a + b > 0)

        def loss(p, rows=rows):
            return float(-(np.log(p[0] * a[rows] + (1 - p[0]) * b[rows]) * weight[rows]).sum())

        if rows.any():
            pi[i] = minimize_box(loss, np.array([0.75]), np.array([1e-9]), np.array([1 - 1e-9]))[0][0]
        pi[n - i] = 1 - pi[i]
    pi[0], pi[n] = (pi[1], pi[n - 1]) if divergence else (1.0, 0.0)
    return pi


def site_posteriors(configs: DataFrame, model: AncestralModel) -> DataFrame:
    """(site_id, major_base, p_major, ancestral): the weighted posterior over a site's patterns.

    Patterns are few: their posteriors go to the sites by a join on the pattern. ``p_major`` refers to
    the base that is major in most of the site's weight.
    """
    spark = configs.sparkSession
    known = group_configs(configs)
    known["p"] = model.p_major(known)
    rows = [(int(r.major_base), int(r.minor_base), [int(b) for b in r.outgroup_bases], int(r.n_major), float(r.p)) for r in known.itertuples()]
    table = spark.createDataFrame(rows, "major_base int, minor_base int, outgroup_bases array<int>, n_major int, p double")
    scored = configs.join(table, CONFIG_KEY).where(~F.isnan("p"))
    # weight of each base being ancestral
    each = scored.select("site_id", F.explode(F.array(F.struct(F.col("major_base").alias("base"), (F.col("p") * F.col("multiplicity")).alias("x"), F.col("multiplicity").alias("w")), F.struct(F.col("minor_base").alias("base"), ((1 - F.col("p")) * F.col("multiplicity")).alias("x"), F.lit(0.0).alias("w")))).alias("e"))
    bases = each.where("e.base >= 0").groupBy("site_id", F.col("e.base").alias("base")).agg(F.sum("e.x").alias("x"), F.sum("e.w").alias("w"))
    site = bases.groupBy("site_id").agg(F.max(F.struct("w", (-F.col("base")).alias("b"), "x")).alias("major"), F.max(F.struct("x", (-F.col("base")).alias("b"))).alias("best"), F.sum("w").alias("total"))
    letter = F.element_at(F.array(*(F.lit(b) for b in LETTERS)), (1 - F.col("best.b")).cast("int"))
    return site.select("site_id", (-F.col("major.b")).alias("major_base"), (F.col("major.x") / F.col("total")).alias("p_major"), letter.alias("ancestral"), (F.col("best.x") / F.col("total")).alias("p_ancestral"))


def annotate_likelihood(sites: DataFrame, ingroups: Sequence[int], outgroups: Sequence[Sequence[int]], n: int, model: AncestralModel | None = None, confidence: float = 0.0, tag: str = "AA", **fit) -> tuple[DataFrame, AncestralModel]:
    """Fit (unless a model is given) and write ``<tag>``, ``<tag>_prob`` and ``<tag>_info``; unsure sites get a dot."""
    configs = site_configs(sites, ingroups, outgroups, n)
    if model is None:
        model = AncestralModel(n, len(outgroups), prior=kingman(n)).fit(group_configs(configs), **fit)
    found = site_posteriors(configs, model)
    sure = F.coalesce(F.col("p_ancestral") >= 0.5 + confidence / 2, F.lit(False))
    df = sites.join(found.select("site_id", "ancestral", "p_ancestral"), "site_id", "left")
    text = F.when(F.col("p_ancestral").isNull(), "no pattern").when(~sure, "below confidence").otherwise(F.concat(F.lit("p="), F.round("p_ancestral", 6).cast("string")))
    df = set_info(df, tag, F.when(sure, F.col("ancestral")).otherwise("."))
    df = set_info(df, f"{tag}_prob", F.coalesce(F.col("p_ancestral").cast("string"), F.lit(".")))
    return set_info(df, f"{tag}_info", text).drop("ancestral", "p_ancestral"), model


# ---- summaries


def folded_spectra(configs: DataFrame, *keys: str) -> DataFrame:
    return configs.groupBy(*keys, "n_major").agg(F.sum("multiplicity").alias("multiplicity"))


def transition_transversion_ratio(configs: DataFrame) -> float:
    """Multiplicity of transitions over that of transversions among patterns with two bases."""
    pair = F.abs(F.col("major_base") - F.col("minor_base")) == 2
    row = configs.where("major_base >= 0 and minor_base >= 0").agg(F.sum(F.when(pair, F.col("multiplicity")).otherwise(0.0)), F.sum(F.when(pair, 0.0).otherwise(F.col("multiplicity")))).first()
    return (row[0] or 0.0) / row[1] if row[1] else float("nan")


def outgroup_divergence(model: AncestralModel) -> list[float]:
    """Summed branch rates from the ingroup to each outgroup."""
    r = list(model.rates) if not model.pooled else [model.rates[0]] * model.n_branches
    out = []
    for k in range(model.n_outgroups):
        inner = sum(r[0 : 2 * k + 1 : 2])
        last = k == model.n_outgroups - 1
        out.append(inner + (0.0 if model.n_outgroups == 1 else r[2 * k] if last else r[2 * k + 1]))
    if model.n_outgroups > 1:
        out[-1] = sum(r[0 : 2 * model.n_outgroups - 2 : 2]) + r[-1]
    return out
