"""The query object: one plan from sites to spectra, and the filter and annotate drivers."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import algebra, project
from ..operators.filters import Context, Filter, PolyAllelicFilter, apply_filters
from ..operators.spectra import JointSpectra, Spectra, TwoSpectra
from ..operators.strata import Stratum, composite
from ..sources.vcf import VariantSource
from ..sources.vcz import write_sites

log = logging.getLogger("helixframe")
Annotation = Callable[[DataFrame, Context], DataFrame]


def first_sites(sites: DataFrame, k: int | None) -> DataFrame:
    """The first ``k`` rows in file order."""
    if k is None:
        return sites
    if k < 1:
        raise ValueError("max_sites must be positive")
    return sites.orderBy("site_id").limit(k)


@dataclass
class SpectrumQuery:
    """Sites to spectra.

    Filters run in order, then annotations, then projection; the stratum of a site is judged last.
    ``n`` is one sample size, or one per population of ``pops`` (name to sample names).
    """

    source: VariantSource
    n: int | Sequence[int]
    pops: dict[str, Sequence[str]] | None = None
    strata: Sequence[Stratum] = ()
    annotations: Sequence[Annotation] = ()
    filters: Sequence[Filter] | None = None
    include_samples: Sequence[str] | None = None
    exclude_samples: Sequence[str] | None = None
    fasta: DataFrame | None = None
    cds: DataFrame | None = None
    aliases: list[list[str]] | None = None
    info_ancestral: str = "AA"
    info_ancestral_prob: str = "AA_prob"
    skip_non_polarized: bool = True
    polarize_probabilistically: bool = False
    subsample_mode: str = "probabilistic"
    max_sites: int | None = None
    seed: int = 0
    two_sfs: bool = False
    d: int = 1000
    two_sfs_offset: int = 0
    n_target_sites: float | None = None
    opportunities: DataFrame | None = None  # (type, sampled), see sampled_opportunities
    context: Context = field(init=False)

    def __post_init__(self):
        ns = self.ns
        if any(n < 2 for n in ns):
            raise ValueError("a sample size must be at least 2")
        if self.pops is not None and len(ns) != len(self.pops):
            raise ValueError("one sample size per population")
        if self.subsample_mode not in ("probabilistic", "random"):
            raise ValueError("subsample_mode is probabilistic or random")
        if self.two_sfs and self.pops is not None:
            raise NotImplementedError("pair spectra have one population")
        if self.two_sfs and (self.d < 1 or self.two_sfs_offset < 0):
            raise ValueError("the distance must be positive and the offset not negative")
        included = self.source.sample_indices(self.include_samples, self.exclude_samples)
        self.context = Context(self.source.samples, included if (self.include_samples is not None or self.exclude_samples is not None) else None, self.fasta, self.cds, self.aliases)

    @property
    def ns(self) -> list[int]:
        return [self.n] * (len(self.pops) if self.pops else 1) if isinstance(self.n, int) else list(self.n)

    def sites(self) -> DataFrame:
        """Filtered and annotated sites with the columns the strata need."""
        df = first_sites(self.source.sites, self.max_sites)
        df = apply_filters(df, [PolyAllelicFilter()] if self.filters is None else self.filters, self.context)
        for annotate in self.annotations:
            df = annotate(df, self.context)
        for s in self.strata:
            df = s.prepare(df, self.context)
        return df

    def keys(self) -> DataFrame:
        label = composite([s.label(self.context) for s in self.strata])
        masks = [self.context.included] if self.pops is None else [[i for i in self.context.indices(list(p)) if self.context.included is None or i in self.context.included] for p in self.pops.values()]
        return project.site_keys(self.sites(), masks, self.ns, label, self.info_ancestral, self.info_ancestral_prob if self.polarize_probabilistically else None, self.skip_non_polarized)

    def frame(self) -> DataFrame:
        """The result as a long frame."""
        if self.two_sfs:
            return self._pairs()
        if self.pops is None:
            out = project.spectrum_1d(self.keys(), self.ns[0], self.subsample_mode, self.seed)
            return out if self.n_target_sites is None else algebra.target_sites_1d(out, self.opportunities, self.ns[0], self.n_target_sites)
        out = project.spectrum_joint(self.keys(), self.ns, self.subsample_mode, self.seed)
        return out if self.n_target_sites is None else algebra.target_sites_joint(out, self.opportunities, self.ns, self.n_target_sites)

    def _pairs(self) -> DataFrame:
        """The pair spectrum; with target sites, the pairs of sites the input does not show are added to its border."""
        if self.n_target_sites is not None and self.strata:
            raise NotImplementedError("target sites need an unstratified pair spectrum")
        n, keys = self.ns[0], self.keys()
        if self.subsample_mode == "random":
            keys = project.drawn(keys, n, self.seed)
        two = project.two_site(keys, n, self.d, self.two_sfs_offset)
        if self.n_target_sites is None:
            return two
        marginal = project.spectrum_1d(keys, n)
        spans = contig_spans(self.source, keys)
        observed = marginal.agg(F.sum("mass")).first()[0] or 0.0
        region = spans.agg(F.sum("span")).first()[0] or 0
        if observed >= self.n_target_sites or region <= 0:
            log.warning("no more target sites than sites seen, or no extent: the pair spectrum stays as it is")
            return two
        factor = algebra.window_factor(spans, self.d).first()[0]
        return algebra.extrapolate_two(two, marginal, self.n_target_sites, observed, float(region), self.d, factor)

    def run(self) -> Spectra | JointSpectra | TwoSpectra:
        """Collect the spectra: bins and types, never sites."""
        if self.two_sfs:
            types = [r[0] for r in self.keys().select("type").distinct().collect()]
            return TwoSpectra.from_long(self.frame().toPandas(), self.ns[0], types)
        rows = self.frame().toPandas()
        if self.pops is not None:
            return JointSpectra.from_long(rows, self.ns, list(self.pops))
        out = Spectra.from_long(rows, self.ns[0])
        if out.k and float(out.all.n_monomorphic) < 0.95 * out.all.n_sites and self.n_target_sites is None:
            log.warning("few monomorphic sites: give the number of target sites if they were left out")
        return out


def contig_spans(source: VariantSource, sites: DataFrame | None = None) -> DataFrame:
    """(chrom, low, high, span): the declared length, else the extent of ``sites``, which are all of the source by default."""
    spark = source.sites.sparkSession
    seen = (source.sites if sites is None else sites).groupBy("chrom").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    declared = spark.createDataFrame([(c, n) for c, n in source.contig_lengths.items() if n > 0], "chrom string, length bigint")
    return seen.join(declared, "chrom", "left").select("chrom", "low", "high", F.coalesce("length", F.col("high") - F.col("low")).alias("span"))


def sampled_opportunities(query: SpectrumQuery, n_samples: int = 100_000) -> DataFrame:
    """(type, sampled): strata of monomorphic sites drawn from the reference inside the observed extents.

    Positions are hashes of a counter, spread over contigs by extent. The drawn sites pass the query's
    filters (SNP filters aside, which drop every site without variation), annotations and strata.
    """
    from ..operators.filters import SNPFilter
    from ..sources.reference import CHUNK, sequence_chunks

    fasta = query.context.need("fasta", query)
    spark = fasta.sparkSession
    spans = [(r["chrom"], r["low"], r["high"]) for r in contig_spans(query.source).collect()]  # one row a contig
    total = sum(max(hi - lo, 1) for _, lo, hi in spans)
    edges, at = [], 0
    for c, lo, hi in spans:
        edges.append((c, lo, at, at + max(hi - lo, 1)))
        at = edges[-1][3]
    u = spark.range(n_samples).select("id", F.pmod(F.xxhash64("id", F.lit(query.seed)), F.lit(max(total, 1))).alias("u"))
    table = F.broadcast(spark.createDataFrame(edges, "chrom string, low bigint, a bigint, b bigint"))
    drawn = u.join(table, (F.col("u") >= F.col("a")) & (F.col("u") < F.col("b"))).select("id", "chrom", (F.col("low") + F.col("u") - F.col("a")).alias("pos"))
    chunks = sequence_chunks(fasta, overlap=0).select(F.col("contig").alias("chrom"), F.col("chunk"), "offset", "piece")
    based = drawn.withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK).cast("int")).join(chunks, ["chrom", "chunk"]).withColumn("ref", F.upper(F.substring("piece", (F.col("pos") - F.col("offset")).cast("int"), F.lit(1)))).where(F.col("ref").isin(*"ACGT"))
    n, no = len(query.source.samples), F.lit(False)
    dummies = based.select(
        F.col("id").alias("site_id"), "chrom", "pos", "ref", F.expr("cast(array() as array<string>)").alias("alt"), F.array_repeat(F.array(F.lit(0), F.lit(0)), max(n, 1)).alias("gt"),
        F.expr("cast(null as array<boolean>)").alias("phased"), *(no.alias(c) for c in ("is_snp", "is_mnp", "is_indel", "is_deletion", "is_sv")), F.lit(True).alias("is_dummy"), F.expr("cast(map() as map<string,string>)").alias("info"),
    )
    df = apply_filters(dummies, [f for f in (query.filters or []) if not isinstance(f, SNPFilter)], query.context)
    for annotate in query.annotations:
        df = annotate(df, query.context)
    for s in query.strata:
        df = s.prepare(df, query.context)
    label = composite([s.label(query.context) for s in query.strata])
    return df.withColumn("type", label).where("type is not null").groupBy("type").agg(F.count("*").cast("double").alias("sampled"))


def filter_variants(source: VariantSource, filters: Sequence[Filter], output: str | None = None, max_sites: int | None = None, **context) -> VariantSource:
    ctx = Context(source.samples, **context)
    out = VariantSource(apply_filters(first_sites(source.sites, max_sites), filters, ctx), source.samples, source.contig_lengths, source.header)
    if output:
        write_sites(out, output)
    return out


def annotate_variants(source: VariantSource, annotations: Sequence[Annotation], output: str | None = None, max_sites: int | None = None, tags: dict[str, str] | None = None, **context) -> VariantSource:
    ctx = Context(source.samples, **context)
    df = first_sites(source.sites, max_sites)
    for annotate in annotations:
        df = annotate(df, ctx)
    out = VariantSource(df, source.samples, source.contig_lengths, source.header)
    if output:
        write_sites(out, output, tags)
    return out
