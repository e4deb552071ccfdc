"""Site predicates. Each is a boolean Column, or a semi join where another table decides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotypes as g
from ..sources.reference import CHUNK, alias_column, base_at, sequence_chunks


@dataclass
class Context:
    """What a component may look at besides the row."""

    samples: list[str] = field(default_factory=list)
    included: list[int] | None = None
    fasta: DataFrame | None = None
    cds: DataFrame | None = None
    aliases: list[list[str]] | None = None

    def indices(self, names: Sequence[str] | None) -> list[int] | None:
        if names is None:
            return None
        unknown = [n for n in names if n not in self.samples]
        if unknown:
            raise ValueError(f"unknown samples: {unknown}")
        return [self.samples.index(n) for n in names]

    def need(self, what: str, who: object) -> DataFrame:
        table = getattr(self, what)
        if table is None:
            raise ValueError(f"{type(who).__name__} needs a {what} table")
        return table


class Filter:
    """Subclass and return a Column from ``keep``; or override ``apply`` to use other tables."""

    def keep(self, ctx: Context) -> Column:
        raise NotImplementedError

    def apply(self, sites: DataFrame, ctx: Context) -> DataFrame:
        return sites.where(F.coalesce(self.keep(ctx), F.lit(False)))


class Masked(Filter):
    """Judges the included samples: the query's, or its own lists."""

    def __init__(self, use_query: bool = True, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None):
        self.use_query, self.include, self.exclude = use_query, include, exclude

    def mask(self, ctx: Context) -> list[int] | None:
        if self.use_query and self.include is None and self.exclude is None:
            return ctx.included
        chosen = ctx.indices(self.include) if self.include is not None else list(range(len(ctx.samples)))
        out = set(ctx.indices(self.exclude) or [])
        return [i for i in chosen if i not in out]

    def has_calls(self, ctx: Context) -> bool:
        mask = self.mask(ctx)
        return bool(ctx.samples) and mask != []


def n_alt() -> Column:
    return F.coalesce(F.size("alt"), F.lit(0))


class SNPFilter(Masked):
    """Single-nucleotide variants with two different bases among the judged samples; without calls, any declared alternative."""

    def keep(self, ctx):
        if not self.has_calls(ctx):
            return F.col("is_snp") & (n_alt() > 0)
        mask = self.mask(ctx)
        return F.col("is_snp") & F.when(F.col("gt").isNull(), n_alt() > 0).otherwise(F.size(F.array_distinct(g.called_bases(mask))) > 1)


class SNVFilter(Filter):
    """The reference and every alternative are single bases; sites without alternatives stay."""

    def keep(self, ctx):
        return F.forall(g.alleles(), g.is_base)


class PolyAllelicFilter(Masked):
    """At most two alleles among the judged samples; without calls, fewer than two declared alternatives."""

    def keep(self, ctx):
        few = n_alt() < 2
        if not self.has_calls(ctx):
            return few
        return few | (F.col("gt").isNotNull() & ~F.col("is_dummy") & (F.size(g.distinct_alleles(self.mask(ctx))) < 3))


class AllFilter(Filter):
    def keep(self, ctx):
        return F.lit(False)


class NoFilter(Filter):
    def keep(self, ctx):
        return F.lit(True)


class ContigFilter(Filter):
    def __init__(self, contigs: Sequence[str]):
        self.contigs = list(contigs)

    def keep(self, ctx):
        wanted = [alias_column(F.lit(c), ctx.aliases) for c in self.contigs]
        return alias_column(F.col("chrom"), ctx.aliases).isin(*wanted) if wanted else F.lit(False)


class BiasedGCConversionFilter(Filter):
    """Of SNPs only A/T and C/G exchanges stay; other sites stay."""

    def keep(self, ctx):
        pair = F.concat("ref", F.col("alt")[0])
        return ~F.col("is_snp") | pair.isin("AT", "TA", "CG", "GC")


class CpGFilter(Filter):
    """Drop a C before a G and a G after a C in the reference; what lies outside it stays."""

    def apply(self, sites, ctx):
        chunks = sequence_chunks(ctx.need("fasta", self)).withColumn("contig", alias_column(F.col("contig"), ctx.aliases))
        keyed = sites.withColumns({"_contig": alias_column(F.col("chrom"), ctx.aliases), "_chunk": F.floor((F.col("pos") - 1) / CHUNK).cast("int")})
        at = keyed.join(chunks.select(F.col("contig").alias("_contig"), F.col("chunk").alias("_chunk"), F.col("piece").alias("_piece"), F.col("offset").alias("_offset")), ["_contig", "_chunk"], "left")
        ref = F.upper("ref")
        after, before = (base_at(F.col("pos") + d, "_piece", "_offset") for d in (1, -1))
        hit = ((ref == "C") & (after == "G")) | ((ref == "G") & (before == "C"))
        return at.where(~F.coalesce(hit, F.lit(False))).select(*sites.columns)


class CodingSequenceFilter(Filter):
    """Sites inside some coding sequence."""

    width = 1 << 14

    def apply(self, sites, ctx):
        cds = ctx.need("cds", self)
        return within(sites, cds, ctx.aliases, self.width)


def within(sites: DataFrame, cds: DataFrame, aliases=None, width: int = 1 << 14) -> DataFrame:
    """Semi join of sites to intervals, as an equi join on bins of ``width`` positions that each interval touches."""
    bins = cds.select(alias_column(F.col("seqid"), aliases).alias("_contig"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_bin"))
    keyed = sites.withColumns({"_contig": alias_column(F.col("chrom"), aliases), "_bin": F.floor(F.col("pos") / width)})
    a, b = keyed.alias("a"), bins.alias("b")
    on = (F.col("a._contig") == F.col("b._contig")) & (F.col("a._bin") == F.col("b._bin")) & F.col("a.pos").between(F.col("b._start"), F.col("b._end"))
    return a.join(b, on, "left_semi").select(*(F.col(f"a.{c}") for c in sites.columns))


class DeviantOutgroupFilter(Filter):
    """Keep sites whose outgroup majority is the ingroup majority, alleles of several letters taken whole.

    ``strict``: drop sites without an outgroup call. ``keep_monomorphic``: sites that are no SNPs stay;
    sampled monomorphic sites always do.
    """

    def __init__(self, outgroups: Sequence[str], ingroups: Sequence[str] | None = None, strict: bool = True, keep_monomorphic: bool = True):
        self.outgroups, self.ingroups, self.strict, self.keep_monomorphic = list(outgroups), ingroups, strict, keep_monomorphic

    def keep(self, ctx):
        out = ctx.indices(self.outgroups)
        inside = ctx.indices(self.ingroups) if self.ingroups is not None else [i for i in range(len(ctx.samples)) if i not in out]
        major_in, major_out = g.major_of(g.haplotypes(inside)), g.major_of(g.haplotypes(out))
        judged = F.when(major_out.isNull(), F.lit(not self.strict)).otherwise(F.coalesce(major_in == major_out, F.lit(False)))
        return F.col("is_dummy") | judged | (~F.col("is_snp") if self.keep_monomorphic else F.lit(False))


class ExistingOutgroupFilter(Filter):
    """Fewer than ``n_missing`` outgroup samples without a called haplotype; dummy sites stay."""

    def __init__(self, outgroups: Sequence[str], n_missing: int = 1):
        self.outgroups, self.n_missing = list(outgroups), n_missing

    def keep(self, ctx):
        missing = [F.when(g.n_called([i]) == 0, 1).otherwise(0) for i in ctx.indices(self.outgroups)]
        return F.col("is_dummy") | (sum(missing, F.lit(0)) < self.n_missing)


def apply_filters(sites: DataFrame, filters: Sequence[Filter], ctx: Context) -> DataFrame:
    for f in filters:
        sites = f.apply(sites, ctx)
    return sites


def count_rejected(sites: DataFrame, filters: Sequence[Filter], ctx: Context) -> list[int]:
    """How many sites each filter drops of those its predecessors kept."""
    counts = [sites.count()]
    for f in filters:
        sites = f.apply(sites, ctx)
        counts.append(sites.count())
    return [a - b for a, b in zip(counts[:-1], counts[1:], strict=True)]
