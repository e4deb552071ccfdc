"""Stratum keys: string Columns; null means that a site belongs to none."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotypes as g
from ..sources.reference import CHUNK, alias_column, sequence_chunks
from .filters import Context


class Stratum:
    """Subclass and return a Column from ``label``. ``prepare`` may add columns to the sites first."""

    def label(self, ctx: Context) -> Column:
        raise NotImplementedError

    def prepare(self, sites: DataFrame, ctx: Context) -> DataFrame:
        return sites


def info(tag: str) -> Column:
    return F.try_element_at("info", F.lit(tag))


def ancestral_base(tag: str = "AA") -> Column:
    """The ancestral tag where it is a base, else the reference."""
    return F.when(g.is_base(F.upper(info(tag))), F.upper(info(tag))).when(g.is_base(F.col("ref")), F.col("ref"))


class AncestralBase(Stratum):
    def __init__(self, tag: str = "AA"):
        self.tag = tag

    def label(self, ctx):
        return ancestral_base(self.tag)


class BaseTransition(Stratum):
    """``ancestral>derived``; derived is the reference unless that is ancestral, then the first alternative."""

    def __init__(self, tag: str = "AA"):
        self.tag = tag

    def label(self, ctx):
        anc = ancestral_base(self.tag)
        der = F.when(F.col("ref") != anc, F.col("ref")).otherwise(F.get("alt", F.lit(0)))
        return F.when(g.is_base(der) & (anc != der), F.concat(anc, F.lit(">"), der))


class TransitionTransversion(Stratum):
    def label(self, ctx):
        pair = F.concat("ref", F.get("alt", F.lit(0)))
        both = g.is_base(F.col("ref")) & g.is_base(F.get("alt", F.lit(0))) & (F.col("ref") != F.get("alt", F.lit(0)))
        return F.when(both, F.when(pair.isin("AG", "GA", "CT", "TC"), "transition").otherwise("transversion"))


class BaseContext(Stratum):
    """The ancestral base between ``n`` reference bases on either side, where all are known."""

    def __init__(self, n: int = 1, tag: str = "AA"):
        self.n, self.tag = n, tag

    def prepare(self, sites, ctx):
        chunks = sequence_chunks(ctx.need("fasta", self), overlap=max(64, self.n)).select(alias_column(F.col("contig"), ctx.aliases).alias("_contig"), F.col("chunk").alias("_chunk"), F.col("piece").alias("_piece"), F.col("offset").alias("_offset"))
        keyed = sites.withColumns({"_contig": alias_column(F.col("chrom"), ctx.aliases), "_chunk": F.floor((F.col("pos") - 1) / CHUNK).cast("int")})
        at = (F.col("pos") - F.col("_offset")).cast("int")
        up = F.when(at > self.n, F.upper(F.substring(F.col("_piece"), at - self.n, F.lit(self.n))))
        down = F.upper(F.substring(F.col("_piece"), at + 1, F.lit(self.n)))
        return keyed.join(chunks, ["_contig", "_chunk"], "left").withColumns({"_up": up, "_down": down}).drop("_contig", "_chunk", "_piece", "_offset")

    def label(self, ctx):
        whole = F.concat("_up", ancestral_base(self.tag), "_down")
        return F.when(whole.rlike(f"^[ACGT]{{{2 * self.n + 1}}}$"), whole)


class Degeneracy(Stratum):
    """Fourfold sites are neutral, zerofold ones selected; or whatever ``callback`` (site columns to Column) says."""

    def __init__(self, callback: Callable[[], Column] | None = None):
        self.callback = callback

    def label(self, ctx):
        tag = info("Degeneracy")
        return self.callback() if self.callback else F.when(tag == "4", "neutral").when(tag == "0", "selected")


class Synonymy(Stratum):
    def label(self, ctx):
        tag = info("Synonymy")
        return F.when(tag == "1", "neutral").when(tag == "0", "selected")


class VEP(Stratum):
    tag = "CSQ"

    def label(self, ctx):
        text = info(self.tag)
        return F.when(text.contains("synonymous_variant"), "neutral").when(text.contains("missense_variant"), "selected")


class SnpEff(VEP):
    tag = "ANN"


class Contig(Stratum):
    """The contig's name, dots as underscores, as dots separate levels."""

    def __init__(self, contigs: Sequence[str] | None = None):
        self.contigs = contigs

    def label(self, ctx):
        name = F.replace(F.col("chrom"), F.lit("."), F.lit("_"))
        if self.contigs is None:
            return name
        wanted = [alias_column(F.lit(c), ctx.aliases) for c in self.contigs]
        return F.when(alias_column(F.col("chrom"), ctx.aliases).isin(*wanted), name)


class RandomBin(Stratum):
    """A bin by a hash of the position: the same site always falls into the same one."""

    def __init__(self, n_bins: int, seed: int = 0):
        if n_bins < 1:
            raise ValueError("at least one bin")
        self.n_bins, self.seed = n_bins, seed

    def label(self, ctx):
        digest = F.md5(F.concat_ws(":", "chrom", F.col("pos").cast("string"), F.lit(str(self.seed))))
        return F.concat(F.lit("bin"), F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(self.n_bins)).cast("string"))


class Chunked(Stratum):
    """``n_chunks`` runs of consecutive included sites, the first ones one larger where the number does not divide.

    A site's number is its rank inside a position range plus the sizes of the ranges before, so no
    task holds all sites.
    """

    def __init__(self, n_chunks: int, width: int = 1 << 20):
        if n_chunks < 1:
            raise ValueError("at least one chunk")
        self.n_chunks, self.width = n_chunks, width

    def prepare(self, sites, ctx):
        return numbered(sites, self.width).withColumn("_total", F.col("_n"))

    def label(self, ctx):
        size, extra = F.floor(F.col("_total") / self.n_chunks), F.pmod(F.col("_total"), F.lit(self.n_chunks))
        edge = extra * (size + 1)
        chunk = F.when(F.col("_number") < edge, F.floor(F.col("_number") / (size + 1))).otherwise(extra + F.floor((F.col("_number") - edge) / F.greatest(size, F.lit(1))))
        return F.concat(F.lit("chunk"), chunk.cast("string"))


def numbered(sites: DataFrame, width: int = 1 << 20, order: str = "site_id") -> DataFrame:
    """Add ``_number`` (0, 1, ... in the order of ``order``) and ``_n`` (how many there are)."""
    keyed = sites.withColumn("_range", F.floor(F.col(order) / width))
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_size"))
    # one row per range of positions: their running sum is small however many sites there are
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"), F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return keyed.withColumn("_rank", rank).join(before, "_range").withColumn("_number", F.col("_rank") + F.coalesce("_before", F.lit(0))).drop("_range", "_rank", "_before")


def composite(labels: Sequence[Column]) -> Column:
    """Labels joined by dots; null if any is null; ``all`` without labels."""
    if not labels:
        return F.lit("all")
    return reduce(lambda a, b: F.concat(a, F.lit("."), b), labels)
