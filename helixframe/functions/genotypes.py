"""Expressions over one site's genotypes.

A site is a row of the ``SITES`` schema. A haplotype is *called* when its allele consists of the
letters A, C, G, T only; -1 (missing) and -2 (padding) codes never are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SITES = (
    "site_id bigint, chrom string, pos bigint, ref string, alt array<string>, gt array<array<int>>, phased array<boolean>, "
    "is_snp boolean, is_mnp boolean, is_indel boolean, is_deletion boolean, is_sv boolean, is_dummy boolean, info map<string,string>"
)
BASES = ["A", "C", "G", "T"]


def is_base(x: Column) -> Column:
    return F.coalesce(x.isin(*BASES), F.lit(False))


def alleles() -> Column:
    return F.concat(F.array(F.col("ref")), F.coalesce(F.col("alt"), F.expr("cast(array() as array<string>)")))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def haplotypes(samples: Sequence[int] | None = None) -> Column:
    """Allele strings of the called haplotypes of the given sample indices (None: all), in sample order."""
    gt = F.col("gt") if samples is None else F.transform(F.array(*(F.lit(int(i)) for i in samples)), lambda i: F.element_at("gt", i + 1)) if samples else F.expr("cast(array() as array<array<int>>)")
    codes = F.filter(F.flatten(F.filter(F.coalesce(gt, F.expr("cast(array() as array<array<int>>)")), lambda g: g.isNotNull())), lambda c: c >= 0)
    # an allele is tested once per site, not once per haplotype
    usable = F.transform(alleles(), lambda a: F.when(a.rlike("^[ACGT]+$"), a))
    return bound(usable, lambda names: F.filter(F.transform(codes, lambda c: F.get(names, c)), lambda a: a.isNotNull()))


def n_called(samples: Sequence[int] | None = None) -> Column:
    return F.size(haplotypes(samples))


def distinct_alleles(samples: Sequence[int] | None = None) -> Column:
    return F.array_distinct(haplotypes(samples))


def count_of(haps: Column, allele: Column) -> Column:
    return F.size(F.filter(haps, lambda a: a == allele))


def called_bases(samples: Sequence[int] | None = None) -> Column:
    """Single letters of all called alleles; a two-letter allele counts as two bases."""
    return F.filter(F.split(F.concat_ws("", haplotypes(samples)), ""), lambda c: c != "")


def major_of(items: Column) -> Column:
    """The most frequent item; ties go to the one that occurs first; null for none."""

    def best(x: Column) -> Column:
        return F.array_max(F.transform(F.array_distinct(x), lambda a: F.struct(count_of(x, a).alias("n"), (-F.array_position(x, a)).alias("first"), a.alias("item"))))["item"]

    return bound(items, best)


def snp_flag() -> Column:
    """One reference letter, and every alternative (at least one) a single base."""
    return (F.length("ref") == 1) & (F.size(F.coalesce("alt", F.expr("cast(array() as array<string>)"))) > 0) & F.forall("alt", is_base)


def is_monomorphic() -> Column:
    """No variant class applies, nothing is alternative and the reference is a base."""
    quiet = ~(F.col("is_snp") | F.col("is_mnp") | F.col("is_indel") | F.col("is_deletion") | F.col("is_sv"))
    return quiet & (F.size(F.coalesce("alt", F.expr("cast(array() as array<string>)"))) < 1) & is_base(F.col("ref"))


def genotype_strings() -> Column:
    """Alleles of each sample joined by "/" or, where phased, "|"; "." stands for a missing call."""

    def one(g: Column, i: Column) -> Column:
        names = F.transform(F.filter(g, lambda c: c > -2), lambda c: F.when(c >= 0, F.try_element_at(alleles(), c + 1)).otherwise("."))
        phased = F.coalesce(F.try_element_at("phased", i + 1), F.lit(False))
        return F.when(F.size(names) > 0, F.when(phased, F.array_join(names, "|")).otherwise(F.array_join(names, "/"))).otherwise(".")

    return F.transform("gt", one)


def dummy_genotypes(n_samples: int, ploidy: int = 2) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(0), ploidy), n_samples)
