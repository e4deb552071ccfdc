"""Down-projection of allele counts as built-in expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_choose(a: Column, b: Column) -> Column:
    """ln C(a, b) for 0 <= b <= a; the sum runs over the smaller side."""
    k = F.least(b, a - b)
    return F.when(k > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + F.log((a - k + i) / i))).otherwise(F.lit(0.0))


def pmf(m: Column, der: Column, k: Column, n: int) -> Column:
    """Probability of ``k`` derived among ``n`` drawn without replacement from ``m`` with ``der`` derived."""
    fits = (k <= der) & (F.lit(n) - k <= m - der) & (F.lit(n) <= m)
    return F.when(fits, F.exp(ln_choose(der, k) + ln_choose(m - der, F.lit(n) - k) - ln_choose(m, F.lit(n)))).otherwise(0.0)


def pmf_array(m: Column, der: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: pmf(m, der, k, n))


def draw(m: Column, der: Column, n: int, *key: Column | str, seed: int = 0) -> Column:
    """One hypergeometric draw, a pure function of the key columns and ``seed``: inversion of a hashed uniform."""
    u = (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.aggregate(F.slice(pmf_array(m, der, n), F.lit(1), k + 1), F.lit(0.0), lambda a, x: a + x))
    return F.size(F.filter(steps, lambda c: c < u))


def pmf_vector(m: int, der: int, n: int) -> np.ndarray:
    """The same probabilities for all k on the driver, from exact integers."""
    total = math.comb(m, n)
    return np.array([math.comb(der, k) * math.comb(m - der, n - k) / total if n - k <= m - der else 0.0 for k in range(n + 1)])
