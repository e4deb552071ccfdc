"""Slow row-by-row versions to compare with."""

from __future__ import annotations

import math
from collections import defaultdict


def pmf(m, der, k, n):
    if k > der or n - k > m - der:
        return 0.0
    return math.comb(der, k) * math.comb(m - der, n - k) / math.comb(m, n)


def calls(site):
    alleles = [site["ref"], *site["alt"]]
    names = [alleles[c] for g in site["gt"] for c in g if c >= 0]
    return [a for a in names if a and set(a) <= set("ACGT")]


def key(site, n, skip=True):
    """(m, der) of a SNP, or None."""
    haps = calls(site)
    if len(haps) < n:
        return None
    aa = site["info"].get("AA", "").upper()
    if aa not in ("A", "C", "G", "T"):
        if skip:
            return None
        aa = site["ref"]
    if len({*haps, aa}) > 2:
        return None
    return len(haps), len(haps) - haps.count(aa)


def spectrum(sites, n, skip=True):
    out = [0.0] * (n + 1)
    for s in sites:
        k = key(s, n, skip)
        if k:
            for i in range(n + 1):
                out[i] += pmf(*k, i, n)
    return out


def pairs(sites, n, d, offset):
    out = [[0.0] * (n + 1) for _ in range(n + 1)]
    by = defaultdict(list)
    for s in sites:
        k = key(s, n, False)
        if k:
            by[s["chrom"]].append((s["pos"], [pmf(*k, i, n) for i in range(n + 1)]))
    for rows in by.values():
        for p, v in rows:
            for q, w in rows:
                if offset < q - p <= offset + d:
                    for i in range(n + 1):
                        for j in range(n + 1):
                            out[i][j] += v[i] * w[j] / 2
                            out[j][i] += v[i] * w[j] / 2
    return out
