"""The genetic code, degeneracy and synonymy; built from the code by rule."""

from __future__ import annotations

from itertools import product

# The standard genetic code in the order TTT, TTC, TTA, TTG, TCT, ...; * is a stop.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = ["".join(c) for c in product("TCAG", repeat=3)]
CODE = dict(zip(CODONS, AMINO_ACIDS, strict=True))
#: Synonymous alternatives of a site to its degeneracy; there is no three-fold class.
DEGENERACY = {0: 0, 1: 2, 2: 2, 3: 4}


def synonymous(a: str, b: str) -> bool:
    """Stops are synonymous with stops."""
    return CODE[a] == CODE[b]


def degeneracy(codon: str, pos: int) -> int:
    others = [codon[:pos] + b + codon[pos + 1 :] for b in "ACGT" if b != codon[pos]]
    return DEGENERACY[sum(synonymous(codon, c) for c in others)]


def degeneracy_rows() -> list[tuple[str, int, int]]:
    return [(c, p, degeneracy(c, p)) for c in CODONS for p in range(3)]
