"""Nucleotide codes and the genetic code."""

from __future__ import annotations

from itertools import product

# The IUPAC codes and what each stands for, in the order in which expansions are tried.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "GCT", "N": "ACGT",
}
# Pairs of complements.
COMPLEMENTS = ("AT", "CG", "MK", "RY", "WW", "SS", "VB", "HD", "NN")
# Amino acids of the standard code for codons in the order T, C, A, G of each place.
_AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Stop and start codons.
STOPS, STARTS = ("TAA", "TAG", "TGA"), ("ATG", "GTG", "TTG")

CODE = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), _AMINO_ACIDS, strict=True)}
_both = {a: b for x, y in COMPLEMENTS for a, b in ((x, y), (y, x))}
COMPLEMENT = _both | {a.lower(): b.lower() for a, b in _both.items()}
#: Two strings for translate().
COMPLEMENT_FROM, COMPLEMENT_TO = "".join(COMPLEMENT), "".join(COMPLEMENT.values())
