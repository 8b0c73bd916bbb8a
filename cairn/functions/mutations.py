"""Columns derived from gene and mutation names."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gene families that may be dropped, and regions that are compared, by gene name.
FAMILIES = {"pe_ppe": r"(?i)^(PE|PPE)", "esx": r"(?i)^esx", "is_phage": r"(?i)^(IS\d|Rv\d+c?_IS)"}
REGIONS = {"PPE": r"^PPE(\d|_)", "PE": r"^PE(\d|_)", "ESX": r"(?i)^esx", "IS": r"^IS.*\d"}

# Hydropathy (Kyte-Doolittle), charge at neutral pH, volume (cubic angstrom).
RESIDUES = {
    "A": (1.8, 0, 88.6), "R": (-4.5, 1, 173.4), "N": (-3.5, 0, 114.1), "D": (-3.5, -1, 111.1), "C": (2.5, 0, 108.5),
    "Q": (-3.5, 0, 143.8), "E": (-3.5, -1, 138.4), "G": (-0.4, 0, 60.1), "H": (-3.2, 0.5, 153.2), "I": (4.5, 0, 166.7),
    "L": (3.8, 0, 166.7), "K": (-3.9, 1, 168.6), "M": (1.9, 0, 162.9), "F": (2.8, 0, 189.9), "P": (-1.6, 0, 112.7),
    "S": (-0.8, 0, 89.0), "T": (-0.7, 0, 116.1), "W": (-0.9, 0, 227.8), "Y": (-1.3, 0, 193.6), "V": (4.2, 0, 140.0),
}


# The classes in the order in which they are tried, what names an
# insertion or deletion, the form of a single substitution, and stop codons.
CLASSES = ("minor_indel", "indel", "other", "promoter_nt", "nonsense_Z", "synonymous", "nonsynonymous")
MINOR_INDEL, INDELS = "minorindel", ("_ins_", "_del_", "indel")
SUBSTITUTION = "^[A-Za-z][0-9-]+[A-Za-z*!]$"
STOPS = ("Z", "*", "!")


def mut_class(mutation: Column) -> Column:
    """Consequence class: an insertion or deletion first, then single
    substitutions by case and letters, `other` for the rest."""
    first, last = F.substring(mutation, 1, 1), F.substring(mutation, -1, 1)
    is_indel = reduce(Column.__or__, [mutation.contains(x) for x in INDELS])
    kinds = {
        "minor_indel": mutation.contains(MINOR_INDEL),
        "indel": is_indel,
        "other": ~mutation.rlike(SUBSTITUTION),
        "promoter_nt": first.rlike("[a-z]") | last.rlike("[a-z]"),
        "nonsense_Z": last.isin(*STOPS),
        "synonymous": first == last,
        "nonsynonymous": F.lit(True),
    }
    return F.coalesce(*[F.when(kinds[c], c) for c in CLASSES])


def region(gene: Column, families: Mapping[str, str] = REGIONS) -> Column:
    """First family whose pattern the gene matches, else `core`."""
    out = F.lit("core")
    for name, pattern in reversed(families.items()):
        out = F.when(gene.rlike(pattern), name).otherwise(out)
    return out


def radicalness(mutation: Column) -> Column:
    """How far a substitution moves hydropathy, charge and volume; 0 unless
    both residues are known. A literal map: nothing to join."""
    table = F.create_map(*[x for k, v in RESIDUES.items() for x in (F.lit(k), F.array(*map(F.lit, map(float, v))))])
    a = table[F.regexp_extract(mutation, "^([A-Z])[0-9]+[A-Z]$", 1)]
    b = table[F.regexp_extract(mutation, "^[A-Z][0-9]+([A-Z])$", 1)]
    return F.coalesce(F.abs(a[0] - b[0]) + 2 * F.abs(a[1] - b[1]) + F.abs(a[2] - b[2]) / 50, F.lit(0.0))


def split_feature(name: Column) -> tuple[Column, Column]:
    """(gene, mutation) at the first underscore."""
    return F.regexp_extract(name, "^([^_]*)_", 1), F.regexp_extract(name, "^[^_]*_(.*)$", 1)
