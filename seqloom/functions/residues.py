"""Residues, codons, gaps and substitution matrices."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: the standard genetic code, codons in the order of the bases T, C, A, G
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# fixed values: BLOSUM62 (Henikoff and Henikoff 1992), lower half
BLOSUM62 = """
A 4
R -1 5
N -2 0 6
D -2 -2 1 6
C 0 -3 -3 -3 9
Q -1 1 0 0 -3 5
E -1 0 0 2 -4 2 5
G 0 -2 0 -1 -3 -2 -2 6
H -2 0 1 -1 -3 0 0 -2 8
I -1 -3 -3 -3 -1 -3 -3 -4 -3 4
L -1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
K -1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
M -1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
F -2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
S 1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
T 0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
V 0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""


def parse_half_matrix(text: str) -> dict[tuple[str, str], int]:
    """Both directions of a lower-half matrix text: a row's residue, then its scores against the rows so far."""
    rows = [line.split() for line in text.strip().splitlines()]
    order = [r[0] for r in rows]
    half = {(a, b): int(v) for a, *values in rows for b, v in zip(order, values)}
    return half | {(b, a): v for (a, b), v in half.items()}


def completed(matrix: dict[tuple[str, str], int], unknown: str = "X", score: int = -1) -> dict[tuple[str, str], int]:
    """A matrix made symmetric, with an unknown residue scored alike against all."""
    both = matrix | {(b, a): v for (a, b), v in matrix.items()}
    letters = {a for a, _ in both} | {unknown}
    return {(a, b): both.get((a, b), score) for a, b in product(sorted(letters), repeat=2) if (a, b) in both or unknown in (a, b)}


def matrix_table(spark: SparkSession, matrix: dict[tuple[str, str], int]) -> DataFrame:
    """``(aa1, aa2, score)`` of a matrix; a few hundred rows."""
    return spark.createDataFrame([(a, b, v) for (a, b), v in sorted(matrix.items())], "aa1 string, aa2 string, score int")


def degapped(c: Column, gap: str = "-") -> Column:
    return F.replace(c, F.lit(gap), F.lit(""))


def codon_table() -> dict[str, str]:
    return {"".join(c): aa for c, aa in zip(product("TCAG", repeat=3), GENETIC_CODE)}


def translated(c: Column, to_stop: bool = True) -> Column:
    """A coding sequence as protein; an incomplete last codon is left out, an unknown codon is X."""
    table = F.create_map(*[F.lit(x) for pair in codon_table().items() for x in pair])
    seq = F.upper(F.replace(c, F.lit("U"), F.lit("T")))
    n = F.floor(F.length(seq) / 3).cast("int")
    codons = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.element_at(table, F.substr(seq, i * 3 - 2, F.lit(3))), F.lit("X"))))
    protein = F.coalesce(F.array_join(codons, ""), F.when(c.isNotNull(), F.lit("")))
    return F.substring_index(protein, "*", 1) if to_stop else protein


def codons_on_gaps(protein: Column, coding: Column) -> Column:
    """The codons of a coding sequence laid under an aligned protein; a gap is three gaps."""
    aa = F.split(protein, "")
    before = F.transform(aa, lambda x, i: F.size(F.filter(F.slice(aa, F.lit(1), i), lambda y: y != "-")))
    laid = F.transform(F.arrays_zip(aa.alias("aa"), before.alias("k")), lambda z: F.when(z["aa"] == "-", F.lit("---")).otherwise(F.substr(coding, z["k"] * 3 + 1, F.lit(3))))
    return F.when(protein == "", F.lit("")).otherwise(F.array_join(laid, ""))


def alphabet(letters: Column, least: float = 0.9) -> Column:
    """``nucl`` where more than ``least`` of the letters are A, C, G or T, else ``prot``; null for no letter."""
    seq = F.upper(F.regexp_replace(letters, "[^A-Za-z]", ""))
    share = F.length(F.regexp_replace(seq, "[^ACGT]", "")) / F.length(seq)
    return F.when(F.length(seq) > 0, F.when(share > least, F.lit("nucl")).otherwise(F.lit("prot")))


def fitness(c: Column) -> Column:
    """100; a quarter of it without M at the start, half of it for a length outside 350..550."""
    start = F.when(F.left(c, F.lit(1)) == "M", 1.0).otherwise(0.25)
    size = F.when(F.length(c).between(350, 550), 1.0).otherwise(0.5)
    return 100 * start * size


def cut_behind(seq: Column, segments: Column, n: int, extra: int = 0) -> Column:
    """A sequence up to the end of its n-th segment (from 1) and ``extra`` residues more; null with fewer segments."""
    end = F.get(segments, F.lit(n - 1))["end"]
    return F.when(F.size(segments) >= n, F.left(seq, F.least(F.length(seq), end + F.lit(extra))))


def reading_frame(coding: Column) -> Column:
    """A coding sequence whose length is a multiple of three; any other one is an error when its row is read."""
    wrong = F.raise_error(F.concat(F.lit("length is no multiple of three: "), F.length(coding).cast("string")))
    return F.when(F.length(coding) % 3 == 0, coding).when(coding.isNotNull(), wrong)
