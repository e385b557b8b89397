"""Position-specific scores: sequence weights, weighted frequencies, prior correction, log odds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: residue priors, 22 letters
PRIORS = {
    "A": 0.067, "C": 0.03, "D": 0.054, "E": 0.053, "F": 0.036, "G": 0.067, "H": 0.026, "I": 0.035, "K": 0.066, "L": 0.069, "M": 0.016,
    "N": 0.04, "P": 0.046, "Q": 0.034, "R": 0.038, "S": 0.074, "T": 0.056, "V": 0.062, "W": 0.012, "Y": 0.03, "X": 0.0445, "-": 0.0445,
}


def priors_table(spark: SparkSession, priors: dict[str, float] | None = None) -> DataFrame:
    """``(aa, prior)``, 22 rows."""
    return spark.createDataFrame(sorted((priors or PRIORS).items()), "aa string, prior double")


def sequence_weights(columns: DataFrame) -> DataFrame:
    """``(id, weight)`` of ``(id, pos, aa)``: position-based weights that sum to one.

    A row gets ``1 / (different residues * rows with its residue)`` in every column with two or more
    residues; a gap counts as a residue there.
    """
    per = columns.groupBy("pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    of = per.groupBy("pos").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("aa") != "-", F.col("n"))).alias("filled"))
    value = F.when(F.coalesce("filled", F.lit(0)) >= 2, 1.0 / (F.col("kinds") * F.col("n"))).otherwise(0.0)
    shares = per.join(of, "pos").select("pos", "aa", value.alias("w"))  # bounded: 22 letters a column
    raw = columns.join(shares, ["pos", "aa"]).groupBy("id").agg(F.sum("w").alias("w"))
    total = raw.agg(F.sum("w").alias("t"))
    return raw.crossJoin(F.broadcast(total)).select("id", (F.col("w") / F.col("t")).alias("weight"))


def column_frequencies(columns: DataFrame, weights: DataFrame, letters: DataFrame) -> DataFrame:
    """``(pos, aa, freq)``: weighted, for every column and letter; letters that are not listed count as X."""
    known = columns.join(F.broadcast(letters.select("aa", F.lit(1).alias("known"))), "aa", "left").select("id", "pos", F.when(F.col("known") == 1, F.col("aa")).otherwise("X").alias("aa"))
    found = known.join(weights, "id").groupBy("pos", "aa").agg(F.sum("weight").alias("f"))
    grid = columns.select("pos").distinct().crossJoin(F.broadcast(letters.select("aa")))
    return grid.join(found, ["pos", "aa"], "left").select("pos", "aa", F.coalesce("f", F.lit(0.0)).alias("freq"))


def corrected(frequencies: DataFrame, priors: DataFrame, k: float = 1.0) -> DataFrame:
    """``(pos, aa, freq, prior)`` with the prior mixed in at weight ``k``."""
    return frequencies.join(F.broadcast(priors), "aa").select("pos", "aa", ((F.col("freq") + F.col("prior") * k) / (1 + k)).alias("freq"), "prior")


def log_odds(mixed: DataFrame, matrix: DataFrame) -> DataFrame:
    """``(pos, aa, score)``: ``2 log2(f / prior)`` plus the frequency-weighted substitution scores, 4 decimals.

    Letters that the matrix lacks add nothing.  ``matrix`` is ``(aa1, aa2, score)``.
    """
    m = F.broadcast(matrix.select(F.col("aa1").alias("aa"), F.col("aa2").alias("b"), F.col("score").alias("m")))
    other = mixed.select("pos", F.col("aa").alias("b"), F.col("freq").alias("fb"))
    added = other.join(m, "b").groupBy("pos", "aa").agg(F.sum(F.col("fb") * F.col("m")).alias("subs"))
    base = 2 * F.log2(F.col("freq") / F.col("prior"))
    return mixed.join(added, ["pos", "aa"], "left").select("pos", "aa", F.round(base + F.coalesce("subs", F.lit(0.0)), 4).alias("score"))


def membrane_columns(topology: DataFrame) -> DataFrame:
    """``(pos, membrane)`` of ``(id, pos, symbol)``: true where M holds at least half of the rows."""
    return topology.groupBy("pos").agg((F.count(F.when(F.col("symbol") == "M", 1)) * 2 >= F.count(F.lit(1))).alias("membrane"))


def window_products(left: DataFrame, right: DataFrame, span: int = 5) -> DataFrame:
    """``(start1, start2, score)``: for windows of ``span`` columns of two profiles ``(pos, aa, score)``, the sum of their products.

    A product of columns is over the letters, made in tiles of columns; windows run along both profiles at once.
    """
    from seqloom.operators.pairs import products, scored_between

    letters = sorted(r.aa for r in left.select("aa").union(right.select("aa")).distinct().collect())  # an alphabet
    wide = lambda p: p.groupBy("pos").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("aa") == a, F.col("score"))), F.lit(0.0)) for a in letters]).alias("x"))
    cells = scored_between(wide(left), wide(right), "pos", "x", products, "product double").select(F.col("id1").alias("p1"), F.col("id2").alias("p2"), F.col("product").alias("v"))
    w = Window.partitionBy(F.col("p2") - F.col("p1")).orderBy("p1").rowsBetween(0, span - 1)
    out = cells.select(F.col("p1").alias("start1"), F.col("p2").alias("start2"), F.sum("v").over(w).alias("score"), F.count("v").over(w).alias("n"))
    return out.where(F.col("n") == span).drop("n")
