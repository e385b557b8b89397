"""Best hits, reciprocal best hits, hit summaries, id dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_directions(edges: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """``(a, b, *keep)`` in both directions."""
    one = F.struct(F.col(a).alias("a"), F.col(b).alias("b"), *keep)
    two = F.struct(F.col(b).alias("a"), F.col(a).alias("b"), *keep)
    return edges.select(F.inline(F.array(one, two)))


def best_hits(edges: DataFrame, a: str, b: str, score: str, ties: bool = True) -> DataFrame:
    """``(a, b, score)``: the best partner of every vertex; all of equal score, or the smallest of them."""
    sides = both_directions(edges, a, b, score)
    if ties:
        w = Window.partitionBy("a").orderBy(F.desc(score))
        return sides.withColumn("r", F.rank().over(w)).where("r = 1").drop("r")
    w = Window.partitionBy("a").orderBy(F.desc(score), "b")
    return sides.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def reciprocal(hits: DataFrame) -> DataFrame:
    """``(a, b)``, a < b, that are best hits of each other."""
    back = hits.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return hits.select("a", "b").join(back, ["a", "b"], "left_semi").where("a < b")


def summarised(hits: DataFrame, query: str, subject: str, length: str, identity: str, evalue: str, bits: str, shortest: float = 100, strong_above: int = 5, digits: int = 3) -> DataFrame:
    """Per subject the number of long hits and their mean identity, e-value and bits; strong when there are more than ``strong_above``."""
    return (
        hits.where((F.col(length) >= shortest) & F.col(query).isNotNull())
        .groupBy(subject)
        .agg(
            F.count(F.lit(1)).alias("hits"), F.round(F.avg(identity), digits).alias("identity"), F.round(F.avg(evalue), digits).alias("evalue"), F.round(F.avg(bits), digits).alias("bits")
        )
        .withColumn("strong", F.col("hits") > strong_above)
    )


def decoded(hits: DataFrame, names: DataFrame, code: str, name: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Hits with codes replaced by names, and the rows that miss one.  Names are unique by code."""
    out = hits
    for c in columns:
        n = names.select(F.col(code).alias(c), F.col(name).alias(f"{c}_name"))
        out = out.join(n, c, "left")
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(f"{c}_name").isNull()
    good = out.where(~missing)
    for c in columns:
        good = good.drop(c).withColumnRenamed(f"{c}_name", c)
    return good.select(*hits.columns), out.where(missing).select(*hits.columns)


def positive_evalue(c: Column, least: float = 1e-181) -> Column:
    """An e-value of 0 as the smallest one that is written."""
    return F.when(c == 0, F.lit(least)).otherwise(c)


def of_species(c: Column, species: str) -> Column:
    """True for an id of the species: its name, followed by a character that is no letter or digit."""
    return c.rlike(f"^{species}[^a-zA-Z0-9]")


def without_species(hits: DataFrame, query: str, subject: str, species: str) -> DataFrame:
    return hits.where(~of_species(F.col(query), species) & ~of_species(F.col(subject), species))


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, side)``: the keys that only one of two tables has."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(1))
    b = right.select(key).distinct().withColumn("in_right", F.lit(1))
    side = F.when(F.col("in_right").isNull(), "left").otherwise("right")
    return a.join(b, key, "full_outer").where("in_left is null or in_right is null").select(key, side.alias("side"))


def scores_or_zero(pairs: DataFrame, edges: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Stated pairs with the score of their edge in either direction, else 0."""
    e = both_directions(edges, a, b, score).groupBy("a", "b").agg(F.max(score).alias("found"))
    return pairs.join(e, (pairs[a] == e["a"]) & (pairs[b] == e["b"]), "left").select(pairs[a], pairs[b], F.coalesce("found", F.lit(0.0)).alias(score))
