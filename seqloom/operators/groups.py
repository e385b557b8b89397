"""Scores and comparison of groups of sequences.

A membership table is ``(grp, member, taxon)``, one row per member of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def taxon_counts(members: DataFrame) -> DataFrame:
    """``(grp, taxon, k, size)``."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    return members.groupBy("grp", "taxon").agg(F.count(F.lit(1)).alias("k")).join(sizes, "grp")


def product_scores(members: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """``(grp, score)``: a product over single-copy taxa, and one over multi-copy taxa against it.

    Single-copy taxa give ``2 (1 + n / size)`` each, multi-copy ones ``k k / n``; n and size belong to the
    containing group, which ``parents`` (a membership table with the same ``grp``) names where cliques
    were taken out.  A group of one scores 0, a group of a single taxon has no score.
    """
    counts = taxon_counts(members)
    of = taxon_counts(parents if parents is not None else members).select("grp", "taxon", F.col("k").alias("n"), F.col("size").alias("all"))
    single = F.when(F.col("k") == 1, 2 * (1 + F.col("n") / F.col("all"))).otherwise(1.0)
    multi = F.when(F.col("k") > 1, F.col("k") * (F.col("k") / F.col("n"))).otherwise(1.0)
    out = counts.join(of, ["grp", "taxon"]).groupBy("grp").agg(F.product(single).alias("s"), F.product(multi).alias("m"), F.count(F.lit(1)).alias("taxa"), F.max("size").alias("size"))
    return out.select("grp", F.when(F.col("size") == 1, 0.0).when(F.col("taxa") > 1, F.col("s") - F.col("m")).alias("score"))


def squared_scores(members: DataFrame) -> DataFrame:
    """``(grp, size, score)``: the number of single-copy taxa squared, less the members of multi-copy taxa; 0 for one member."""
    out = taxon_counts(members).groupBy("grp", "size").agg(F.count(F.when(F.col("k") == 1, 1)).alias("s"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("m"))
    return out.select("grp", "size", F.when(F.col("size") == 1, F.lit(0)).otherwise(F.col("s") * F.col("s") - F.col("m")).cast("bigint").alias("score"))


def global_scores(members: DataFrame) -> DataFrame:
    """``(grp, score)``: single-copy taxa give the root of the taxon's count in all groups, multi-copy ones ``-2 k`` over it; 0 for one member."""
    everywhere = members.groupBy("taxon").agg(F.count(F.lit(1)).alias("g"))
    root = F.sqrt("g")
    value = F.when(F.col("k") == 1, root).otherwise(-2 * F.col("k") / root)
    out = taxon_counts(members).join(everywhere, "taxon").groupBy("grp").agg(F.sum(value).alias("score"), F.max("size").alias("size"))
    return out.select("grp", F.when(F.col("size") == 1, 0.0).otherwise(F.col("score")).alias("score"))


def plus_minus_scores(members: DataFrame) -> DataFrame:
    """``(grp, score)``: 1 for a single-copy taxon, -1 for another."""
    return taxon_counts(members).groupBy("grp").agg(F.sum(F.when(F.col("k") == 1, 1).otherwise(-1)).cast("bigint").alias("score"))


def set_scores(scored: DataFrame, taxa: DataFrame | None = None) -> DataFrame:
    """One row: the size-weighted score of a set of groups, corrected for the number of groups.

    The correction is the distance of that number from the root of the member count (``srs``), and from the
    members per taxon where ``taxa`` is given (``gpt``).
    """
    t = scored.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("score") * F.col("size"))).alias("weighted"))
    s = F.col("weighted") / F.col("n")
    out = t.select("n", "k", s.alias("total"), F.round(s / F.col("k") - F.pow(F.abs(F.sqrt("n") - F.col("k")), F.lit(1.2)), 2).alias("srs"))
    if taxa is None:
        return out
    per = taxa.agg(F.count_distinct("taxon").alias("taxa"))
    gpt = F.round(F.col("total") / F.col("k") - F.pow(F.abs(F.col("n") / F.col("taxa") - F.col("k")), F.lit(1.2)), 2)
    return out.crossJoin(F.broadcast(per)).select("n", "k", "total", "srs", gpt.alias("gpt"))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(grp1, grp2, common, size1, size2)`` of all groups of two tables that share a member."""
    a = left.select(F.col("grp").alias("grp1"), "member").distinct()
    b = right.select(F.col("grp").alias("grp2"), "member").distinct()
    sizes1 = a.groupBy("grp1").agg(F.count(F.lit(1)).alias("size1"))
    sizes2 = b.groupBy("grp2").agg(F.count(F.lit(1)).alias("size2"))
    common = a.join(b, "member").groupBy("grp1", "grp2").agg(F.count(F.lit(1)).alias("common"))
    return common.join(sizes1, "grp1").join(sizes2, "grp2")


def set_overlap(found: DataFrame, members: int | None = None) -> DataFrame:
    """One row ``score``: how well the second set of groups reproduces the first one (not symmetric).

    Each pair of groups gives ``2 m / (a + b) * m / a``, weighted with ``a`` over all members of the first set.
    """
    pair = 2 * F.col("common") / (F.col("size1") + F.col("size2")) * F.col("common") / F.col("size1")
    per = found.groupBy("grp1").agg(F.sum(pair).alias("tally"), F.max("size1").alias("size1"))
    total = F.lit(members) if members else F.sum("size1")
    return per.agg((F.sum(F.col("tally") * F.col("size1")) / total).alias("score"))


def symmetric_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``score``: the mean over both directions."""
    both = set_overlap(overlaps(left, right)).unionByName(set_overlap(overlaps(right, left)))
    return both.agg(F.avg("score").alias("score"))


def dice(found: DataFrame) -> DataFrame:
    return found.withColumn("dice", 2 * F.col("common") / (F.col("size1") + F.col("size2")))


def named(groups: DataFrame, parent: str, order: list, name: str = "name", mark: str = "") -> DataFrame:
    """Names ``parent_0``, ``parent_1``, ... in a stated order; ``mark`` (as in ``parent_c1``) tells cliques."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1
    return groups.withColumn(name, F.concat(F.col(parent), F.lit("_" + mark), n.cast("string")))
