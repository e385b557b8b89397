"""Top N items within every group, by two-stage salted ranking.

Each group is hashed into subgroups by item, the N best of every subgroup are kept, and the survivors,
at most N times the number of subgroups, are ranked again.  So a group with a third of all rows is
ranked by as many tasks as there are subgroups.  Items are aggregated within a subgroup first: an item
has one subgroup, so this needs no shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subgroups(df: DataFrame) -> int:
    """As many subgroups as the session has shuffle partitions, 16 at least."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def top_n(df: DataFrame, group: Column, item: Column, score: Column, n: int, salts: int | None = None) -> DataFrame:
    """``(group, rnk, item, score)``: the ``n`` items with the highest score in every group.

    * An item's score is its highest; an item comes once in a group.  Equal scores: smaller item first.
    * Rows without group, item or score, or with a NaN score, take no part.  -0.0 equals 0.0.
    * ``n`` below 1 is an error.  Other columns are ignored, whatever their names.  Empty in, empty out.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    salts = salts or subgroups(df)
    rows = (
        df.select(group.alias("group"), item.alias("item"), (score.cast("double") + F.lit(0.0)).alias("score"))
        .where("group is not null and item is not null and score is not null and not isnan(score)")
        .withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)).cast("int"))
    )
    best = rows.repartition("group", "salt").groupBy("group", "salt", "item").agg(F.max("score").alias("score"))
    order = (F.col("score").desc(), F.col("item").asc())
    first = best.withColumn("rnk", F.row_number().over(Window.partitionBy("group", "salt").orderBy(*order)))
    survivors = first.where(F.col("rnk") <= n).select("group", "item", "score")
    last = survivors.withColumn("rnk", F.row_number().over(Window.partitionBy("group").orderBy(*order)))
    return last.where(F.col("rnk") <= n).select("group", "rnk", "item", "score")
