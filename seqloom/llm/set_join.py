"""All similar pairs between set-valued records: size-aware overlap join under the Dice similarity.

A pair of sets of sizes a <= b is similar when its overlap reaches ``need(a, b)``, which bounds b by a.

* Both sets small: each set enumerates its subsets of ``need(a, b)`` values for every size the partner
  can have.  Sets of sizes a and b that share such a subset are similar, so this step makes no false
  candidate, and a subset shared by many sets costs no more than its results.
* Any set large: inverted lists.  Values are ordered from rare to frequent; similar sets must share a
  value among the first few of each (their prefix), so lists of frequent values stay short.  Candidates
  pass the size and position bounds before they are compared.

Both results are united and filtered by the final similarity.  Equal sets are one class from the start:
a hundred thousand copies of a set are one set in the join.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from fractions import Fraction
from math import ceil, floor

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.plans.stages import Stages

#: Values that hold at least this share of all occurrences are frequent; by that bound there are at most its inverse.
FREQUENT_SHARE = 1e-4


class Dice:
    """Exact size arithmetic of ``2 * overlap / (a + b) >= threshold``."""

    def __init__(self, threshold: float):
        self.t = Fraction(str(threshold))
        if not 0 < self.t <= 1:
            raise ValueError("threshold must lie in (0, 1]")

    def need(self, a: int, b: int) -> int:
        return ceil(self.t * (a + b) / 2)

    def least(self, b: int) -> int:
        """The smallest size of a partner of a set of size ``b``."""
        return ceil(self.t * b / (2 - self.t))

    def most(self, a: int) -> int:
        return floor(a * (2 - self.t) / self.t)

    def need_column(self, a: Column, b: Column) -> Column:
        n, d = self.t.numerator, 2 * self.t.denominator
        return F.floor((F.lit(n) * (a + b) + F.lit(d - 1)) / F.lit(d)).cast("int")

    def similar(self, overlap: Column, a: Column, b: Column) -> Column:
        return F.lit(2 * self.t.denominator) * overlap >= F.lit(self.t.numerator) * (a + b)


def set_classes(sets: DataFrame, rec: str, members: str, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """``(cls, tokens, size)`` of the different sets and ``(rec, cls)``; ``cls`` is the smallest record of the class."""
    clean = sets.select(F.col(rec).alias("rec"), F.array_sort(F.array_distinct(F.array_compact(F.col(members)))).alias("tokens")).where(
        "rec is not null and size(tokens) > 0"
    )
    clean = stages.cut(clean, "sets")
    classes = stages.cut(
        clean.groupBy("tokens").agg(F.min("rec").alias("cls")).select("cls", "tokens", F.size("tokens").alias("size")), "classes"
    )
    belongs = clean.join(classes.select("cls", "tokens"), "tokens").select("rec", "cls")
    return classes, belongs


def similar_sets(classes: DataFrame, threshold: float, stages: Stages, small: int = 8, allowed: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``(cls1, cls2, overlap)``, ``cls1 < cls2``, of all pairs of different sets at or above the threshold.

    ``allowed`` says of two classes whether their pair is wanted; others are dropped where they meet.
    """
    dice = Dice(threshold)
    wanted = allowed or (lambda x, y: F.lit(True))
    found = _by_subsets(classes, dice, small, wanted).unionByName(_by_lists(classes, dice, small, stages, wanted)).distinct()
    left = classes.select(F.col("cls").alias("cls1"), F.col("tokens").alias("t1"))
    right = classes.select(F.col("cls").alias("cls2"), F.col("tokens").alias("t2"))
    return (
        found.join(left, "cls1")
        .join(right, "cls2")
        .select("cls1", "cls2", F.size(F.array_intersect("t1", "t2")).alias("overlap"), F.size("t1").alias("a"), F.size("t2").alias("b"))
        .where(dice.similar(F.col("overlap"), F.col("a"), F.col("b")))
        .select("cls1", "cls2", "overlap")
    )


def _by_subsets(classes: DataFrame, dice: Dice, small: int, wanted: Callable) -> DataFrame:
    kind = classes.schema["cls"].dataType
    schema = T.StructType(
        [T.StructField("cls", kind), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("large", T.BooleanType()), T.StructField("part", T.LongType())]
    )

    def subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for cls, tokens in zip(batch["cls"], batch["tokens"]):
                s, values = len(tokens), list(tokens)
                hashed: dict[int, list[int]] = {}
                sizes = [(s, b, False) for b in range(s, min(small, dice.most(s)) + 1)]
                sizes += [(a, s, True) for a in range(max(1, dice.least(s)), s)]
                for a, b, large in sizes:
                    c = dice.need(a, b)
                    if c not in hashed:
                        hashed[c] = [xxhash.xxh64_intdigest("\x1f".join(x)) - 2**63 for x in itertools.combinations(values, c)]
                    out.extend((cls, a, b, large, h) for h in hashed[c])
            yield pd.DataFrame(out, columns=["cls", "a", "b", "large", "part"])

    parts = classes.where(F.col("size") <= small).select("cls", "tokens").mapInPandas(subsets, schema)
    x = parts.where("not large").select(F.col("cls").alias("x"), "a", "b", "part")
    y = parts.where("large or a = b").select(F.col("cls").alias("y"), "a", "b", "part")
    return (
        x.join(y, ["a", "b", "part"])
        .where("x <> y and (a < b or x < y)")
        .where(wanted(F.col("x"), F.col("y")))
        .select(F.least("x", "y").alias("cls1"), F.greatest("x", "y").alias("cls2"))
    )


def _by_lists(classes: DataFrame, dice: Dice, small: int, stages: Stages, wanted: Callable) -> DataFrame:
    wide = classes.where(F.col("size") >= dice.least(small + 1))
    token = wide.select("cls", "size", F.explode("tokens").alias("token"))
    counts = stages.cut(token.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).head()[0] or 0
    often = counts.where(F.col("n") >= F.lit(FREQUENT_SHARE * total))  # at most 1 / FREQUENT_SHARE rows
    rare = counts.where(F.col("n") < F.lit(FREQUENT_SHARE * total))
    frequent = token.join(F.broadcast(often), "token")
    others = token.join(F.broadcast(often.select("token")), "token", "left_anti").join(rare, "token")
    ordered = (
        frequent.unionByName(others)
        .groupBy("cls", "size")
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
        .select("cls", "size", F.col("tokens.token").alias("tokens"))
    )
    # as the smaller set of a pair a shorter prefix will do
    n, d = dice.t.numerator, dice.t.denominator
    s = F.col("size")
    low = F.floor((F.lit(n) * s + F.lit(2 * d - n - 1)) / F.lit(2 * d - n)).cast("int")
    ordered = stages.cut(
        ordered.select(
            "cls", "size", F.slice("tokens", F.lit(1), s - dice.need_column(s, low) + 1).alias("head"), (s - dice.need_column(s, s) + 1).alias("short")
        ),
        "prefixes",
    )
    lists = ordered.select("cls", "size", "short", F.posexplode("head").alias("pos", "token"))
    x = lists.where("pos < short").select("token", F.col("cls").alias("x"), F.col("size").alias("a"), F.col("pos").alias("i"))
    y = lists.where(F.col("size") > small).select("token", F.col("cls").alias("y"), F.col("size").alias("b"), F.col("pos").alias("j"))
    a, b = F.col("a"), F.col("b")
    room = F.least(a - F.col("i"), b - F.col("j"))
    return (
        x.join(y, "token")
        .where((F.col("x") != F.col("y")) & (a <= b) & (F.lit(d) * F.lit(2) * a >= F.lit(n) * (a + b)) & ((a < b) | (F.col("x") < F.col("y"))))
        .where((room >= dice.need_column(a, b)) & wanted(F.col("x"), F.col("y")))
        .select(F.least("x", "y").alias("cls1"), F.greatest("x", "y").alias("cls2"))
    )


def similar_records(sets: DataFrame, rec: str, members: str, threshold: float, small: int = 8) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes ``(cls1, cls2, overlap)`` and membership ``(rec, cls)`` of a table of sets.

    * A null or empty set, and a record without id, has no pair.  Null members do not count; repeats and
      order mean nothing.  A record id must be unique; of a repeated one every set takes part.
    * For pairs between two tables see :func:`similar_between`.
    * Other columns are ignored, whatever their names.  Empty in, empty out.
    """
    stages = Stages(sets.sparkSession, "set-join")
    classes, belongs = set_classes(sets, rec, members, stages)
    return stages.cut(similar_sets(classes, threshold, stages, small), "pairs"), stages.cut(belongs, "members")


def similar_between(left: DataFrame, right: DataFrame, rec: str, members: str, threshold: float, small: int = 8) -> DataFrame:
    """``(rec1, rec2)``: every record of one table with every similar or equal one of another.

    Nulls, repeats and other columns as in :func:`similar_records`; ids need be unique in their own table only.
    Equal sets of both tables are one class, which knows the tables it comes from; classes of one and the same
    table only never become candidates.
    """
    stages = Stages(left.sparkSession, "set-join")
    tokens = F.array_sort(F.array_distinct(F.array_compact(F.col(members)))).alias("tokens")
    sides = [t.select(F.lit(k).alias("side"), F.col(rec).cast("string").alias("id"), F.col(rec).alias(f"rec{k}"), tokens).where("id is not null and size(tokens) > 0") for k, t in ((1, left), (2, right))]
    clean = stages.cut(sides[0].unionByName(sides[1], allowMissingColumns=True), "sets")
    per = clean.groupBy("tokens").agg(F.min(F.struct("id", "side")).alias("first"), F.sum_distinct("side").alias("sides"))
    name = F.struct(F.col("first.id").alias("id"), F.col("first.side").alias("side"), F.col("sides").cast("int").alias("sides"))
    classes = stages.cut(per.select(name.alias("cls"), "tokens", F.size("tokens").alias("size")), "classes")
    of = lambda c, k: c["sides"].bitwiseAND(F.lit(k)) > 0
    across = lambda x, y: (of(x, 1) & of(y, 2)) | (of(x, 2) & of(y, 1))
    pairs = stages.cut(similar_sets(classes, threshold, stages, small, across), "pairs")
    belongs = stages.cut(clean.join(classes.select("cls", "tokens"), "tokens").select("side", "rec1", "rec2", "cls"), "members")
    one = belongs.where("side = 1").select("rec1", F.col("cls").alias("c1"))
    two = belongs.where("side = 2").select("rec2", F.col("cls").alias("c2"))
    ways = pairs.select(F.inline(F.array(F.struct(F.col("cls1").alias("c1"), F.col("cls2").alias("c2")), F.struct(F.col("cls2").alias("c1"), F.col("cls1").alias("c2")))))
    same = one.join(two, F.col("c1") == F.col("c2")).select("rec1", "rec2")
    return ways.join(one, "c1").join(two, "c2").select("rec1", "rec2").unionByName(same)


def record_pairs(pairs: DataFrame, belongs: DataFrame) -> DataFrame:
    """``(rec1, rec2)``, ``rec1 < rec2``: every pair of records whose sets are equal or similar."""
    x = belongs.select(F.col("rec").alias("x"), F.col("cls").alias("cls1"))
    y = belongs.select(F.col("rec").alias("y"), F.col("cls").alias("cls2"))
    across = pairs.join(x, "cls1").join(y, "cls2").select("x", "y")
    within = x.join(y, F.col("cls1") == F.col("cls2")).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("rec1"), F.greatest("x", "y").alias("rec2"))


def link_counts(pairs: DataFrame, belongs: DataFrame) -> DataFrame:
    """``(rec, cls, links)``: each record with its class and the number of other records that are equal or similar.

    Counts come from class sizes; no pair of records is made.
    """
    sizes = belongs.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.inline(F.array(F.struct(F.col("cls1").alias("cls"), F.col("cls2").alias("other")), F.struct(F.col("cls2").alias("cls"), F.col("cls1").alias("other")))))
    near = sides.join(sizes.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.sum("n").alias("near"))
    per = sizes.join(near, "cls", "left").select("cls", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return belongs.join(per, "cls").select("rec", "cls", "links")
