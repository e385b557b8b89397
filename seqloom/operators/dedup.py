"""Duplicates, outliers and set differences of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(records: DataFrame, key: str, *order) -> DataFrame:
    """The first record of each key, in a stated total order."""
    w = Window.partitionBy(key).orderBy(*order)
    return records.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def numbered(records: DataFrame, key: str, *order) -> DataFrame:
    """Adds ``unique_id``: the key with its occurrence number, ``id_1``, ``id_2``, ...

    Rows are numbered in order of key over range partitions, less the number of the key's first row: a key
    with a third of all rows is spread like the others.
    """
    rows = with_row_number(records, "__n", key, *order)
    first = rows.groupBy(key).agg(F.min("__n").alias("__first"))
    out = rows.join(first.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    n = (F.col("__n") - F.col("__first") + 1).cast("string")
    return out.withColumn("unique_id", F.concat_ws("_", F.col(key).cast("string"), n)).drop("__n", "__first")


def greedy_either(records: DataFrame, id_: str, seq: str, order: str) -> DataFrame:
    """Records in order, without those whose id or sequence an earlier *kept* record has.

    The rule looks at kept records only, so it follows chains of shared ids and sequences; records with no
    shared key are kept without a look.  A chain is one group: it is linked by components, and decided in its
    own task.
    """
    from seqloom.operators.graphs import components

    base = records.select(F.col(order).alias("o"), F.col(id_).alias("i"), F.col(seq).alias("s"))
    links = []
    for key in ("i", "s"):
        w = Window.partitionBy(key)
        first = F.min("o").over(w)
        links.append(base.where(F.col(key).isNotNull()).select(F.col("o").cast("string").alias("seq1"), first.cast("string").alias("seq2")))
    groups = components(links[0].unionByName(links[1]))
    chained = base.join(groups.select(F.col("member").cast(records.schema[order].dataType).alias("o"), "grp"), "o")

    def keep(pdf):
        seen_i, seen_s, kept = set(), set(), []
        for o, i, s in pdf.sort_values("o")[["o", "i", "s"]].itertuples(index=False):
            if i in seen_i or s in seen_s:
                continue
            seen_i.add(i)
            seen_s.add(s)
            kept.append(o)
        import pandas as pd

        return pd.DataFrame({"o": kept})

    kind = records.schema[order].dataType.simpleString()
    kept = chained.groupBy("grp").applyInPandas(keep, f"o {kind}").unionByName(base.join(chained.select("o"), "o", "left_anti").select("o"))
    return records.join(kept.select(F.col("o").alias(order)), order, "left_semi")


def within_deviation(records: DataFrame, value: Column) -> DataFrame:
    """Records strictly inside the mean and one sample standard deviation of a value."""
    limits = records.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    inside = (value > F.col("__m") - F.col("__s")) & (value < F.col("__m") + F.col("__s"))
    return records.crossJoin(F.broadcast(limits)).where(inside).drop("__m", "__s")


def long_branches(nodes: DataFrame, length: str) -> DataFrame:
    """Nodes whose branch is longer than the mean and one sample standard deviation."""
    limit = nodes.agg((F.avg(length) + F.stddev_samp(length)).alias("__limit"))
    return nodes.crossJoin(F.broadcast(limit)).where(F.col(length) > F.col("__limit")).drop("__limit")


def largest(records: DataFrame, group: str, size: Column, *order) -> DataFrame:
    """The record of the largest size in each group; ties: the first in a stated order."""
    w = Window.partitionBy(group).orderBy(size.desc(), *order)
    return records.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def without_listed(records: DataFrame, listed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(records without the listed ids, listed ids that no record has)."""
    return records.join(listed.select(key).distinct(), key, "left_anti"), listed.select(key).distinct().join(records.select(key), key, "left_anti")


def chunks(records: DataFrame, n: int, *order) -> DataFrame:
    """Adds ``chunk`` 1..n of nearly equal size, larger ones first, in a stated order; numbered over range partitions."""
    numbered_, total = with_row_number(records, "__n", *order), records.count()
    size, large = divmod(total, n)
    at = F.col("__n") - 1
    first = F.floor(at / F.lit(size + 1))
    rest = F.lit(large) + F.floor((at - F.lit(large * (size + 1))) / F.lit(max(size, 1)))
    return numbered_.withColumn("chunk", (F.when(at < large * (size + 1), first).otherwise(rest) + 1).cast("int")).drop("__n")


def by_load(records: DataFrame, n: int, size: Column, *order) -> DataFrame:
    """Adds ``share`` 0..n-1: records by size, largest first, are dealt out in turn, there and back."""
    dealt = with_row_number(records.withColumn("__size", size), "__n", F.desc("__size"), *order)
    k = (F.col("__n") - 1) % (2 * n)
    return dealt.withColumn("share", F.when(k < n, k).otherwise(2 * n - 1 - k).cast("int")).drop("__n", "__size")


def selected(records: DataFrame, c: Column, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(records whose text matches a pattern, the others); a null text matches nothing."""
    hit = F.coalesce(c.rlike(pattern), F.lit(False))
    return records.where(hit), records.where(~hit)


def unique_names(records: DataFrame, name: str) -> DataFrame:
    """The records; a name that comes twice is an error when its row is read."""
    n = records.groupBy(F.col(name).alias("__name")).agg(F.count(F.lit(1)).alias("__k"))
    checked = F.when(F.col("__k") == 1, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("repeated name "), F.col(name))))
    return records.join(n, F.col(name) == F.col("__name")).withColumn(name, checked).drop("__name", "__k")


def greedy_unlike(records: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """Records in order, without those that are alike (``pairs`` of their orders, ``(a, b)``) to an earlier *kept* one.

    Decided in rounds over the pairs: a record whose earlier likes are all dropped is kept, one with a kept earlier
    like is dropped.  Every round decides at least the first open record of each chain of likes.
    """
    from seqloom.plans.stages import Stages

    stages = Stages(records.sparkSession, "greedy")
    likes = stages.cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "likes")
    gone, open_ = None, likes
    for _ in range(10_000):
        open_, n = stages.cut_counted(open_, "open")
        if not n:
            break
        kept = open_.select(F.col("a").alias("x")).distinct().join(open_.select(F.col("b").alias("x")), "x", "left_anti")
        now = stages.cut(open_.join(kept.withColumnRenamed("x", "a"), "a", "left_semi").select("b").distinct(), "gone")
        gone = now if gone is None else gone.unionByName(now)
        open_ = open_.join(now, "b", "left_anti").join(now.withColumnRenamed("b", "a"), "a", "left_anti").join(kept.withColumnRenamed("x", "a"), "a", "left_anti")
    else:
        raise RuntimeError("likes are still open")
    return records if gone is None else records.join(gone.withColumnRenamed("b", order), order, "left_anti")


def skip_groups(rows: DataFrame, order: str, hits: str) -> DataFrame:
    """``(order, grp)``: rows in order begin a group and skip as many of the next rows as they have hits.

    A row's group is known when the rows before it are, so one task goes through the order; ``(order, hits)`` is
    all that it holds.  ``grp`` is the order of the row that began it.
    """

    def run(pdf):
        pdf = pdf.sort_values("o", ignore_index=True)
        groups, left, now = [], 0, None
        for o, h in zip(pdf["o"], pdf["h"]):
            if left:
                left -= 1
            else:
                now, left = o, int(h)
            groups.append(now)
        return pdf.assign(grp=groups)[["o", "grp"]]

    kind = rows.schema[order].dataType.simpleString()
    out = rows.select(F.col(order).alias("o"), F.col(hits).cast("long").alias("h")).groupBy().applyInPandas(run, f"o {kind}, grp {kind}")
    return out.select(F.col("o").alias(order), "grp")


def first_match_groups(lists: DataFrame, order: str, members: str) -> DataFrame:
    """``(grp, member)``: lists in order join the first group that holds their first known member, else begin one; not transitive.

    Lists that share no member, directly or over others, never meet, so each connected part is decided in its own
    task.  ``grp`` is the order of the list that began the group.
    """
    from seqloom.operators.graphs import components

    flat = lists.select(F.col(order).cast("string").alias("o"), F.explode(members).alias("m")).select(F.concat(F.lit("l:"), "o").alias("seq1"), F.concat(F.lit("m:"), F.col("m").cast("string")).alias("seq2"))
    parts = components(flat).where("member like 'l:%'").select(F.expr("substr(member, 3)").alias("__o"), "grp")
    kind, item = lists.schema[order].dataType.simpleString(), lists.schema[members].dataType.elementType.simpleString()

    def run(pdf):
        import pandas as pd

        groups: list[tuple] = []
        first: dict = {}  # of every member the first group that holds it
        for o, ms in pdf.sort_values("o")[["o", "ms"]].itertuples(index=False):
            found = next((first[m] for m in ms if m in first), None)
            if found is None:
                found = len(groups)
                groups.append((o, {}))
            groups[found][1].update(dict.fromkeys(ms))
            for m in ms:
                first[m] = min(found, first.get(m, found))
        return pd.DataFrame([(o, m) for o, g in groups for m in g], columns=["grp", "member"])

    rows = lists.select(F.col(order).alias("o"), F.col(members).alias("ms"), F.col(order).cast("string").alias("__o")).join(parts, "__o")
    return rows.groupBy("grp").applyInPandas(run, f"grp {kind}, member {item}")


def fixed_batches(records: DataFrame, size: int, *order) -> DataFrame:
    """Adds ``batch`` from 0, of ``size`` records each in a stated order, without gathering all rows in one task.

    Rows are range-partitioned and numbered by place in their partition and the rows before it.
    """
    return with_row_number(records, "__n", *order).withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("bigint")).drop("__n")


def with_row_number(records: DataFrame, name: str, *order) -> DataFrame:
    """Adds the row's number in a stated total order, from 1: places in range partitions plus the offsets before them."""
    from seqloom.plans.stages import Stages

    spark = records.sparkSession
    stages = Stages(spark, "numbers")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = records.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ranged = stages.cut(ranged.sortWithinPartitions(*order), "ranged")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))  # a row for each partition
    offsets = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn(name, inner).join(F.broadcast(offsets), "__part").withColumn(name, (F.col(name) + F.col("__before")).cast("bigint")).drop("__part", "__before")
