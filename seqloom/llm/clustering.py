"""Grouping records into similarity clusters: parallel pivot correlation clustering.

Two records are tied when their similarity reaches the threshold.  One cycle:

1. *Pivots.*  In a fresh pseudo-random order every record looks for the first among itself and its
   neighbours.  A record that finds itself is a pivot; every other one joins the pivot it is closest to, by
   similarity, among its neighbours.
2. *Reassignment.*  A member need not be tied to its pivot, only to more than half of its cluster, so records
   then move to the cluster where they gain most under the correlation clustering objective: ties into the
   cluster less half of the cluster's other members; without a gain a record stands alone.
3. *Medoids.*  The member with the most ties to the others of its cluster becomes its pivot and names it.
   Both steps are repeated ``moves`` times.
4. *Settling.*  Whenever ties are counted, clusters that meet the conditions of the result are settled;
   ties between settled records are not looked at again.

Cycles repeat on what is left, with a fresh order; records with too few ties left for any cluster are
set aside between them.  After ``pivot_cycles`` of them small connected parts of what is left are searched
exhaustively (:mod:`~seqloom.llm.exact_clusters`), each in one task; a part that is too large for that goes
through more cycles.  They end when no tie between free records is left, so that no cluster can be missing, or
when ``patience`` of them settle nothing; then larger parts are searched, and one too large is an error.
Each step is one count of ties by record and cluster, over the remaining ties only; a record with a third of all
ties is counted with partial aggregates.  Medoids are computed from the similarities to the members.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.components import connected_components
from seqloom.llm.exact_clusters import MOST_STEPS, all_clusters
from seqloom.llm.graph_keys import key, relabelled, vertex_keys
from seqloom.plans.stages import Stages


#: The ties of a connected part that is searched exhaustively in one task, at the end of the cycles and between them.
MOST_TIES = 1_000_000
SMALL_TIES = 2_000
#: The steps of a search between cycles; a part that takes more goes through another cycle.
SMALL_STEPS = 20_000


@dataclass(frozen=True)
class Conditions:
    """What a settled cluster fulfils; ties are counted among the *other* members."""

    least_size: int = 5
    inside_above: float = 0.5
    outside_at_most: float = 0.25


def _tied(ties: DataFrame, *keep: str) -> DataFrame:
    """Both directions ``(v, w, *keep)`` of undirected ties, as far as ``w`` is not settled."""
    one = F.struct(F.col("u").alias("v"), F.col("v").alias("w"), F.col("sv").alias("settled"), *keep)
    two = F.struct(F.col("v").alias("v"), F.col("u").alias("w"), F.col("su").alias("settled"), *keep)
    return ties.select(F.inline(F.array(one, two))).where("not settled").select("v", "w", *keep)


def _pivots(ties: DataFrame, salt: int, stages: Stages) -> DataFrame:
    """``(v, label)`` of every record that has a free neighbour and is not settled; the label is its closest pivot, else itself."""
    free = ties.where("not su and not sv")
    first = (
        _tied(free)
        .groupBy("v")
        .agg(F.min(relabelled(F.col("w"), salt)).alias("best"))
        .select("v", (relabelled(F.col("v"), salt) < F.col("best")).alias("pivot"))
    )
    first = stages.cut(first, "first")
    pivots = first.where("pivot")
    near = (
        _tied(free, "score")
        .join(pivots.select(F.col("v").alias("w")), "w", "left_semi")
        .groupBy("v")
        .agg(F.max(F.struct("score", "w"))["w"].alias("near"))
    )
    # no two pivots are neighbours, so a pivot is near to none
    labels = stages.cut(first.join(near, "v", "left").select("v", F.coalesce("near", "v").alias("label")), "labels")
    stages.drop(first)
    return labels


def _step(ties: DataFrame, labels: DataFrame, c: Conditions, stages: Stages):
    """Count the ties of every record with the free members of each cluster; settle clusters, move records.

    The new labels ``(v, label, done)``, and how many records are done.
    """
    sized = labels.join(labels.groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("size")), "label")
    size, inside = F.col("size"), F.col("own").eqNullSafe(F.col("label"))
    gain = F.col("n") - (size - inside.cast("int")) / 2
    # where each record gains most; of equal gains more ties, then the larger label
    first = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("gain"), F.desc("n"), F.desc("label")))
    counts = stages.cut(
        _tied(ties)
        .join(sized.select(F.col("v").alias("w"), "label", "size"), "w")
        .groupBy("v", "label")
        .agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("size").alias("size"))
        .join(labels.select("v", F.col("label").alias("own")), "v", "left")
        .withColumn("gain", gain)
        .withColumn("best", (first == 1) & (F.col("gain") > 0) & F.col("own").isNotNull())
        .drop("gain"),
        "counts",
    )
    moves = counts.where("best").select("v", F.col("label").alias("next"))
    seen = counts.groupBy("label").agg(
        F.max("size").alias("size"), F.count(F.when(inside, 1)).alias("linked"), F.min(F.when(inside, F.col("n"))).alias("least"), F.max(F.when(~inside, F.col("n"))).alias("most")
    )
    good = stages.cut(
        seen.where(
            (size >= c.least_size)
            & (F.col("linked") == size)
            & (F.col("least") > c.inside_above * (size - 1))
            & (F.coalesce("most", F.lit(0)) <= c.outside_at_most * size)
        ).select("label"),
        "good",
    )
    mine = good.select("label", F.lit(True).alias("done"))
    taken = good.select(F.col("label").alias("next"), F.lit(True).alias("taken"))  # nobody else joins a settled cluster
    central = counts.where(inside).groupBy("label").agg(F.max(F.struct("n", "v"))["v"].alias("medoid"))
    moved = (
        labels.join(mine, "label", "left")
        .join(moves, "v", "left")
        .join(taken, "next", "left")
        .select(
            "v",
            F.when(F.col("done"), F.col("label")).when(F.col("taken") | F.col("next").isNull(), F.col("v")).otherwise(F.col("next")).alias("label"),
            F.coalesce("done", F.lit(False)).alias("done"),
        )
    )
    moved = moved.join(central, "label", "left").select("v", F.coalesce("medoid", "label").alias("label"), "done")
    moved, n_done = stages.cut_counted(moved, "labels", F.col("done"))
    stages.drop(counts)
    return moved, n_done


def _remaining(ties: DataFrame, done: DataFrame, stages: Stages) -> tuple[DataFrame, int]:
    """The ties with the newly settled records marked, less those between two settled records.

    With the number of ties between two free records.
    """
    mark = done.select("v", F.lit(True).alias("m"))
    marked = (
        ties.join(mark.select(F.col("v").alias("u"), F.col("m").alias("mu")), "u", "left")
        .join(mark.select("v", F.col("m").alias("mv")), "v", "left")
        .select("u", "v", "score", (F.col("su") | F.col("mu").isNotNull()).alias("su"), (F.col("sv") | F.col("mv").isNotNull()).alias("sv"))
        .where("not (su and sv)")
    )
    rest, n_free = stages.cut_counted(marked, "ties", ~F.col("su") & ~F.col("sv"))
    stages.drop(ties)
    return rest, n_free


def pivot_clusters(
    scores: DataFrame, a: str, b: str, score: str, threshold: float, conditions: Conditions = Conditions(), moves: int = 3, pivot_cycles: int = 2, patience: int = 3, max_cycles: int = 40, seed: int = 11
) -> DataFrame:
    """``(cluster_id, seq_id)``: the members of every settled cluster; ``cluster_id`` is the smallest one.

    * Of repeated rows and both directions of a pair the highest similarity counts.  Rows that miss an
      id, compare a record with itself or have a null or NaN score are left out.
    * Records in no settled cluster are left out.  Other columns are ignored.  Empty in, empty out.
    """
    stages = Stages(scores.sparkSession, "clusters")
    _, vertices, settled = _settled(scores, a, b, score, threshold, conditions, moves, pivot_cycles, patience, max_cycles, seed, stages)
    members = stages.cut(settled.join(vertices, settled["v"] == vertices["key"]).select("label", F.col("id").alias("seq_id")), "named")
    names = members.groupBy("label").agg(F.min("seq_id").alias("cluster_id"))
    return members.join(names, "label").select("cluster_id", "seq_id")


def described_clusters(
    scores: DataFrame, a: str, b: str, score: str, threshold: float, conditions: Conditions = Conditions(), moves: int = 3, pivot_cycles: int = 2, patience: int = 3, max_cycles: int = 40, seed: int = 11
) -> DataFrame:
    """As :func:`pivot_clusters`, with ``size``, ``typicality`` and ``place`` of each member.

    ``typicality`` is the sum of a member's similarities to the others over their number; ``place`` ranks
    it (1: the medoid), equal values by smaller id.
    """
    stages = Stages(scores.sparkSession, "clusters")
    keyed, vertices, settled = _settled(scores, a, b, score, threshold, conditions, moves, pivot_cycles, patience, max_cycles, seed, stages)
    return _described(keyed, vertices, settled, stages)


def _settled(scores, a, b, score, threshold, conditions, moves, pivot_cycles, patience, max_cycles, seed, stages: Stages):
    """The tied pairs by key, the vertices, and the settled records ``(v, label)``."""
    spark = scores.sparkSession
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    # a pair is tied when any of its rows is
    rows = scores.select(x.alias("a"), y.alias("b"), F.col(score).cast("double").alias("score")).where(
        (F.col("score") >= F.lit(threshold)) & ~F.isnan("score") & (F.col("a") != F.col("b"))
    )
    rows = stages.cut(rows, "rows")
    vertices, hashed, _ = vertex_keys(rows, "a", "b", stages)
    ka, kb = key(F.col("a"), hashed), key(F.col("b"), hashed)
    pairs = rows.select(F.least(ka, kb).alias("u"), F.greatest(ka, kb).alias("v"), "score").groupBy("u", "v").agg(F.max("score").alias("score"))
    keyed = stages.cut(pairs, "pairs")
    stages.drop(rows)
    ties = keyed.select("u", "v", F.col("score").cast("float").alias("score"), F.lit(False).alias("su"), F.lit(False).alias("sv"))
    # a label is unique within the step that settles it
    settled = spark.createDataFrame([], "v bigint, label struct<step: int, label: bigint>")
    draw, idle, n_free, steps = random.Random(seed), 0, None, 0
    least = math.floor(conditions.inside_above * (conditions.least_size - 1)) + 1
    for cycle in range(max_cycles):
        if cycle:
            ties, n_free = _retired(ties, least, stages)
            if n_free and cycle >= pivot_cycles:
                steps += 1
                got, ties, n_free = _search(ties, conditions, SMALL_TIES, SMALL_STEPS, stages)
                settled = settled.unionByName(got.where("label is not null").select("v", _label(steps)))
            if not n_free:
                break
        table, got = _pivots(ties, draw.getrandbits(63), stages), 0
        labels = table
        for _ in range(moves):
            old = table
            table, n = _step(ties, labels, conditions, stages)
            stages.drop(old)
            if n:
                got += n
                steps += 1
                done = stages.cut(table.where("done").select("v", _label(steps)), "settled")
                settled = settled.unionByName(done)
                ties, _ = _remaining(ties, done, stages)
            labels = table.where("not done").select("v", "label")
        stages.release()
        idle = 0 if got else idle + 1
        if idle == patience:
            break
    while n_free != 0:  # what no cycle settled: in parts of any size up to the bound
        before = n_free
        ties, n_free = _retired(ties, least, stages)
        if n_free and n_free == before:
            steps += 1
            got, ties, n_free = _search(ties, conditions, MOST_TIES, MOST_STEPS, stages)
            settled = settled.unionByName(got.where("label is not null").select("v", _label(steps)))
            if n_free:
                raise RuntimeError(f"{n_free} ties are left in parts too large to be searched for clusters, in one of more than {MOST_TIES} ties or {MOST_STEPS} steps")
    return keyed, vertices, stages.cut(settled, "members")


def _label(step: int) -> Column:
    return F.struct(F.lit(step).alias("step"), F.col("label")).alias("label")


def _search(ties: DataFrame, conditions: Conditions, most_ties: int, most_steps: int, stages: Stages) -> tuple[DataFrame, DataFrame, int]:
    """Searches the connected parts of at most ``most_ties`` ties for clusters.

    ``(v, label)`` of all free records of the parts that were searched to the end within ``most_steps``, the label
    null for records in no cluster; the ties that are left, and the number of those between free records.
    """
    parts = connected_components(ties.where("not su and not sv"), "u", "v")
    of = stages.cut(parts.select(F.col("id").cast("long").alias("free"), F.col("group_id").alias("part")), "parts")
    # both ends of a tie between free records are in one part; a marked end is an outsider of each part it touches
    free = F.when(F.col("su"), F.col("v")).otherwise(F.col("u"))
    rest = stages.cut(ties.withColumn("free", free).join(of, "free").select("part", "u", "v", "su", "sv"), "rest")
    fit = rest.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_ties)
    c = conditions

    def search(pdf):
        import pandas as pd

        rows = list(pdf[["u", "v", "su", "sv"]].itertuples(index=False, name=None))
        try:
            found = all_clusters(rows, c.least_size, c.inside_above, c.outside_at_most, most_steps)
        except RuntimeError:
            return pd.DataFrame({"v": [], "label": []}).astype({"v": "int64", "label": "Int64"})
        label = {v: m[0] for m in found for v in m}
        records = sorted({x for u, v, su, sv in rows for x, marked in ((u, su), (v, sv)) if not marked})
        return pd.DataFrame({"v": records, "label": pd.array([label.get(v) for v in records], dtype="Int64")})

    got = stages.cut(rest.join(fit.select("part"), "part", "left_semi").groupBy("part").applyInPandas(search, "v bigint, label bigint"), "searched")
    left, n_free = _remaining(ties, got, stages)
    return got, left, n_free


def _retired(ties: DataFrame, least: int, stages: Stages) -> tuple[DataFrame, int]:
    """Marks free records with fewer than ``least`` free neighbours: no cluster can hold them.

    They are marked as if settled, so they move no more and still count as outsiders of other clusters.
    With the number of ties between two records that stay free.
    """
    few = _tied(ties.where("not su and not sv")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    alone = _tied(ties).select("v", "w").select(F.col("w").alias("v")).distinct()  # free records, also without free neighbours
    free = _tied(ties.where("not su and not sv")).select("v").distinct()
    gone = stages.cut(few.select("v").unionByName(alone.join(free, "v", "left_anti")), "retired")
    rest, n_free = _remaining(ties, gone, stages)
    stages.drop(gone)
    return rest, n_free


def _described(keyed: DataFrame, vertices: DataFrame, settled: DataFrame, stages: Stages) -> DataFrame:
    """Name the clusters and rank their members; a settled cluster's label is unique to it."""
    mine = settled.select(F.col("v").alias("u"), "label"), settled.select("v", F.col("label").alias("label_v"))
    inside = keyed.join(mine[0], "u").join(mine[1], "v").where("label = label_v")
    sums = (
        inside.select(F.inline(F.array(F.struct(F.col("u").alias("v"), F.col("score")), F.struct(F.col("v"), F.col("score")))))
        .groupBy("v")
        .agg((F.sum(F.round(F.col("score") * 1e6).cast("long"))).alias("total"))
    )
    members = stages.cut(settled.join(sums, "v").join(vertices, settled["v"] == vertices["key"]).select("label", F.col("id").alias("seq_id"), "total"), "named")
    names = members.groupBy("label").agg(F.min("seq_id").alias("cluster_id"), F.count(F.lit(1)).cast("int").alias("size"))
    typical = F.round(F.col("total") / 1e6 / (F.col("size") - 1), 6)
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("typicality"), "seq_id"))
    return members.join(names, "label").select("cluster_id", "seq_id", "size", typical.alias("typicality")).withColumn("place", place)
