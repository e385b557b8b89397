"""Ortholog grouping: recursive subdivision by Markov clustering, cliques, and small groups merged into large ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.ids import taxon
from seqloom.operators import groups as gr
from seqloom.operators.graphs import best_hit_closure, markov_grid
from seqloom.operators.hits import both_directions
from seqloom.operators.statistics import kde_overlap, tukey_of_cells
from seqloom.plans.stages import Stages


@dataclass(frozen=True)
class Setting:
    """One sampled clustering: inflation and edge threshold."""

    inflation: float
    threshold: float


def _within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges inside each group, ids marked with the group so that all groups are clustered at once."""
    a = members.select(F.col("member").alias("seq1"), F.col("grp").alias("g1"))
    b = members.select(F.col("member").alias("seq2"), F.col("grp").alias("g2"))
    inner = edges.join(a, "seq1").join(b, "seq2").where("g1 = g2")
    return inner.select("g1", "seq1", "seq2", "score")


#: Levels of a subdivision; each has smaller groups than the one before, so this is never met in earnest.
MAX_LEVELS = 200


def _summed(level: DataFrame, separator: str) -> DataFrame:
    """``(grp, score)``: product scores; a group of one taxon, which has none, counts as if its members were copies."""
    tagged = level.withColumn("taxon", taxon(F.col("member"), separator))
    sizes = tagged.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return gr.product_scores(tagged).join(sizes, "grp").select("grp", F.coalesce("score", 1.0 - F.col("n")).alias("score"))


def subdivided(edges: DataFrame, members: DataFrame, settings: list[Setting], least: int = 3, separator: str = "-") -> DataFrame:
    """``(grp, member)``: groups split as long as the best sampled clustering scores more than the group itself.

    ``members`` ``(grp, member)`` are the groups to begin with; without ``grp`` they are one, ``group_0``.  A level
    clusters all open groups together, each by its own edges, under all settings at once; for every group the setting
    of the highest summed score is taken if it divides the group and beats its own score.  Groups below ``least``
    members, and groups that no setting improves, are final; the search ends when none is open.  Names extend the
    parent's: ``group_0_1``.
    """
    stages = Stages(edges.sparkSession, "subdivision")
    level = stages.cut(members.select("grp" if "grp" in members.columns else F.lit("group_0").alias("grp"), "member").distinct(), "level")
    inner = edges.where(F.col("score") >= min(s.threshold for s in settings))
    final = None
    for _ in range(MAX_LEVELS):
        sizes = level.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
        own = stages.cut(_summed(level, separator).join(sizes, "grp").where(F.col("size") >= least).select("grp", F.col("score").alias("own")), "own")
        open_ = level.join(own.select("grp"), "grp", "left_semi")
        # a part's edges are among its parent's
        inner = stages.cut(_within(inner.select("seq1", "seq2", "score"), open_), "inner")
        found = stages.cut(markov_grid(inner, [(s.inflation, s.threshold) for s in settings], block="g1").withColumnRenamed("grp", "part"), "found")
        every = open_.crossJoin(F.broadcast(edges.sparkSession.range(len(settings)).select(F.col("id").cast("int").alias("k"))))
        tried = stages.cut(every.join(found, ["k", "member"], "left").select("k", "grp", F.coalesce("part", "member").alias("part"), "member"), "tried")
        mark = F.concat_ws("\x1f", F.col("k").cast("string"), "grp", "part")
        scores = _summed(tried.select(mark.alias("grp"), "member"), separator)
        per = scores.groupBy(F.split("grp", "\x1f")[0].cast("int").alias("k"), F.split("grp", "\x1f")[1].alias("grp")).agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("parts"))
        # a setting that leaves a group whole has its score, but for rounding
        best = per.where("parts > 1").groupBy("grp").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b")).select("grp", (-F.col("b.k")).alias("k"), F.col("b.score").alias("score"))
        better, n = stages.cut_counted(best.join(own, "grp").where(F.col("score") > F.col("own") + 1e-9).select("grp", "k"), "better")
        rest = level.join(better.select("grp"), "grp", "left_anti")
        final = rest if final is None else final.unionByName(rest)
        if not n:
            return final
        parts = tried.join(better, ["grp", "k"]).select("grp", "part", "member")
        new = gr.named(parts.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n")), "grp", [F.desc("n"), "part"])
        level = stages.cut(parts.join(new.select("grp", "part", "name"), ["grp", "part"]).select(F.col("name").alias("grp"), "member"), "level")
    raise RuntimeError(f"groups are still open after {MAX_LEVELS} levels")


def significant_cliques(edges: DataFrame, members: DataFrame, least: int = 3, below: float = 0.05) -> DataFrame:
    """``(grp, clique, member)``: groups of best hits within a group whose inner scores hardly overlap the others'.

    Candidates have at least ``least`` members and are not the whole group.  Scores without spread are moved by a
    ten-millionth of their value, up and down by turns, so that they have a density.
    """
    inner = _within(edges, members)
    closure = best_hit_closure(inner.select("seq1", "seq2", "score")).withColumnRenamed("grp", "clique")
    of = closure.join(members.select("member", "grp"), "member")
    sizes = of.groupBy("grp", "clique").agg(F.count(F.lit(1)).alias("n")).join(members.groupBy("grp").agg(F.count(F.lit(1)).alias("all")), "grp")
    open_ = of.join(sizes.where((F.col("n") >= least) & (F.col("n") < F.col("all"))).select("grp", "clique"), ["grp", "clique"], "left_semi")
    side = lambda i: open_.select(F.col("member").alias(f"seq{i}"), F.col("clique").alias(f"c{i}"))
    scored = inner.join(side(1), "seq1", "left").join(side(2), "seq2", "left")
    inside = scored.where("c1 = c2").select(F.col("c1").alias("clique"), "score")
    touching = scored.where("c1 is not null or c2 is not null").where("not (c1 <=> c2)").select(F.explode(F.array_compact(F.array("c1", "c2"))).alias("clique"), "score")
    inside, touching = _perturbed(inside, "clique", "score"), _perturbed(touching, "clique", "score")
    test = kde_overlap(inside, touching, "clique", "score", below).where("apart")
    return open_.join(test.select("clique"), "clique", "left_semi").select("grp", "clique", "member")


def _perturbed(values: DataFrame, group: str, value: str) -> DataFrame:
    flat = values.groupBy(group).agg((F.min(value) == F.max(value)).alias("__flat"))
    sign = F.when(F.row_number().over(Window.partitionBy(group).orderBy(value)) % 2 == 0, 1.0).otherwise(-1.0)
    moved = values.join(flat.where("__flat").select(group), group, "left_semi").withColumn(value, F.col(value) * (1 + sign * 1e-7))
    return values.join(flat.where("__flat").select(group), group, "left_anti").unionByName(moved)


def merged_small(members: DataFrame, edges: DataFrame, large_from: int = 3, alpha: float = 0.05) -> DataFrame:
    """``(grp, member)``: groups below ``large_from`` members join the large group of the highest mean score to them,
    if that differs from every other large group's that an edge links with them (Tukey); pairs without an edge score 0.

    Those pairs are never made: how many there are follows from the sizes of both groups, and their zeros enter number,
    mean and variance.  So the work grows with the edges and not with the product of the sizes.
    """
    sized = members.join(members.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "grp")
    small = sized.where(F.col("size") < large_from).select(F.col("grp").alias("small"), F.col("member").alias("a"), F.col("size").alias("size1"))
    large = sized.where(F.col("size") >= large_from).select(F.col("grp").alias("large"), F.col("member").alias("b"), F.col("size").alias("size2"))
    # only groups that an edge links with the small one can win
    sides = both_directions(edges, "seq1", "seq2", "score").withColumn("score", F.coalesce("score", F.lit(0.0)))
    linked = small.join(sides, "a").join(large, "b").groupBy("small", "large").agg(
        F.count(F.lit(1)).alias("n1"), F.sum("score").alias("sum"), F.avg("score").alias("m1"), F.var_pop("score").alias("v1"),
        (F.max("size1") * F.max("size2") - F.count_distinct("a", "b")).alias("n0"),
    )
    n = F.col("n1") + F.col("n0")
    variance = (F.col("n1") * F.col("v1") + F.col("m1") * F.col("m1") * F.col("n1") * F.col("n0") / n) / n
    cells = Stages(members.sparkSession, "merge").cut(linked.select("small", "large", n.alias("n"), (F.col("sum") / n).alias("m"), variance.alias("v")), "cells")
    top = cells.groupBy("small").agg(F.max(F.struct("m", "large")).alias("t"), F.count(F.lit(1)).alias("k")).select("small", F.col("t.large").alias("top"), "k")
    test = tukey_of_cells(cells, "small", "large", alpha, top)
    apart = test.groupBy("small").agg(F.min(F.col("differs").cast("int")).alias("all_differ"))
    moves = top.join(apart, "small", "left").where("k = 1 or all_differ = 1").select(F.col("small").alias("grp"), F.col("top"))
    return members.join(moves, "grp", "left").select(F.coalesce("top", "grp").alias("grp"), "member")


def scored_clustering(members: DataFrame, cliques: DataFrame, separator: str = "-") -> DataFrame:
    """One row ``score``: the product scores of the groups without their cliques, and of every clique, summed.

    Counts of the containing groups are those before cliques are taken out.
    """
    tag = lambda m: m.withColumn("taxon", taxon(F.col("member"), separator))
    whole = tag(members.select("grp", "member"))
    rest = tag(members.select("grp", "member").join(cliques.select("member"), "member", "left_anti").select("grp", "member"))
    of = cliques.select("grp", "clique").distinct()
    parents = of.join(whole, "grp").select(F.col("clique").alias("grp"), "member", "taxon")
    inner = tag(cliques.select(F.col("clique").alias("grp"), "member"))
    both = gr.product_scores(rest, whole).unionByName(gr.product_scores(inner, parents))
    return both.agg(F.sum("score").alias("score"))


def records_of(records: DataFrame, members: DataFrame, id_: str = "id") -> DataFrame:
    """The records of listed ids, by a semi-join (ids are no patterns)."""
    return records.join(members.select(F.col("member").alias(id_)), id_, "left_semi")
