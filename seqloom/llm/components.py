"""Consolidating pairwise matches into groups: connected components by randomised contraction.

In each round every vertex hooks to the neighbour (or itself) that comes first in a fresh pseudo-random
order, edges are relabelled by these hooks and deduplicated, and the next round works on the smaller
graph.  When no edge is left, the rounds' mappings are expanded from the last to the first.  The number
of rounds is logarithmic for any graph, long chains included, as the order is fresh in each round.

The label of a vertex is its place in the order itself (a bijection of 64-bit keys), so hooking is a
``min`` over longs, which combines before the shuffle; a vertex with a third of all edges is no burden.
Joins that relabel edges are split by AQE where a vertex is hot.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.graph_keys import key, relabelled, vertex_keys
from seqloom.plans.stages import Stages

MAX_ROUNDS = 200


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", seed: int = 7) -> DataFrame:
    """``(id, group_id)``: each vertex that an edge links with another one, with the smallest id of its group.

    * Edges that miss an end, or join a vertex with itself, link nothing and are left out.
    * Repeated edges and both directions mean the same.  Other columns are ignored, whatever their names.
    * No usable edge: an empty table.
    """
    spark = edges.sparkSession
    stages = Stages(spark, "components")
    links = edges.select(F.col(src).cast("string").alias("a"), F.col(dst).cast("string").alias("b")).where("a <> b")
    vertices, hashed, _ = vertex_keys(links, "a", "b", stages)
    u, v = key(F.col("a"), hashed), key(F.col("b"), hashed)
    graph, n_edges = stages.cut_counted(
        links.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "edges"
    )
    draw = random.Random(seed)
    hooks: list[DataFrame] = []
    while n_edges:
        if len(hooks) == MAX_ROUNDS:
            raise RuntimeError("contraction did not end")
        hook, graph, n_edges = _contract(graph, draw.getrandbits(63), stages)
        hooks.append(hook)
        if len(hooks) % 4 == 0:
            stages.release()
    return _named(vertices, hooks, stages)


def _contract(graph: DataFrame, salt: int, stages: Stages) -> tuple[DataFrame, DataFrame, int]:
    """The hooks ``(v, label)`` of this round, the contracted edges and their number."""
    both = graph.select(F.explode(F.array(F.struct("u", F.col("v").alias("w")), F.struct(F.col("v").alias("u"), F.col("u").alias("w")))).alias("e"))
    hook = stages.cut(
        both.groupBy(F.col("e.u").alias("v"))
        .agg(F.min(relabelled(F.col("e.w"), salt)).alias("label"))
        .select("v", F.least("label", relabelled(F.col("v"), salt)).alias("label")),
        "hooks",
    )
    at_u = hook.select(F.col("v").alias("u"), F.col("label").alias("lu"))
    at_v = hook.select("v", F.col("label").alias("lv"))
    smaller, n = stages.cut_counted(
        graph.join(at_u, "u")
        .join(at_v, "v")
        .where("lu <> lv")
        .select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v"))
        .distinct(),
        "edges",
    )
    stages.drop(graph)
    return hook, smaller, n


def _named(vertices: DataFrame, hooks: list[DataFrame], stages: Stages) -> DataFrame:
    """Expand the mappings backwards, then name each group by its smallest id.

    A root is ``(round, label)``: labels of different rounds are drawn from different orders.
    """
    roots = None
    for k in reversed(range(len(hooks))):
        here = hooks[k]
        if roots is None:
            roots = here.select("v", F.lit(k).alias("at"), F.col("label").alias("root"))
            continue
        deeper = roots.select(F.col("v").alias("label"), F.col("at").alias("at_2"), F.col("root").alias("root_2"))
        roots = here.join(deeper, "label", "left").select(
            "v", F.coalesce("at_2", F.lit(k)).alias("at"), F.coalesce("root_2", "label").alias("root")
        )
    if roots is None:
        return vertices.select("id", F.col("id").alias("group_id"))
    members = stages.cut(vertices.join(roots, vertices["key"] == roots["v"]).select("id", "at", "root"), "members")
    stages.drop(vertices, *hooks)
    names = members.groupBy("at", "root").agg(F.min("id").alias("group_id"))
    return members.join(names, ["at", "root"]).select("id", "group_id")
