"""Rooted trees and lineages as node tables ``(node, parent, ...)``; a root has no parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.plans.stages import Stages

MAX_DEPTH = 64


def ancestors(nodes: DataFrame, node: str, parent: str, with_self: bool = True) -> DataFrame:
    """``(node, ancestor, steps)`` by doubling: each round joins paths with paths, so depth d takes log d joins."""
    stages = Stages(nodes.sparkSession, "ancestors")
    own = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    paths = own.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    paths, n = stages.cut_counted(paths, "paths")
    reach = 1
    for _ in range(MAX_DEPTH):
        longest = paths.where(F.col("steps") == reach).select("node", F.col("ancestor").alias("via"))
        more = longest.join(paths.select(F.col("node").alias("via"), "ancestor", F.col("steps").alias("s")), "via").select("node", "ancestor", (F.col("s") + reach).alias("steps"))
        more, n = stages.cut_counted(more, "more")
        if not n:
            break
        paths = stages.cut(paths.unionByName(more), "paths")
        reach *= 2
    out = paths
    if with_self:
        out = own.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")).unionByName(paths)
    return out


def depths(nodes: DataFrame, node: str, parent: str, length: str) -> DataFrame:
    """``(node, depth, distance)``: steps to the root, and the sum of branch lengths on the way; missing lengths count 0.

    Every node carries a pointer upward with the steps and the length to it; a round replaces it by the pointer's
    own, so there are n rows a round and log d rounds.
    """
    stages = Stages(nodes.sparkSession, "depths")
    up, kind = F.col(parent), nodes.schema[length].dataType.typeName()
    own = F.coalesce(F.col(length), F.lit(0)).cast("bigint" if kind in ("byte", "short", "integer", "long") else "double")
    # a pointer to null is at the root
    state = nodes.select(F.col(node).alias("node"), up.alias("up"), F.when(up.isNotNull(), 1).otherwise(0).alias("depth"), F.when(up.isNotNull(), own).otherwise(0).alias("distance"))
    state, n = stages.cut_counted(state, "state", F.col("up").isNotNull())
    for _ in range(MAX_DEPTH):
        if not n:
            return state.select("node", "depth", "distance")
        far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("distance").alias("s2"))
        moved = state.join(far, "up", "left").select("node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.col("distance") + F.coalesce("s2", F.lit(0))).alias("distance"))
        old = state
        state, n = stages.cut_counted(moved, "state", F.col("up").isNotNull())
        stages.drop(old)
    raise RuntimeError("the table has a cycle")


def leaf_counts(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """``(node, leaves)``: how many leaves lie at or below each node."""
    inner = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("node")).distinct()
    leaves = nodes.select(F.col(node).alias("node")).join(inner, "node", "left_anti")
    return ancestors(nodes, node, parent).join(leaves, "node", "left_semi").groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("leaves"))


def lowest_common_ancestor(nodes: DataFrame, node: str, parent: str, members: DataFrame, group: str) -> DataFrame:
    """``(group, ancestor)``: of every group of nodes the common ancestor nearest to them; no row without one."""
    up = ancestors(nodes, node, parent)
    sizes = members.select(group, F.col(node).alias("node")).distinct()
    want = sizes.groupBy(group).agg(F.count(F.lit(1)).alias("want"))
    shared = sizes.join(up, "node").groupBy(group, "ancestor").agg(F.count(F.lit(1)).alias("got"), F.min("steps").alias("near"))
    common = shared.join(want, group).where("got = want")
    return common.groupBy(group).agg(F.min(F.struct("near", "ancestor")).alias("m")).select(group, F.col("m.ancestor").alias("ancestor"))


def collapsed(nodes: DataFrame, long: DataFrame, node: str, parent: str) -> DataFrame:
    """The tree without the listed nodes; their children hang on the nearest node above that stays.

    Pointers that lead to a listed node are replaced by that node's own, so a chain of them is halved every round.
    """
    stages = Stages(nodes.sparkSession, "collapsed")
    gone = long.select(F.col(node).alias("node"), F.lit(True).alias("gone"))
    state = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    for _ in range(MAX_DEPTH):
        far = state.join(gone, "node").select(F.col("node").alias("up"), F.col("up").alias("up2"), "gone")
        moved = state.join(far, "up", "left").select("node", F.when(F.col("gone"), F.col("up2")).otherwise(F.col("up")).alias("up"), F.coalesce("gone", F.lit(False)).alias("moved"))
        state, n = stages.cut_counted(moved, "state", F.col("moved"))
        state = state.drop("moved")
        if not n:
            stay = nodes.join(long.select(node), node, "left_anti").drop(parent)
            return stay.join(state.select(F.col("node").alias(node), F.col("up").alias(parent)), node).select(nodes.columns)
    raise RuntimeError("the table has a cycle")


def way_up(nodes: DataFrame, node: str, parent: str, start) -> DataFrame:
    """``(on, steps)``: a node and those above it.  Each round takes twice as many steps at once, over n pointers."""
    stages = Stages(nodes.sparkSession, "way")
    jump = stages.cut(nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("on"), F.col(parent).alias("to")), "jump")
    way, reach = nodes.where(F.col(node) == F.lit(start)).select(F.col(node).alias("on"), F.lit(0).alias("steps")), 1
    for _ in range(MAX_DEPTH):
        more, n = stages.cut_counted(way.join(jump, "on").select(F.col("to").alias("on"), (F.col("steps") + reach).alias("steps")), "more")
        if not n:
            return way
        way = stages.cut(way.unionByName(more), "way")
        far = jump.select(F.col("on").alias("to"), F.col("to").alias("to2"))
        old = jump
        jump = stages.cut(jump.join(far, "to").select("on", F.col("to2").alias("to")), "jump")
        stages.drop(old)
        reach *= 2
    raise RuntimeError("the table has a cycle")


def rerooted(nodes: DataFrame, node: str, parent: str, length: str, root) -> DataFrame:
    """``(node, parent, length)`` with the tree hung from another node: the branches on its way up are turned."""
    up = way_up(nodes, node, parent, root)
    own = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(length).alias("length"))
    below = up.select((F.col("steps") + 1).alias("steps"), F.col("on").alias("next"))
    way = up.join(below, "steps", "left").join(own.select(F.col("node").alias("next"), F.col("length").alias("turned")), "next", "left")
    turned = way.select(F.col("on").alias("node"), F.col("next").alias("new_parent"), "turned", F.lit(True).alias("on_way"))
    out = own.join(turned, "node", "left")
    return out.select("node", F.when(F.col("on_way"), F.col("new_parent")).otherwise(F.col("parent")).alias("parent"), F.when(F.col("on_way"), F.col("turned")).otherwise(F.col("length")).alias("length"))


def newick(nodes: DataFrame, tree: str, node: str, parent: str, label: str, length: str) -> DataFrame:
    """``(tree, newick)``: one text for each tree, children in the order of their labels; a tree is one task's work."""

    def build(pdf):
        import pandas as pd

        children: dict = {}
        info = {}
        roots = []
        for n, p, name, size in zip(pdf[node], pdf[parent], pdf[label], pdf[length]):
            info[n] = ("" if pd.isna(name) else name, size)
            if pd.isna(p):
                roots.append(n)
            else:
                children.setdefault(p, []).append(n)
        done: dict = {}
        stack = [(r, False) for r in roots]
        while stack:
            n, ready = stack.pop()
            if not ready:
                stack.append((n, True))
                stack.extend((c, False) for c in children.get(n, []))
                continue
            kids = sorted(children.get(n, []), key=lambda c: (info[c][0], c))
            inner = "(" + ",".join(done.pop(c) for c in kids) + ")" if kids else ""
            name, size = info[n]
            done[n] = inner + name + ("" if pd.isna(size) else f":{float(size):g}")
        return pd.DataFrame({tree: [pdf[tree].iloc[0]], "newick": ["".join(done[r] for r in roots) + ";"]})

    kind = nodes.schema[tree].dataType.simpleString()
    return nodes.select(tree, node, parent, label, length).groupBy(tree).applyInPandas(build, f"{tree} {kind}, newick string")


def common_ancestor_of_all(lineage: DataFrame, generation: str, node: str, parent: str) -> DataFrame:
    """One row ``(generation, ancestor)``: the latest generation with one ancestor of everything in the last one; none without it.

    ``lineage`` has a row for each record of a generation, naming its parent in the generation before.
    """
    last = lineage.agg(F.max(generation).alias("g"))
    up = ancestors(lineage, node, parent)
    ends = lineage.join(F.broadcast(last), F.col(generation) == F.col("g")).select(F.col(node).alias("node"))
    found = up.join(ends, "node", "left_semi").groupBy("steps").agg(F.count_distinct("ancestor").alias("n"), F.min("ancestor").alias("ancestor"), F.count(F.lit(1)).alias("rows"))
    total = ends.agg(F.count_distinct("node").alias("all"))
    one = found.crossJoin(F.broadcast(total)).where((F.col("n") == 1) & (F.col("rows") == F.col("all")))
    return one.agg(F.min(F.struct("steps", "ancestor")).alias("m")).where("m is not null").crossJoin(F.broadcast(last)).select((F.col("g") - F.col("m.steps")).alias("generation"), F.col("m.ancestor").alias("ancestor"))


def internal_root(nodes: DataFrame, tree: str, name: str) -> DataFrame:
    """Of every tree the reconstructed record of the highest-numbered inner node, named ``#n#``."""
    number = F.regexp_extract(F.col(name), "^#([0-9]+)#$", 1)
    inner = nodes.withColumn("__n", F.when(number != "", number).cast("int")).where("__n is not null")
    top = inner.groupBy(tree).agg(F.max("__n").alias("__n"))
    return inner.join(top, [tree, "__n"]).drop("__n")


def lineage_of(records: DataFrame, description: Column) -> DataFrame:
    """Adds ``parent`` of a simulated record, from ``parent <id>`` in its description."""
    found = F.regexp_extract(description, r"\bparent (\S+)", 1)
    return records.withColumn("parent", F.when(found != "", found))
