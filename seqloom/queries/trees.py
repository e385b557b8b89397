"""Rooted trees and lineages."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import dedup as dd
from seqloom.operators import trees as tr
from seqloom.queries.registry import query, table

_TREE = "t AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent, p_size AS length, p_name AS label FROM part)"
_UP = f"{_TREE}, u(node, ancestor, steps) AS (SELECT node, node, 0 FROM t UNION ALL SELECT u.node, t.parent, steps + 1 FROM u JOIN t ON t.node = u.ancestor WHERE t.parent IS NOT NULL)"


def tree(spark, sf_dir):
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("node"), F.when(p > 0, F.floor(p / 2)).cast("bigint").alias("parent"), F.col("p_size").alias("length"), F.col("p_name").alias("label")
    )


@query(f"WITH RECURSIVE {_UP} SELECT node, ancestor, CAST(steps AS INTEGER) AS steps FROM u")
def tree_ancestors(spark, sf_dir):
    return tr.ancestors(tree(spark, sf_dir), "node", "parent")


@query(f"WITH RECURSIVE {_UP} SELECT u.node, CAST(max(steps) AS INTEGER) AS depth, CAST(coalesce(sum(CASE WHEN t.parent IS NOT NULL THEN length END), 0) AS BIGINT) AS distance FROM u JOIN t ON t.node = u.ancestor GROUP BY 1")
def tree_depth(spark, sf_dir):
    return tr.depths(tree(spark, sf_dir), "node", "parent", "length")


@query(f"WITH RECURSIVE {_UP} SELECT ancestor AS node, count(*) AS leaves FROM u WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) GROUP BY 1")
def tree_leaf_count(spark, sf_dir):
    return tr.leaf_counts(tree(spark, sf_dir), "node", "parent")


@query(f"""WITH RECURSIVE {_UP}, m AS (SELECT p_brand AS brand, p_partkey AS node FROM part), s AS (SELECT brand, ancestor, count(*) AS got, min(steps) AS near FROM m JOIN u USING (node) GROUP BY 1, 2),
w AS (SELECT brand, count(*) AS want FROM m GROUP BY 1) SELECT brand, ancestor FROM s JOIN w USING (brand) WHERE got = want QUALIFY row_number() OVER (PARTITION BY brand ORDER BY near, ancestor) = 1""")
def tree_lca(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("node"))
    return tr.lowest_common_ancestor(tree(spark, sf_dir), "node", "parent", m, "brand")


@query("SELECT p_partkey AS node, p_size AS length FROM part WHERE p_size > (SELECT avg(p_size) + stddev_samp(p_size) FROM part)")
def tree_long_branches(spark, sf_dir):
    return dd.long_branches(tree(spark, sf_dir).select("node", "length"), "length")


@query(f"""WITH RECURSIVE {_UP}, long AS (SELECT node FROM t WHERE parent IS NOT NULL AND length > (SELECT avg(length) + stddev_samp(length) FROM t WHERE parent IS NOT NULL)),
n AS (SELECT u.node, ancestor FROM u WHERE steps > 0 AND ancestor NOT IN (SELECT node FROM long) QUALIFY row_number() OVER (PARTITION BY u.node ORDER BY steps) = 1)
SELECT t.node, n.ancestor AS parent, length FROM t LEFT JOIN n ON n.node = t.node WHERE t.node NOT IN (SELECT node FROM long)""")
def tree_collapsed(spark, sf_dir):
    t = tree(spark, sf_dir)
    long = dd.long_branches(t.where("parent is not null"), "length")
    return tr.collapsed(t.select("node", "parent", "length"), long, "node", "parent")


@query(f"""WITH RECURSIVE {_UP}, way AS (SELECT ancestor AS v, steps FROM u WHERE node = 37)
SELECT t.node, CASE WHEN w.v IS NOT NULL THEN x.v ELSE t.parent END AS parent, CASE WHEN w.v IS NOT NULL THEN y.length ELSE t.length END AS length
FROM t LEFT JOIN way w ON w.v = t.node LEFT JOIN way x ON x.steps = w.steps - 1 LEFT JOIN t y ON y.node = x.v""")
def tree_rerooted(spark, sf_dir):
    t = tree(spark, sf_dir)
    return tr.rerooted(t, "node", "parent", "length", 37)


@query("SELECT CAST(0 AS INTEGER) AS tree, count(*) AS nodes, CAST(sum(p_size) AS BIGINT) AS length FROM part")
def newick_text(spark, sf_dir):
    """The whole tree as one text: its nodes, by their lengths, and the sum of these."""
    t = tree(spark, sf_dir).withColumn("tree", F.lit(0))
    sizes = F.transform(F.regexp_extract_all("newick", F.lit(":([0-9]+)"), 1), lambda x: x.cast("bigint"))
    n = tr.newick(t, "tree", "node", "parent", "label", "length").select("tree", sizes.alias("s"))
    return n.select("tree", F.size("s").cast("bigint").alias("nodes"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("length"))


_LINEAGE = "t AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 0 THEN c_custkey // 3 END AS parent FROM customer)"


@query(f"""WITH RECURSIVE {_LINEAGE}, u(node, ancestor, steps) AS (SELECT node, node, 0 FROM t UNION ALL SELECT u.node, t.parent, steps + 1 FROM u JOIN t ON t.node = u.ancestor WHERE t.parent IS NOT NULL),
g AS (SELECT node, max(steps) AS generation FROM u GROUP BY 1), e AS (SELECT node FROM g WHERE generation = (SELECT max(generation) FROM g)),
f AS (SELECT steps, min(ancestor) AS ancestor FROM u WHERE node IN (SELECT node FROM e) GROUP BY 1 HAVING count(DISTINCT ancestor) = 1 AND count(*) = (SELECT count(*) FROM e))
SELECT CAST((SELECT max(generation) FROM g) - steps AS INTEGER) AS generation, ancestor FROM f QUALIFY row_number() OVER (ORDER BY steps) = 1""")
def common_ancestor(spark, sf_dir):
    """The latest common ancestor of everything in the last generation of a lineage."""
    c = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(c.alias("node"), F.when(c > 0, F.floor(c / 3)).cast("bigint").alias("parent"))
    generations = tr.ancestors(t, "node", "parent").groupBy("node").agg(F.max("steps").alias("generation"))
    return tr.common_ancestor_of_all(t.join(generations, "node"), "generation", "node", "parent")


@query(f"""WITH RECURSIVE {_LINEAGE}, u(node, steps, up) AS (SELECT node, 0, parent FROM t UNION ALL SELECT u.node, steps + 1, t.parent FROM u JOIN t ON t.node = u.up)
SELECT node, CAST(max(steps) AS INTEGER) AS generation FROM u GROUP BY 1""")
def lineage_generations(spark, sf_dir):
    c = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(c.alias("node"), F.when(c > 0, F.floor(c / 3)).cast("bigint").alias("parent"))
    return tr.ancestors(t, "node", "parent").groupBy("node").agg(F.max("steps").alias("generation"))
