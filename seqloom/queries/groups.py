"""Scores and comparison of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.text import members_digest
from seqloom.operators import groups as gr
from seqloom.queries.carriers import MEMBERS, members
from seqloom.queries.registry import query, table

_COUNTS = f"m AS {MEMBERS}, z AS (SELECT grp, count(*) AS size FROM m GROUP BY 1), c AS (SELECT grp, taxon, count(*) AS k, any_value(size) AS size FROM m JOIN z USING (grp) GROUP BY 1, 2)"


@query(f"WITH {_COUNTS} SELECT grp, taxon, k, size FROM c")
def taxon_counts(spark, sf_dir):
    return gr.taxon_counts(members(spark, sf_dir))


@query(f"""WITH {_COUNTS} SELECT grp, CASE WHEN max(size) = 1 THEN 0 WHEN count(*) > 1 THEN CAST(printf('%.11e', product(CASE WHEN k = 1 THEN 2 * (1 + k / size) ELSE 1 END) - product(CASE WHEN k > 1 THEN k * (k / k) ELSE 1 END)) AS DOUBLE) END AS score FROM c GROUP BY 1""")
def cluster_score_product(spark, sf_dir):
    """Every group, to twelve digits: the last ones of a double depend on the order of the factors."""
    return gr.product_scores(members(spark, sf_dir)).select("grp", F.when(F.col("score").isNotNull(), F.format_string("%.11e", "score")).cast("double").alias("score"))


@query(f"WITH {_COUNTS} SELECT grp, size, CAST(CASE WHEN size = 1 THEN 0 ELSE pow(count(*) FILTER (WHERE k = 1), 2) - coalesce(sum(k) FILTER (WHERE k > 1), 0) END AS BIGINT) AS score FROM c GROUP BY 1, 2")
def cluster_score_squared(spark, sf_dir):
    return gr.squared_scores(members(spark, sf_dir))


@query(f"""WITH {_COUNTS}, g AS (SELECT taxon, count(*) AS g FROM m GROUP BY 1)
SELECT grp, round(CASE WHEN max(size) = 1 THEN 0 ELSE sum(CASE WHEN k = 1 THEN sqrt(g) ELSE -2 * k / sqrt(g) END) END, 6) AS score FROM c JOIN g USING (taxon) GROUP BY 1""")
def cluster_score_global(spark, sf_dir):
    return gr.global_scores(members(spark, sf_dir)).select("grp", F.round("score", 6).alias("score"))


@query(f"WITH {_COUNTS} SELECT grp, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE -1 END) AS BIGINT) AS score FROM c GROUP BY 1")
def cluster_score_plusminus(spark, sf_dir):
    return gr.plus_minus_scores(members(spark, sf_dir))


@query(f"""WITH {_COUNTS}, s AS (SELECT grp, size, CASE WHEN size = 1 THEN 0 ELSE pow(count(*) FILTER (WHERE k = 1), 2) - coalesce(sum(k) FILTER (WHERE k > 1), 0) END AS score FROM c GROUP BY 1, 2),
t AS (SELECT CAST(sum(size) AS BIGINT) AS n, count(*) AS k, sum(score * size) / sum(size) AS total FROM s), x AS (SELECT count(DISTINCT taxon) AS taxa FROM m)
SELECT n, k, round(total, 6) AS total, round(total / k - pow(abs(sqrt(n) - k), 1.2), 2) AS srs, round(total / k - pow(abs(n / taxa - k), 1.2), 2) AS gpt FROM t, x""")
def clusterset_scores(spark, sf_dir):
    m = members(spark, sf_dir)
    return gr.set_scores(gr.squared_scores(m), m).withColumn("total", F.round("total", 6))


_AB = """a AS (SELECT c_nationkey AS grp, c_custkey AS member FROM customer), b AS (SELECT c_mktsegment AS grp, c_custkey AS member FROM customer),
o AS (SELECT a.grp AS grp1, b.grp AS grp2, count(*) AS common FROM a JOIN b USING (member) GROUP BY 1, 2),
f AS (SELECT o.grp1, o.grp2, common, size1, size2 FROM o JOIN (SELECT grp AS grp1, count(*) AS size1 FROM a GROUP BY 1) x ON x.grp1 = o.grp1 JOIN (SELECT grp AS grp2, count(*) AS size2 FROM b GROUP BY 1) y ON y.grp2 = o.grp2)"""


def _two_sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("member")), c.select(F.col("c_mktsegment").alias("grp"), F.col("c_custkey").alias("member"))


@query(f"WITH {_AB} SELECT grp1, grp2, common, size1, size2, round(2 * common / (size1 + size2), 6) AS dice FROM f")
def cluster_dice(spark, sf_dir):
    return gr.dice(gr.overlaps(*_two_sets(spark, sf_dir))).withColumn("dice", F.round("dice", 6))


@query(f"WITH {_AB}, t AS (SELECT grp1, sum(2 * common / (size1 + size2) * common / size1) AS tally, any_value(size1) AS s FROM f GROUP BY 1) SELECT round(sum(tally * s) / sum(s), 9) AS score FROM t")
def cluster_overlap(spark, sf_dir):
    return gr.set_overlap(gr.overlaps(*_two_sets(spark, sf_dir))).select(F.round("score", 9).alias("score"))


@query(f"""WITH {_AB}, x AS (SELECT grp1, sum(2 * common / (size1 + size2) * common / size1) AS tally, any_value(size1) AS s FROM f GROUP BY 1), y AS (SELECT grp2, sum(2 * common / (size1 + size2) * common / size2) AS tally, any_value(size2) AS s FROM f GROUP BY 1)
SELECT round(((SELECT sum(tally * s) / sum(s) FROM x) + (SELECT sum(tally * s) / sum(s) FROM y)) / 2, 9) AS score""")
def cluster_overlap_symmetric(spark, sf_dir):
    a, b = _two_sets(spark, sf_dir)
    return gr.symmetric_overlap(a.withColumn("grp", F.col("grp").cast("string")), b).select(F.round("score", 9).alias("score"))


@query(f"WITH m AS {MEMBERS} SELECT grp, md5(string_agg(member, '' ORDER BY member)) AS digest FROM m GROUP BY 1")
def group_digests(spark, sf_dir):
    return members(spark, sf_dir).groupBy("grp").agg(members_digest(F.collect_list("member")).alias("digest"))


@query(f"WITH m AS {MEMBERS} SELECT grp, size, concat('group_0_', row_number() OVER (ORDER BY size DESC, grp) - 1) AS name FROM (SELECT grp, count(*) AS size FROM m GROUP BY 1)")
def final_report(spark, sf_dir):
    """Groups by size, largest first, with hierarchical names in that order."""
    from seqloom.operators.dedup import with_row_number

    sizes = members(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    n = with_row_number(sizes, "n", F.desc("size"), "grp")
    return n.select("grp", "size", F.concat(F.lit("group_0_"), (F.col("n") - 1).cast("string")).alias("name"))


@query("""SELECT cluster_id, concat(cluster_name, '_c', row_number() OVER (PARTITION BY cluster_name ORDER BY cluster_id) - 1) AS name
FROM (SELECT DISTINCT cluster_id, cluster_name FROM clusters WHERE cluster_name IS NOT NULL)""")
def clique_names(spark, sf_dir):
    c = table(spark, sf_dir, "clusters").where("cluster_name is not null").select("cluster_id", "cluster_name").distinct()
    return gr.named(c, "cluster_name", ["cluster_id"], "name", "c").select("cluster_id", "name")


@query(f"""WITH {_COUNTS}, s AS (SELECT grp, size, pow(count(*) FILTER (WHERE k = 1), 2) - coalesce(sum(k) FILTER (WHERE k > 1), 0) AS score FROM c WHERE size > 1 GROUP BY 1, 2),
r AS (SELECT run_no, CAST(score AS BIGINT) AS score FROM s JOIN (SELECT DISTINCT cluster_id, run_no FROM clusters) x ON x.cluster_id = s.grp) SELECT run_no, max(score) AS best, min(score) AS worst FROM r GROUP BY 1""")
def sampled_best_worst(spark, sf_dir):
    """The best and the worst group score of each run."""
    s = gr.squared_scores(members(spark, sf_dir)).where("size > 1")
    runs = table(spark, sf_dir, "clusters").select(F.col("cluster_id").alias("grp"), "run_no").distinct()
    return s.join(runs, "grp").groupBy("run_no").agg(F.max("score").alias("best"), F.min("score").alias("worst"))


@query(f"WITH m AS {MEMBERS} SELECT grp, member FROM m WHERE taxon NOT IN (SELECT taxon FROM m GROUP BY 1 HAVING count(*) > 100)")
def declique_members(spark, sf_dir):
    """Members of groups without those of frequent taxa."""
    m = members(spark, sf_dir)
    often = m.groupBy("taxon").agg(F.count(F.lit(1)).alias("n")).where("n > 100").select("taxon")
    return m.join(often, "taxon", "left_anti").select("grp", "member")


