"""Search hits and best hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import hits as ht
from seqloom.queries.carriers import GRAPH, MEMBERS, graph, members
from seqloom.queries.registry import query, table

_SIDES = f"(SELECT seq1 AS a, seq2 AS b, score FROM {GRAPH} UNION ALL SELECT seq2, seq1, score FROM {GRAPH})"


@query(f"SELECT a, b, score FROM {_SIDES} QUALIFY rank() OVER (PARTITION BY a ORDER BY score DESC) = 1")
def best_hits_all_ties(spark, sf_dir):
    return ht.best_hits(graph(spark, sf_dir), "seq1", "seq2", "score")


@query(f"SELECT a, b, score FROM {_SIDES} QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1")
def best_hit_first(spark, sf_dir):
    return ht.best_hits(graph(spark, sf_dir), "seq1", "seq2", "score", ties=False)


_BEST = f"(SELECT a, b, score FROM {_SIDES} QUALIFY rank() OVER (PARTITION BY a ORDER BY score DESC) = 1)"


@query(f"WITH h AS {_BEST} SELECT x.a, x.b FROM h x JOIN h y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def reciprocal_best_hits(spark, sf_dir):
    return ht.reciprocal(ht.best_hits(graph(spark, sf_dir), "seq1", "seq2", "score"))


@query(f"WITH h AS {_BEST} SELECT x.a, x.b FROM h x JOIN h y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND split_part(x.a, '-', 1) = split_part(x.b, '-', 1)")
def paralog_pairs(spark, sf_dir):
    r = ht.reciprocal(ht.best_hits(graph(spark, sf_dir), "seq1", "seq2", "score"))
    return r.where(F.substring_index("a", "-", 1) == F.substring_index("b", "-", 1))


_HITS = "SELECT l_partkey AS subject, count(*) AS hits, round(avg(1 - l_discount), 8) AS identity, round(avg(l_tax), 8) AS evalue, round(avg(l_extendedprice), 7) AS bits FROM lineitem WHERE l_quantity >= 43 GROUP BY 1"


def _hits(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("subject"), F.col("l_quantity").alias("length"), (1 - F.col("l_discount")).alias("identity"),
        F.col("l_tax").alias("evalue"), F.col("l_extendedprice").alias("bits"),
    )


@query(f"SELECT * FROM ({_HITS}) WHERE hits > 5")
def hit_summary_strong(spark, sf_dir):
    s = ht.summarised(_hits(spark, sf_dir), "query", "subject", "length", "identity", "evalue", "bits", 43, digits=8)
    return s.where("strong").drop("strong").withColumn("bits", F.round("bits", 7))


@query(f"SELECT * FROM ({_HITS}) WHERE hits <= 5")
def hit_summary_weak(spark, sf_dir):
    s = ht.summarised(_hits(spark, sf_dir), "query", "subject", "length", "identity", "evalue", "bits", 43, digits=8)
    return s.where("not strong").drop("strong").withColumn("bits", F.round("bits", 7))


@query("""SELECT l_orderkey, l_linenumber, a.s_name AS query, b.s_name AS subject FROM lineitem JOIN supplier a ON a.s_suppkey = l_suppkey JOIN supplier b ON b.s_suppkey = l_partkey WHERE a.s_name <> b.s_name""")
def hits_decode(spark, sf_dir):
    """Hits coded by number on both sides, with the names of a dictionary; hits with an unknown code and self hits are dropped."""
    return _coded(spark, sf_dir)[0].where("query <> subject")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey AS query, l_partkey AS subject FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) OR l_partkey NOT IN (SELECT s_suppkey FROM supplier)""")
def hits_missing_codes(spark, sf_dir):
    """The hits of which the dictionary lacks a code."""
    return _coded(spark, sf_dir)[1]


def _coded(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("subject"))
    return ht.decoded(rows, table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "query", "subject")


@query(f"SELECT seq1, seq2, score FROM {GRAPH} WHERE NOT regexp_matches(seq1, '^Bel[^a-zA-Z0-9]') AND NOT regexp_matches(seq2, '^Bel[^a-zA-Z0-9]')")
def hits_strip_species(spark, sf_dir):
    return ht.without_species(graph(spark, sf_dir), "seq1", "seq2", "Bel")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 1e-181 ELSE l_tax END AS evalue FROM lineitem")
def hits_positive_evalue(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ht.positive_evalue(F.col("l_tax")).alias("evalue"))


@query(f"""WITH a AS (SELECT DISTINCT id AS key FROM fasta), b AS (SELECT DISTINCT member AS key FROM {MEMBERS})
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL OUTER JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL""")
def id_audit(spark, sf_dir):
    """Records that no cluster names, and cluster members without a record."""
    return ht.one_sided(table(spark, sf_dir, "fasta").select(F.col("id").alias("key")), members(spark, sf_dir).select(F.col("member").alias("key")), "key")


@query(f"""WITH g AS {GRAPH}, s AS (SELECT seq1 AS a, seq2 AS b, score FROM g UNION ALL SELECT seq2, seq1, score FROM g), p AS (SELECT f.id AS a, r.id AS b FROM fasta f CROSS JOIN ref_panel r GROUP BY 1, 2)
SELECT p.a, p.b, coalesce(s.score, 0) AS score FROM p LEFT JOIN s ON s.a = p.a AND s.b = p.b""")
def edge_lookup_default_zero(spark, sf_dir):
    """Every sequence against the twelve of the reference panel: the score in either direction, else 0."""
    ids = table(spark, sf_dir, "fasta").select(F.col("id").alias("a")).distinct()
    pairs = ids.crossJoin(F.broadcast(table(spark, sf_dir, "ref_panel").select(F.col("id").alias("b"))))
    return ht.scores_or_zero(pairs, graph(spark, sf_dir).withColumnsRenamed({"seq1": "a", "seq2": "b"}), "a", "b", "score")
