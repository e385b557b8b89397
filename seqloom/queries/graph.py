"""Similarity graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.ids import taxon
from seqloom.operators import graphs
from seqloom.queries.carriers import GRAPH, graph
from seqloom.queries.registry import query, table


def _panel(spark, sf_dir):
    """The members of the largest taxon."""
    return table(spark, sf_dir, "fasta").select(F.col("id").alias("member")).where(taxon(F.col("id")) == "Bdu").distinct()


@query(f"SELECT seq1, seq2, score FROM {GRAPH} WHERE seq1 IN (SELECT id FROM fasta WHERE id LIKE 'Bdu-%') AND seq2 IN (SELECT id FROM fasta WHERE id LIKE 'Bdu-%')")
def induced_subgraph(spark, sf_dir):
    return graphs.induced(graph(spark, sf_dir), _panel(spark, sf_dir))


@query(f"""SELECT seq1, seq2, score, 'removed' AS part FROM {GRAPH} WHERE seq1 IN (SELECT id FROM fasta WHERE id LIKE 'Bdu-%') AND seq2 IN (SELECT id FROM fasta WHERE id LIKE 'Bdu-%')
UNION ALL SELECT seq1, seq2, score, 'remaining' FROM {GRAPH} WHERE seq1 NOT IN (SELECT id FROM fasta WHERE id LIKE 'Bdu-%') AND seq2 NOT IN (SELECT id FROM fasta WHERE id LIKE 'Bdu-%')""")
def split_graph(spark, sf_dir):
    removed, remaining = graphs.split(graph(spark, sf_dir), _panel(spark, sf_dir))
    return removed.withColumn("part", F.lit("removed")).unionByName(remaining.withColumn("part", F.lit("remaining")))


@query(f"""SELECT seq1, seq2, score FROM {GRAPH} WHERE NOT (seq1 IN (SELECT id FROM fasta WHERE id LIKE 'Bdu-%') AND seq2 IN (SELECT id FROM fasta WHERE id LIKE 'Bdu-%'))""")
def graph_without_taken(spark, sf_dir):
    g = graph(spark, sf_dir)
    return graphs.without_edges(g, graphs.induced(g, _panel(spark, sf_dir)))


@query(f"""WITH RECURSIVE e AS (SELECT seq1 AS a, seq2 AS b FROM {GRAPH} WHERE score >= 0.9 UNION SELECT seq2, seq1 FROM {GRAPH} WHERE score >= 0.9),
r(member, o) AS (SELECT a, a FROM e UNION SELECT r.member, e.b FROM r JOIN e ON r.o = e.a) SELECT member, min(o) AS grp FROM r GROUP BY 1""")
def threshold_components(spark, sf_dir):
    return graphs.components(graph(spark, sf_dir).where("score >= 0.9"))


@query(f"""WITH RECURSIVE e AS (SELECT seq1 AS a, seq2 AS b FROM {GRAPH} WHERE score >= 0.9 UNION SELECT seq2, seq1 FROM {GRAPH} WHERE score >= 0.9),
r(member, o) AS (SELECT a, a FROM e UNION SELECT r.member, e.b FROM r JOIN e ON r.o = e.a), g AS (SELECT member, min(o) AS grp FROM r GROUP BY 1)
SELECT member, grp FROM g WHERE grp IN (SELECT grp FROM g GROUP BY 1 HAVING count(*) >= 3)""")
def candidate_cliques(spark, sf_dir):
    return graphs.sized_components(graph(spark, sf_dir).where("score >= 0.9"), 3)


@query(f"""WITH RECURSIVE s AS (SELECT seq1 AS a, seq2 AS b, score FROM {GRAPH} UNION ALL SELECT seq2, seq1, score FROM {GRAPH}),
h AS (SELECT a, b FROM s QUALIFY rank() OVER (PARTITION BY a ORDER BY score DESC) = 1), e AS (SELECT a, b FROM h UNION SELECT b, a FROM h),
r(member, o) AS (SELECT a, a FROM e UNION SELECT r.member, e.b FROM r JOIN e ON r.o = e.a) SELECT member, min(o) AS grp FROM r GROUP BY 1""")
def best_hit_components(spark, sf_dir):
    return graphs.best_hit_closure(graph(spark, sf_dir))


@query()
def paralog_collapse(spark, sf_dir):
    folded, _ = graphs.collapse_paralogs(graph(spark, sf_dir), taxon)
    return folded


@query()
def mcl_clusters(spark, sf_dir):
    return graphs.markov_clusters(graph(spark, sf_dir), 2.0, 0.5)


@query(f"""WITH RECURSIVE e AS (SELECT seq1 AS a, seq2 AS b FROM {GRAPH} WHERE 1 - score <= 0.1 UNION SELECT seq2, seq1 FROM {GRAPH} WHERE 1 - score <= 0.1),
r(member, o) AS (SELECT a, a FROM e UNION SELECT r.member, e.b FROM r JOIN e ON r.o = e.a) SELECT member, min(o) AS grp FROM r GROUP BY 1""")
def single_linkage(spark, sf_dir):
    return graphs.linkage(graph(spark, sf_dir), 0.1)


@query()
def complete_linkage(spark, sf_dir):
    return graphs.linkage(graph(spark, sf_dir), 0.1, "complete")


_TAXA = f"(SELECT least(x, y) AS seq1, greatest(x, y) AS seq2, max(score) AS score FROM (SELECT split_part(seq1, '-', 1) AS x, split_part(seq2, '-', 1) AS y, score FROM {GRAPH}) WHERE x <> y GROUP BY 1, 2)"


def _taxon_graph(spark, sf_dir):
    """The highest score between any two taxa, and the taxa in order; a matrix has a column for each, so there must be few."""
    x, y = taxon(F.col("seq1")), taxon(F.col("seq2"))
    g = graph(spark, sf_dir).where(x != y).groupBy(F.least(x, y).alias("seq1"), F.greatest(x, y).alias("seq2")).agg(F.max("score").alias("score"))
    return g, graphs.few_ids(g, "seq1", "seq2")


@query(f"WITH t AS {_TAXA}, s AS (SELECT seq1 AS id, seq2 AS other, score FROM t UNION ALL SELECT seq2, seq1, score FROM t UNION ALL SELECT DISTINCT unnest([seq1, seq2]) AS id, id, 1.0::DOUBLE FROM t) PIVOT s ON other USING max(score) GROUP BY id")
def pivot_matrix(spark, sf_dir):
    """The taxa's square matrix of highest scores, 1 on the diagonal."""
    return graphs.matrix_form(*_taxon_graph(spark, sf_dir))


@query(f"SELECT seq1, seq2, score FROM {_TAXA}")
def melt_matrix(spark, sf_dir):
    """The taxa's matrix, back as an edge list."""
    return graphs.melted(pivot_matrix(spark, sf_dir), "id")


@query(f"SELECT seq1, seq2, pow(10, score) AS inflated FROM {GRAPH}")
def inflated_scores(spark, sf_dir):
    return graph(spark, sf_dir).select("seq1", "seq2", F.pow(F.lit(10.0), F.col("score")).alias("inflated"))


@query(f"SELECT DISTINCT unnest([seq1, seq2]) AS id FROM {GRAPH}")
def graph_vertices(spark, sf_dir):
    return graph(spark, sf_dir).select(F.explode(F.array("seq1", "seq2")).alias("id")).distinct()
