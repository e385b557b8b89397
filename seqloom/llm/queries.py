"""The pN_ queries of the llm operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.ids import plain_members, plain_pairs
from seqloom.llm.clustering import described_clusters, pivot_clusters
from seqloom.llm import near_duplicates as near
from seqloom.llm.components import connected_components
from seqloom.llm.encoding import decoded, encoded, public_vocabulary, token_counts
from seqloom.llm.packing import fill_containers, packing_invariants
from seqloom.llm.quality import mostly_outside_sentences, outlier_scores, text_statistics
from seqloom.llm.set_join import link_counts, record_pairs, similar_between, similar_records
from seqloom.llm.sql import ORACLE
from seqloom.llm.top_n import top_n
from seqloom.plans.stages import Stages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def valid_score(c: str = "score"):
    """A score counts when it lies in 0..1; NaN does not."""
    return (F.col(c) >= 0.0) & (F.col(c) <= 1.0)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = near.near_duplicates(_table(spark, sf_dir, "fasta"), "id", near.letters(F.col("seq")))
    return near.record_pairs(pairs, members).select(F.col("rec1").alias("id1"), F.col("rec2").alias("id2"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with the smallest id of its group: what is linked by similar content, directly or over others."""
    pairs, members = near.near_duplicates(_table(spark, sf_dir, "fasta"), "id", near.letters(F.col("seq")))
    return near.linked_groups(pairs, members).select(F.col("rec").alias("id"), "group_id")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster record with the first record of equal members, and with how many records are similar to it."""
    pairs, belongs = similar_records(cluster_sets(spark, sf_dir), "cluster_id", "members", 0.8)
    return link_counts(pairs, belongs).select(F.col("rec").alias("cluster_id"), F.col("cls").alias("class_id"), "links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, belongs = similar_records(cluster_sets(spark, sf_dir), "cluster_id", "members", 0.8)
    return record_pairs(pairs, belongs).select(F.col("rec1").alias("cluster_id1"), F.col("rec2").alias("cluster_id2"))


def p2_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of a record with a name and one without."""
    sets = cluster_sets(spark, sf_dir)
    named = _table(spark, sf_dir, "clusters").where("cluster_name is not null").select("cluster_id").distinct()
    with_, without = sets.join(named, "cluster_id", "left_semi"), sets.join(named, "cluster_id", "left_anti")
    return similar_between(with_, without, "cluster_id", "members", 0.8).select(F.col("rec1").alias("cluster_id1"), F.col("rec2").alias("cluster_id2"))


def cluster_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cluster_id, members)``: each record once, with its plain members."""
    rows = _table(spark, sf_dir, "clusters").select("cluster_id", F.explode("cluster").alias("member"))
    return (
        plain_members(rows, _table(spark, sf_dir, "id_map"), "member", "cluster_id")
        .groupBy("cluster_id")
        .agg(F.collect_set("member").alias("members"))
    )


def valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(a, b, score)``: the rows with a valid score, in plain ids."""
    rows = _table(spark, sf_dir, "sim_scores").where(valid_score())
    return plain_pairs(rows, _table(spark, sf_dir, "id_map"), "seq1", "seq2", "score")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters(valid_pairs(spark, sf_dir), "a", "b", "score", 0.5)


def p3_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster by its size and its up to three most typical members, the medoid first."""
    top = described_clusters(valid_pairs(spark, sf_dir), "a", "b", "score", 0.5).where("place <= 3")
    return (
        top.groupBy("cluster_id", "size")
        .agg(F.array_sort(F.collect_list(F.struct("place", "seq_id"))).alias("m"))
        .select("cluster_id", "size", F.col("m.seq_id")[0].alias("medoid"), F.array_join("m.seq_id", " ").alias("typical"))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = plain_pairs(_table(spark, sf_dir, "sim_scores"), _table(spark, sf_dir, "id_map"), "seq1", "seq2")
    return connected_components(links, "a", "b").select(F.col("id").alias("seq_id"), "group_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = valid_pairs(spark, sf_dir).where("a <> b")
    sides = pairs.select(
        F.inline(F.array(F.struct("a", "b", "score"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "score")))
    )
    best = top_n(sides, F.col("a"), F.col("b"), F.col("score"), 5)
    return best.select(F.col("group").alias("seq_id"), "rnk", F.col("item").alias("partner_id"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encoded(_table(spark, sf_dir, "documents"), "doc_id", "text", public_vocabulary())
    return ids.withColumnRenamed("key", "doc_id")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that come back from the ids; a null text comes back empty."""
    return decoded(p6_ids(spark, sf_dir), "doc_id", "ids", public_vocabulary()).withColumnRenamed("key", "doc_id")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", public_vocabulary())
    return fill_containers(sizes, "key", "n_tokens", 2048).withColumnRenamed("key", "doc_id")


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of :func:`p7_pieces`: every document once, no container too full, no overlap and no gap in one, no piece cut in need."""
    return packing_invariants(p7_pieces(spark, sf_dir), "doc_id", 2048)


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the outlier score of every document with visible characters."""
    t = text_statistics(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang", _table(spark, sf_dir, "common_words"))
    return outlier_scores(t, Stages(spark, "quality")).drop("h", "g").withColumnRenamed("key", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, words = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words")
    return mostly_outside_sentences(documents, "doc_id", "text", "lang", words).select(F.col("key").alias("doc_id"))


def queries() -> dict:
    return {q.__name__: q for q in (p1_found, p1_groups, p2_found, p2_links, p2_between, p3_found, p3_described, p4_found, p5_found, p6_ids, p6_decoded, p7_pieces, p7_invariants, p8_found, p8_scores)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
