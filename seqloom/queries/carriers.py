"""How the test tables stand in for domain data, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.ids import plain_members, plain_pairs, taxon
from seqloom.queries.registry import table

LETTERS = "ARNDCQEGHILKMFPSTWYV"

#: The names of hashes, and an id in any notation, ``{0}``, with its row of names, ``{1}``, in plain form.
NAMES = "(SELECT trim(hash) AS hash, min(trim(name)) AS name FROM id_map WHERE trim(hash) <> '' AND trim(name) <> '' GROUP BY 1)"
PLAIN = "coalesce({1}.name, regexp_replace(trim({0}), '^([^-@]*)@', '\\1-'))"


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, seq)``: 64 columns a row, from the embeddings."""
    x = F.col("x").cast("double")
    number = F.least(F.lit(19), F.greatest(F.lit(0), F.floor((x + 0.5) * 20))).cast("int")
    letter = F.when(F.abs(x) < 0.01, F.lit("-")).otherwise(F.substr(F.lit(LETTERS), number + 1, F.lit(1)))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("pos", "x"))
    long = e.select("id", "label", "pos", letter.alias("aa"))
    return long.groupBy("id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "aa"))), lambda s: s["aa"]), "").alias("seq"))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, pos, aa)`` of the alignment."""
    x = F.col("x").cast("double")
    number = F.least(F.lit(19), F.greatest(F.lit(0), F.floor((x + 0.5) * 20))).cast("int")
    letter = F.when(F.abs(x) < 0.01, F.lit("-")).otherwise(F.substr(F.lit(LETTERS), number + 1, F.lit(1)))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("pos", "x"))
    return e.select("id", "label", "pos", letter.alias("aa"))


COLUMNS = f"""(SELECT vec_id AS id, label, CAST(pos AS INTEGER) AS pos, CASE WHEN abs(x) < 0.01 THEN '-'
  ELSE substr('{LETTERS}', 1 + CAST(least(19, greatest(0, floor((x + 0.5::DOUBLE) * 20))) AS INTEGER), 1) END AS aa
  FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))"""


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, pos, symbol)``: M inside a membrane, o outside."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "x"))
    return e.select("id", "pos", F.when(F.col("x") > 0, "M").otherwise("o").alias("symbol"))


TOPOLOGY = """(SELECT vec_id AS id, CAST(pos AS INTEGER) AS pos, CASE WHEN x > 0 THEN 'M' ELSE 'o' END AS symbol
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings))"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq1, seq2, score)``: each pair of plain ids with its highest valid score."""
    rows = table(spark, sf_dir, "sim_scores").where("score >= 0.0 and score <= 1.0")
    return (
        plain_pairs(rows, table(spark, sf_dir, "id_map"), "seq1", "seq2", "score")
        .where("a <> b").groupBy(F.least("a", "b").alias("seq1"), F.greatest("a", "b").alias("seq2")).agg(F.max("score").alias("score"))
    )


GRAPH = f"""(SELECT least(a, b) AS seq1, greatest(a, b) AS seq2, max(score) AS score FROM
  (SELECT nullif({PLAIN.format('seq1', 'n1')}, '') AS a, nullif({PLAIN.format('seq2', 'n2')}, '') AS b, score FROM sim_scores
   LEFT JOIN {NAMES} n1 ON n1.hash = trim(seq1) LEFT JOIN {NAMES} n2 ON n2.hash = trim(seq2) WHERE score >= 0 AND score <= 1 AND NOT isnan(score))
  WHERE a <> b GROUP BY 1, 2)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grp, member, taxon)`` of the cluster records, each once, in plain ids."""
    rows = table(spark, sf_dir, "clusters").select(F.col("cluster_id").alias("grp"), F.explode("cluster").alias("m"))
    rows = plain_members(rows, table(spark, sf_dir, "id_map"), "m", "grp").select("grp", "member").distinct()
    return rows.withColumn("taxon", taxon(F.col("member")))


MEMBERS = f"""(SELECT DISTINCT grp, member, split_part(member, '-', 1) AS taxon FROM
  (SELECT cluster_id AS grp, nullif({PLAIN.format('m', 'n')}, '') AS member FROM (SELECT cluster_id, unnest(cluster) AS m FROM clusters) LEFT JOIN {NAMES} n ON n.hash = trim(m)) WHERE member IS NOT NULL)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, seq)``: each record of fasta once, its letters in upper case; null where there is none."""
    s = F.upper(F.regexp_replace("seq", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "fasta").select("id", s.alias("seq")).distinct()


SEQUENCES = "(SELECT DISTINCT id, upper(regexp_replace(seq, '[^A-Za-z]', '', 'g')) AS seq FROM fasta)"


def segments_topology(spark: SparkSession, sf_dir: str, width: int = 4) -> DataFrame:
    """``(id, pos, symbol)``: M where the mean of a stretch of ``width`` columns is above zero, else o."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "x"))
    b = e.groupBy("id", F.floor(F.col("pos") / width).cast("int").alias("b")).agg(F.when(F.sum(F.round(F.col("x").cast("double") * 1e6).cast("long")) > 0, "M").otherwise("o").alias("symbol"))
    return b.select("id", F.explode(F.sequence(F.col("b") * width, F.col("b") * width + width - 1)).alias("pos"), "symbol")


SEGMENTS = """(SELECT id, CAST(unnest([4 * b, 4 * b + 1, 4 * b + 2, 4 * b + 3]) AS INTEGER) AS pos, symbol FROM (SELECT id, pos // 4 AS b, CASE WHEN sum(CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT)) > 0 THEN 'M' ELSE 'o' END AS symbol
  FROM (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2))"""
