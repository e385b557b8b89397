"""Deduplication, numbering, outliers, logs and calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.functions import values as vl
from seqloom.functions.residues import alphabet, fitness
from seqloom.operators import dedup as dd
from seqloom.queries.carriers import SEQUENCES, sequences
from seqloom.queries.registry import query, table


@query("SELECT id, epoch_us(min(loaded_at)) AS micros FROM fasta GROUP BY 1")
def dedup_id(spark, sf_dir):
    """The first delivery of each record."""
    return dd.first_of(table(spark, sf_dir, "fasta").select("id", "loaded_at"), "id", "loaded_at").select("id", F.unix_micros("loaded_at").alias("micros"))


@query(f"SELECT min(id) AS id, seq FROM {SEQUENCES} WHERE seq <> '' GROUP BY seq")
def dedup_seq(spark, sf_dir):
    """The smallest id of every sequence."""
    return dd.first_of(sequences(spark, sf_dir).where("seq <> ''"), "seq", "id").select("id", "seq")


@query("""WITH r AS (SELECT id, upper(regexp_replace(seq, '[^A-Za-z]', '', 'g')) AS seq, loaded_at FROM fasta), n AS (SELECT row_number() OVER (ORDER BY loaded_at, id, seq) AS n, id, seq FROM r WHERE seq <> '')
SELECT n, id, seq FROM n QUALIFY row_number() OVER (PARTITION BY seq ORDER BY n) = 1""")
def dedup_either(spark, sf_dir):
    """Records without those whose id or sequence an earlier kept record has.

    In the SQL the first record of a sequence is kept: in this table an id that comes again has the same sequence.
    """
    from seqloom.operators.dedup import with_row_number

    f = table(spark, sf_dir, "fasta").select("id", F.upper(F.regexp_replace("seq", "[^A-Za-z]", "")).alias("seq"), "loaded_at")
    numbered = with_row_number(f.where("seq <> ''"), "n", "loaded_at", "id", "seq")
    return dd.greedy_either(numbered.select("n", "id", "seq"), "id", "seq", "n")


@query("SELECT concat(id, '_', row_number() OVER (PARTITION BY id ORDER BY loaded_at)) AS unique_id, id, epoch_us(loaded_at) AS micros FROM fasta")
def unique_ids(spark, sf_dir):
    return dd.numbered(table(spark, sf_dir, "fasta").select("id", "loaded_at"), "id", "loaded_at").select("unique_id", "id", F.unix_micros("loaded_at").alias("micros"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS BIGINT) AS batch FROM documents")
def fixed_batches(spark, sf_dir):
    return dd.fixed_batches(table(spark, sf_dir, "documents").select("doc_id"), 1000, "doc_id")


@query("SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY c_custkey) AS INTEGER) AS chunk FROM customer")
def chunk_ids(spark, sf_dir):
    return dd.chunks(table(spark, sf_dir, "customer").select("c_custkey"), 7, "c_custkey")


@query("SELECT p_partkey, lpad(CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR), 7, '0') AS name FROM part")
def zero_padded_names(spark, sf_dir):
    p = dd.with_row_number(table(spark, sf_dir, "part").select("p_partkey"), "n", "p_partkey")
    return p.select("p_partkey", F.lpad(F.col("n").cast("string"), 7, "0").alias("name"))


@query("""WITH m AS (SELECT avg(length(text)) AS m, stddev_samp(length(text)) AS s FROM documents WHERE text <> '')
SELECT doc_id, length(text) AS n FROM documents, m WHERE text <> '' AND length(text) > m - s AND length(text) < m + s""")
def length_outliers(spark, sf_dir):
    """Documents of usual length."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return dd.within_deviation(d, F.col("n"))


@query("SELECT doc_id, gene, n FROM (SELECT doc_id, concat(coalesce(lang, 'und'), '.', coalesce(source, 'none')) AS gene, length(text) AS n FROM documents WHERE text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY gene ORDER BY n DESC, doc_id) = 1")
def largest_isoform(spark, sf_dir):
    gene = F.concat(F.coalesce("lang", F.lit("und")), F.lit("."), F.coalesce("source", F.lit("none")))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", gene.alias("gene"), F.length("text").cast("bigint").alias("n"))
    return dd.largest(d, "gene", F.col("n"), "doc_id")


@query("SELECT o_custkey, arg_max(o_orderkey, {'p': o_totalprice, 'k': -o_orderkey}) AS best, max(o_totalprice) AS score FROM orders GROUP BY 1")
def best_tree(spark, sf_dir):
    """Of every run the tree of the highest likelihood; ties: the first."""
    top = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("m")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(top).select("o_custkey", (-F.col("m.k")).alias("best"), F.col("m.o_totalprice").alias("score"))


@query("SELECT f.id FROM (SELECT DISTINCT id FROM fasta) f WHERE f.id NOT IN (SELECT name FROM id_map)")
def without_listed(spark, sf_dir):
    left, _ = dd.without_listed(table(spark, sf_dir, "fasta").select("id").distinct(), table(spark, sf_dir, "id_map").select(F.col("name").alias("id")), "id")
    return left


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def records_per_file(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def history_unique(spark, sf_dir):
    """The newest entry of every command of a process, trivial ones left out."""
    e = table(spark, sf_dir, "events").where("event_type <> 'view'").select("user_id", "event_type", "ts")
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"))
    return e.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query("SELECT event_id, user_id, strftime(ts, '%Y%m') AS month, event_type FROM events WHERE regexp_matches(event_type, 'c[lk]') ORDER BY ts DESC, event_id LIMIT 200")
def history_search(spark, sf_dir):
    """The newest 200 matching entries: a search with a depth limit."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").rlike("c[lk]"))
    return e.orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "user_id", F.date_format("ts", "yyyyMM").alias("month"), "event_type")


@query("SELECT event_id, concat(':', user_id, ' ', strftime(ts, '%b/%d/%y %H:%M'), '; ', event_type) AS line FROM events WHERE NOT regexp_matches(event_type, '^(view|login)$')")
def history_skip(spark, sf_dir):
    """Entries as history lines, without trivial commands."""
    e = table(spark, sf_dir, "events").where(~F.col("event_type").rlike("^(view|login)$"))
    return e.select("event_id", F.concat(F.lit(":"), F.col("user_id").cast("string"), F.lit(" "), F.date_format("ts", "MMM/dd/yy HH:mm"), F.lit("; "), "event_type").alias("line"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
SELECT o_orderkey, CAST(trunc((epoch(o_orderdate) - epoch(prev) - 31536000) / -86400) AS INTEGER) AS shift FROM o WHERE prev IS NOT NULL AND o_totalprice >= 250000""")
def calendar_shift(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", F.lag("o_orderdate").over(w).alias("prev"))
    return o.where("prev is not null and o_totalprice >= 250000").select("o_orderkey", vl.day_shift(F.col("o_orderdate"), F.col("prev")).alias("shift"))


@query("""SELECT o_orderkey, count(*) AS days FROM (SELECT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE), CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), INTERVAL 1 DAY)) AS d FROM orders)
WHERE dayofweek(d) NOT IN (0, 6) GROUP BY 1""")
def weekdays_ahead(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.size(vl.weekdays(F.col("o_orderdate"))).cast("bigint").alias("days"))
    return o.where("days > 0")


@query(f"SELECT id, CASE WHEN length(regexp_replace(seq, '[^ACGT]', '', 'g')) / length(seq) > 0.9 THEN 'nucl' ELSE 'prot' END AS alphabet FROM {SEQUENCES} WHERE seq <> ''")
def alphabet_guess(spark, sf_dir):
    return sequences(spark, sf_dir).where("seq <> ''").select("id", alphabet(F.col("seq")).alias("alphabet"))


@query(f"""SELECT id, 100::DOUBLE * CASE WHEN left(seq, 1) = 'M' THEN 1 ELSE 0.25::DOUBLE END * CASE WHEN length(seq) BETWEEN 350 AND 550 THEN 1 ELSE 0.5::DOUBLE END AS fitness FROM {SEQUENCES} WHERE seq <> ''""")
def fitness_scores(spark, sf_dir):
    return sequences(spark, sf_dir).where("seq <> ''").select("id", fitness(F.col("seq")).alias("fitness"))


@query(f"""WITH f AS (SELECT id, 100::DOUBLE * CASE WHEN left(seq, 1) = 'M' THEN 1 ELSE 0.25::DOUBLE END * CASE WHEN length(seq) BETWEEN 350 AND 550 THEN 1 ELSE 0.5::DOUBLE END AS fitness FROM {SEQUENCES} WHERE seq <> '')
SELECT id, round(fitness / sum(fitness) OVER (), 9) AS share, round(sum(fitness) OVER (ORDER BY id) / sum(fitness) OVER (), 9) AS cumulative FROM f""")
def fitness_cumulative(spark, sf_dir):
    from seqloom.operators.statistics import cumulative

    return cumulative(fitness_scores(spark, sf_dir), "fitness", "id").select("id", F.round("share", 9).alias("share"), F.round("cumulative", 9).alias("cumulative"))


@query("SELECT DISTINCT id, split_part(id, '-', 1) AS taxon FROM fasta")
def taxa_of_ids(spark, sf_dir):
    from seqloom.functions.ids import taxon

    return table(spark, sf_dir, "fasta").select("id", taxon(F.col("id")).alias("taxon")).distinct()


@query(f"SELECT id, left(seq, 50) AS front, right(seq, 50) AS back FROM {SEQUENCES} WHERE seq <> ''")
def sequence_ends(spark, sf_dir):
    return sequences(spark, sf_dir).where("seq <> ''").select("id", F.left("seq", F.lit(50)).alias("front"), F.right("seq", F.lit(50)).alias("back"))


@query(f"SELECT id, substr(md5(id), 1, 10) AS code FROM {SEQUENCES}")
def hashed_ids(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", F.substr(F.md5("id"), F.lit(1), F.lit(10)).alias("code"))


@query("SELECT cluster_id, middle FROM (SELECT DISTINCT cluster_id, CASE WHEN length(cluster_name) > 8 THEN concat(left(cluster_name, 6), ' ... ', right(cluster_name, 2)) ELSE cluster_name END AS middle FROM clusters)")
def short_names(spark, sf_dir):
    return table(spark, sf_dir, "clusters").select("cluster_id", tx.middle_ellipsis(F.col("cluster_name"), 8).alias("middle")).distinct()
