"""String functions over texts and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.functions import values as vl
from seqloom.queries.registry import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")


@query(r"SELECT doc_id, regexp_replace(text, '([A-Z][a-z]{2})-([A-Z])', '\1@\2', 'g') AS text FROM documents WHERE text IS NOT NULL")
def text_regrep(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.regrep(F.col("text"), "([A-Z][a-z]{2})-([A-Z])", r"\1@\2").alias("text"))


@query("SELECT p_partkey, concat(upper(left(p_name, 1)), substr(p_name, 2)) AS first, upper(p_name) AS everything FROM part")
def case_modes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", tx.upper_first(F.col("p_name")).alias("first"), F.upper("p_name").alias("everything"))


@query(r"SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: concat(upper(left(w, 1)), substr(w, 2))), 'string_agg', ' ') AS words FROM part")
def case_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.upper_words(F.col("p_name")).alias("words"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_type, ' ', '_'), ' ', '_') AS name FROM part")
def replace_first_two(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.replace_first(F.col("p_type"), " ", "_", 2).alias("name"))


@query(r"SELECT p_partkey, regexp_replace(p_brand, '([0-9]+)', '<\1', 'g') AS before, regexp_replace(p_brand, '([0-9]+)', '\1>', 'g') AS after FROM part")
def insert_at_matches(spark, sf_dir):
    b = F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", tx.insert_at(b, "[0-9]+", "<", before=True).alias("before"), tx.insert_at(b, "[0-9]+", ">").alias("after"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, n, string_split(line, chr(9)) AS cells FROM l)
SELECT doc_id, CAST(n - 1 AS INTEGER) AS n, list_reduce(cells, lambda a, x: concat(a, repeat(' ', CAST(4 - length(a) % 4 AS INTEGER)), x)) AS line FROM c""")
def tabs_to_spaces(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select("doc_id", "n", tx.spaces_for_tabs(F.col("line")).alias("line"))


@query(r"SELECT doc_id, concat(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m) +$', '', 'g'), '\n\n+', chr(10) || chr(10), 'g'), '\n+$', ''), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def tidy_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.tidy(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, list_aggregate(list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda w: w <> ''), 'string_agg', ' ') AS words, true AS fits FROM documents WHERE text IS NOT NULL""")
def wrap_text(spark, sf_dir):
    """Wrapped texts: their words in order, and whether no line of several words is too long."""
    t = _docs(spark, sf_dir).select("doc_id", tx.wrap(F.col("text"), 60).alias("text"))
    fits = F.forall(F.split("text", "\n"), lambda line: (F.length(line) <= 60) | (F.instr(line, " ") == 0))
    words = F.when(F.col("text") != "", F.replace("text", F.lit("\n"), F.lit(" ")))
    return t.select("doc_id", words.alias("words"), fits.alias("fits"))


@query("""SELECT o_orderkey, CASE WHEN s < 60 THEN concat(s, ' sec') WHEN s < 3600 THEN concat(s // 60, ' min, ', s % 60, ' sec') WHEN s < 86400 THEN concat(s // 3600, ' hrs, ', s % 3600 // 60, ' min, ', s % 60, ' sec')
ELSE concat(s // 86400, ' days, ', s % 86400 // 3600, ' hrs, ', s % 3600 // 60, ' min, ', s % 60, ' sec') END AS duration FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)""")
def pretty_time(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", vl.pretty_time(F.col("o_totalprice")).alias("duration"))


@query("""SELECT o_orderkey, CASE WHEN x < 1000 THEN concat(CAST(x AS DOUBLE), ' ') WHEN round(x / 1000, 2) < 1000 THEN concat(CAST(round(x / 1000, 2) AS DOUBLE), ' K') ELSE concat(CAST(round(round(x / 1000, 2) / 1000, 2) AS DOUBLE), ' M') END AS number
FROM (SELECT o_orderkey, floor(o_totalprice / 10) * 10 AS x FROM orders)""")
def pretty_number(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", vl.pretty_number(F.floor(F.col("o_totalprice") / 10) * 10).alias("number"))


@query("SELECT id, regexp_extract(id, '^([^0-9]*)', 1) || lpad(regexp_extract(id, '([0-9]+)$', 1), 20, '0') AS key FROM (SELECT DISTINCT id FROM fasta) WHERE regexp_full_match(id, '[^0-9]+[0-9]+')")
def natural_sort_keys(spark, sf_dir):
    ids = table(spark, sf_dir, "fasta").select("id").distinct().where(F.col("id").rlike("^[^0-9]+[0-9]+$"))
    return ids.select("id", tx.natural_key(F.col("id")).alias("key"))


@query("SELECT o_orderkey, printf('#%02x%02x%02x', o_orderkey % 256, (o_orderkey // 256) % 256, o_custkey % 256) AS colour FROM orders")
def hex_colours(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", vl.hex_colour(F.col("o_orderkey") % 256, F.floor(F.col("o_orderkey") / 256) % 256, F.col("o_custkey") % 256).alias("colour"))


@query("""SELECT vec_id, CASE WHEN s = 0 THEN '000000' ELSE printf('%02X%02X%02X', CASE WHEN s <= 0.5 THEN CAST(trunc(175 - 175 * s) AS INTEGER) ELSE 0 END, CASE WHEN s >= 0.5 THEN CAST(trunc(175 * s) AS INTEGER) ELSE 0 END, CAST(trunc(175 * (1 - abs(0.5::DOUBLE - s))) AS INTEGER)) END AS colour
FROM (SELECT vec_id, (vec_id % 101) / 100 AS s FROM embeddings)""")
def support_colours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", vl.support_colour(F.col("vec_id") % 101 / 100).alias("colour"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 2) * 1000000 END AS amount FROM supplier")
def money_values(spark, sf_dir):
    """Balances written as ``$12.43M`` and read again; negative ones are no such text."""
    s = table(spark, sf_dir, "supplier")
    text = F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("$"), F.round("s_acctbal", 2).cast("decimal(12,2)").cast("string"), F.lit("M"))).otherwise("n/a")
    return s.select("s_suppkey", vl.money(text).alias("amount"))


@query("SELECT p_partkey, concat(repeat('#', 40), chr(10), '# ', rpad(p_name, 36, ' '), ' #', chr(10), repeat('#', 40)) AS box FROM part")
def comment_boxes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.boxed(F.col("p_name"), 40).alias("box"))


@query("SELECT max(length(p_name)) AS widest, max(list_max(list_transform(string_split(p_name, ' '), lambda w: length(w)))) AS longest_word FROM part")
def column_widths(spark, sf_dir):
    words = F.array_max(F.transform(F.split("p_name", " "), F.length))
    return table(spark, sf_dir, "part").agg(F.max(F.length("p_name")).cast("bigint").alias("widest"), F.max(words).cast("bigint").alias("longest_word"))
