"""Routing, selection, calendars, greedy rules and loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.functions import values as vl
from seqloom.functions.ids import taxon
from seqloom.functions.residues import degapped, reading_frame
from seqloom.operators import dedup as dd
from seqloom.operators import pairs as pr
from seqloom.operators import statistics as st
from seqloom.queries.carriers import COLUMNS, GRAPH, LETTERS, MEMBERS, SEQUENCES, alignment, graph, members, sequences
from seqloom.queries.registry import query, table


@query("SELECT DISTINCT id, CASE WHEN regexp_matches(id, '^[A-C]') THEN 'early' WHEN regexp_matches(id, '^[D-K]') THEN 'middle' WHEN regexp_matches(id, '^[A-Z]') THEN 'late' END AS route FROM fasta")
def routed_ids(spark, sf_dir):
    """The first of several patterns decides; an id that matches none would be an error."""
    ids = table(spark, sf_dir, "fasta").select("id").distinct()
    return ids.select("id", tx.routed(F.col("id"), [("^[A-C]", "early"), ("^[D-K]", "middle"), ("^[A-Z]", "late")]).alias("route"))


_ROWS = f"(SELECT concat('r', id) AS id, pos, aa FROM {COLUMNS})"


def _rows(spark, sf_dir):
    return alignment(spark, sf_dir).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), "seq")


_IDENTITY = "CAST(count(*) FILTER (WHERE x.aa = y.aa) AS INTEGER) AS identical, CAST(count(*) AS INTEGER) AS compared"


@query(f"SELECT x.id AS id1, y.id AS id2, {_IDENTITY} FROM {_ROWS} x JOIN {_ROWS} y ON x.pos = y.pos WHERE regexp_matches(x.id, '[05]$') AND NOT regexp_matches(y.id, '[05]$') AND NOT (x.aa = '-' AND y.aa = '-') GROUP BY 1, 2")
def identity_of_split(spark, sf_dir):
    """Rows whose id matches a pattern against the others."""
    hit, other = dd.selected(_rows(spark, sf_dir), F.col("id"), "[05]$")
    return pr.pairs_between(hit, other, "id", "seq", LETTERS).where("compared > 0").select("id1", "id2", "identical", "compared")


@query(f"SELECT x.id AS id1, y.id AS id2, {_IDENTITY} FROM {_ROWS} x JOIN {_ROWS} y ON x.pos = y.pos AND x.id < y.id WHERE regexp_matches(x.id, '[05]$') AND regexp_matches(y.id, '[05]$') AND NOT (x.aa = '-' AND y.aa = '-') GROUP BY 1, 2")
def identity_within_matched(spark, sf_dir):
    """Rows whose id matches a pattern among themselves."""
    hit, _ = dd.selected(_rows(spark, sf_dir), F.col("id"), "[05]$")
    return pr.all_pairs(hit, "id", "seq", LETTERS).where("compared > 0").select("id1", "id2", "identical", "compared")


@query(f"SELECT id1, id2, identical, compared FROM (SELECT x.id AS id1, y.id AS id2, {_IDENTITY} FROM {_ROWS} x JOIN {_ROWS} y ON x.pos = y.pos AND x.id < y.id WHERE NOT (x.aa = '-' AND y.aa = '-') GROUP BY 1, 2) WHERE 100 * identical > 15 * compared")
def identity_above(spark, sf_dir):
    """The pairs of more than fifteen per cent identity."""
    return pr.all_pairs(_rows(spark, sf_dir), "id", "seq", LETTERS).where("100 * identical > 15 * compared").select("id1", "id2", "identical", "compared")


@query(f"SELECT id, seq FROM {SEQUENCES} WHERE regexp_matches(id, '^(Bdu|Cim)-')")
def records_by_pattern(spark, sf_dir):
    return dd.selected(sequences(spark, sf_dir), F.col("id"), "^(Bdu|Cim)-")[0]


@query("SELECT DISTINCT id FROM fasta WHERE contains(description, 'isoform')")
def header_contains(spark, sf_dir):
    return table(spark, sf_dir, "fasta").where(F.col("description").contains("isoform")).select("id").distinct()


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_custkey >= 50")
def parameter_slice(spark, sf_dir):
    """A range of two parameters."""
    return table(spark, sf_dir, "orders").where("o_totalprice between 100000 and 200000 and o_custkey >= 50").select("o_orderkey", "o_totalprice", "o_custkey")


@query(f"SELECT seq1, seq2, score FROM {GRAPH} WHERE seq1 IN (SELECT member FROM {MEMBERS}) OR seq2 IN (SELECT member FROM {MEMBERS})")
def edges_touching_members(spark, sf_dir):
    """Edges with an end in a cluster: membership of either side."""
    m = members(spark, sf_dir).select("member").distinct()
    g = graph(spark, sf_dir)
    one = g.join(m.withColumnRenamed("member", "seq1"), "seq1", "left_semi").select("seq1", "seq2", "score")
    return one.unionByName(g.join(m.withColumnRenamed("member", "seq1"), "seq1", "left_anti").join(m.withColumnRenamed("member", "seq2"), "seq2", "left_semi").select("seq1", "seq2", "score"))


@query(f"SELECT id, length(seq) // 3 AS codons FROM {SEQUENCES} WHERE length(seq) > 0 AND length(seq) % 3 = 0")
def reading_frames(spark, sf_dir):
    s = sequences(spark, sf_dir).where("length(seq) > 0 and length(seq) % 3 = 0")
    return s.select("id", F.floor(F.length(reading_frame(F.col("seq"))) / 3).cast("bigint").alias("codons"))


_COMMAND = "CASE event_type WHEN 'view' THEN 'ls -la' WHEN 'click' THEN 'cat x | grep y' WHEN 'purchase' THEN ':; head file' ELSE event_type END"


@query(f"SELECT event_id, CASE WHEN c LIKE ':;%' THEN trim(substr(c, 3)) ELSE c END AS command FROM (SELECT event_id, {_COMMAND} AS c FROM events) WHERE NOT (regexp_matches(c, '^(ls|la|ll|hs|js|cat|head|tail)') AND NOT contains(c, '|'))")
def history_kept(spark, sf_dir):
    """Commands without looks, unless they are piped or marked to be kept."""
    e = table(spark, sf_dir, "events").select("event_id", tx.kept_command(F.expr(_COMMAND)).alias("command"))
    return e.where("command is not null")


_DATES = "(SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%m/%d/%Y') AS now, coalesce(strftime(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%m/%d/%Y'), 'n/a') AS prev FROM orders)"


@query(f"""SELECT o_orderkey, n - p AS apart FROM (SELECT o_orderkey, CAST(epoch(strptime(now, '%m/%d/%Y')) AS BIGINT) AS n, CAST(epoch(try_strptime(prev, '%m/%d/%Y')) AS BIGINT) AS p FROM {_DATES} WHERE o_totalprice >= 250000)
WHERE n - p - 31536000 + 80640 * 5 < 0 OR n - p - 31536000 - 80640 * 17 > 0""")
def shifted_reports(spark, sf_dir):
    """Large orders whose date lies outside a band around one year after the one before; dates are texts, ``n/a`` the first."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.date_format("o_orderdate", "MM/dd/yyyy").alias("now"), F.coalesce(F.date_format(F.lag("o_orderdate").over(w), "MM/dd/yyyy"), F.lit("n/a")).alias("prev")
    )
    n, p = vl.epoch(F.col("now")), vl.epoch(F.col("prev"))
    return o.where("o_totalprice >= 250000").where(vl.outside_band(n, p, 5, 17)).select("o_orderkey", (n - p).alias("apart"))


@query(f"SELECT s_suppkey, list_extract([{', '.join(repr(c) for c in vl.CONTRAST)}], CAST(s_suppkey % 20 AS INTEGER) + 1) AS colour FROM supplier")
def contrast_colours(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", vl.contrast_colour(F.col("s_suppkey")).alias("colour"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def repaired_encodings(spark, sf_dir):
    """Texts whose bytes were read in the wrong encoding, repaired."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return d.select("doc_id", wrong.alias("text")).select("doc_id", tx.repaired_encoding(F.col("text")).alias("text"))


@query("SELECT n_regionkey AS region, max(n_name) AS nation FROM nation GROUP BY 1")
def reversed_maps(spark, sf_dir):
    """A map of all nations to their regions, turned around."""
    one = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_regionkey"))).alias("m"))  # 25 rows, a fixed table
    return one.select(F.explode(vl.reversed_map(F.col("m"))).alias("region", "nation"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'first' WHEN 'Brand#2' THEN 'second' ELSE 'other' END AS place FROM part")
def mapped_with_default(spark, sf_dir):
    m = F.create_map(F.lit("Brand#1"), F.lit("first"), F.lit("Brand#2"), F.lit("second"))
    return table(spark, sf_dir, "part").select("p_partkey", vl.get_or(m, F.col("p_brand"), F.lit("other")).alias("place"))


@query("SELECT p_partkey, concat('Brand#', CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) + 1) AS brand FROM part")
def callback_replaced(spark, sf_dir):
    """Numbers in names replaced by what a function makes of them."""
    return table(spark, sf_dir, "part").select("p_partkey", tx.replaced_by(F.col("p_brand"), "[0-9]+", lambda m: str(int(m[0]) + 1)).alias("brand"))


@query("""WITH RECURSIVE g(o, h) AS (SELECT p_partkey, p_size % 4 FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part) UNION ALL SELECT p_partkey, p_size % 4 FROM g JOIN part ON p_partkey = o + h + 1)
SELECT p_partkey, max(o) AS grp FROM part JOIN g ON o <= p_partkey AND p_partkey <= o + h GROUP BY 1""")
def skip_groups(spark, sf_dir):
    """Rows in order, each beginning a group that takes as many of the next ones as it has hits."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("hits"))
    return dd.skip_groups(p, "p_partkey", "hits")


@query()
def first_match_groups(spark, sf_dir):
    """Cluster records in order join the first group that holds their first known member."""
    c = members(spark, sf_dir).groupBy("grp").agg(F.array_sort(F.collect_list("member")).alias("ms"))
    return dd.first_match_groups(c.select(F.col("grp").alias("n"), "ms"), "n", "ms")


@query()
def unlike_rows(spark, sf_dir):
    """Rows without those that are alike, by more than fifteen per cent, to an earlier one that is kept."""
    a = alignment(spark, sf_dir)
    likes = pr.all_pairs(a, "id", "seq", LETTERS).where("100 * identical > 15 * compared").select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    return dd.greedy_unlike(a.select("id", "label"), likes, "id")


@query(f"""WITH n AS (SELECT id, (row_number() OVER (ORDER BY length(seq) DESC, id) - 1) % 14 AS k FROM {SEQUENCES} WHERE seq <> '') SELECT id, CAST(CASE WHEN k < 7 THEN k ELSE 13 - k END AS INTEGER) AS share FROM n""")
def balanced_loads(spark, sf_dir):
    """Sequences dealt to seven workers, long ones first."""
    s = sequences(spark, sf_dir).where("seq <> ''")
    return dd.by_load(s, 7, F.length("seq"), "id").select("id", "share")


@query("SELECT p_brand AS grp, string_agg(CAST(p_partkey AS VARCHAR), ' ' ORDER BY p_size DESC, p_partkey) AS leaves FROM part GROUP BY 1")
def leaves_by_support(spark, sf_dir):
    """The leaves of every group by support, highest first."""
    own = F.array_sort(F.collect_list(F.struct((-F.col("p_size")).alias("s"), "p_partkey")))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("grp")).agg(F.array_join(F.transform(own, lambda x: x["p_partkey"].cast("string")), " ").alias("leaves"))


_SCALED = "(SELECT k, greatest(0, least(1, (x - lo) / (hi - lo))) AS s FROM {0}, (SELECT min(x) AS lo, max(x) AS hi FROM {0}))"
_LINES = "(SELECT l_orderkey AS k, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100 AS x FROM lineitem GROUP BY 1)"
_ORDERS = "(SELECT o_orderkey AS k, o_totalprice AS x FROM orders)"


@query(f"SELECT a.k, round((a.s + b.s) / 2, 9) AS score FROM {_SCALED.format(_LINES)} a JOIN {_SCALED.format(_ORDERS)} b ON a.k = b.k")
def averaged_scores(spark, sf_dir):
    """Two score tables, each scaled to 0..1, joined and averaged."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(cents.alias("x"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"))
    one, two = (st.normalised(t, "x").select("k", F.col("scaled").alias(n)) for t, n in ((a, "s1"), (b, "s2")))
    return one.join(two, "k").select("k", F.round((F.col("s1") + F.col("s2")) / 2, 9).alias("score"))


@query(f"SELECT taxon, count(*) AS genes, md5(string_agg(gene, '' ORDER BY gene)) AS digest FROM (SELECT DISTINCT split_part(seq1, '-', 1) AS taxon, unnest([seq1, seq2]) AS gene FROM {GRAPH}) GROUP BY 1")
def gene_sets(spark, sf_dir):
    """The different genes on both sides of every group's edges."""
    g = graph(spark, sf_dir).select(taxon(F.col("seq1")).alias("taxon"), F.explode(F.array("seq1", "seq2")).alias("gene")).distinct()
    return g.groupBy("taxon").agg(F.count(F.lit(1)).alias("genes"), tx.members_digest(F.collect_list("gene")).alias("digest"))


@query(f"SELECT label, count(*) FILTER (WHERE aa = '-') AS gaps, count(*) FILTER (WHERE aa <> '-') AS residues FROM {COLUMNS} GROUP BY 1")
def gap_tally(spark, sf_dir):
    a = alignment(spark, sf_dir).select("label", F.length("seq").alias("n"), F.length(degapped(F.col("seq"))).alias("k"))
    return a.groupBy("label").agg(F.sum(F.col("n") - F.col("k")).alias("gaps"), F.sum("k").alias("residues"))


@query("SELECT DISTINCT p_name AS name FROM part")
def checked_names(spark, sf_dir):
    """Names that are unique, by a check that fails where one comes twice."""
    return dd.unique_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct(), "name")


@query()
def subset_tests(spark, sf_dir):
    """The t-test on three random subsets of a thousand values."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"))
    return st.subset_t(li, "l_quantity", "key", 1000, 3, 25.0)
