"""Joins by place and segment, lookups, external programs and functions, and what must hold after random steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.residues import codons_on_gaps
from seqloom.functions.stats import gaussian
from seqloom.operators import alignment as al
from seqloom.operators import grouping, pairs, stochastic, trees
from seqloom.operators import statistics as st
from seqloom.operators.external import Program, mapped, piped
from seqloom.queries.carriers import COLUMNS, MEMBERS, SEQUENCES, alignment, members, sequences
from seqloom.queries.registry import query, table


@query("""WITH v AS (SELECT o_orderkey, o_totalprice AS x FROM orders), r AS (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM v),
m AS (SELECT max(x) AS hi, min(x) AS lo FROM r WHERE r = round(n * 0.9::DOUBLE) OR r = n - round(n * 0.9::DOUBLE) + 1) SELECT o_orderkey, round(greatest(0, least(1, (x - lo) / (hi - lo))), 9) AS scaled FROM v, m""")
def normalize_by_round(spark, sf_dir):
    """Scaled between rounded places of the order, a tenth cut off at both ends."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return st.normalised(o, "o_totalprice", 0.9, by_round=True).select("o_orderkey", F.round("scaled", 9).alias("scaled"))


@query("SELECT s_suppkey, round(exp(-pow((s_acctbal - 4500) / 3000.0::DOUBLE, 2) / 2) / (3000 * sqrt(2 * pi())), 12) AS density FROM supplier")
def gaussian_density(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.round(gaussian(F.col("s_acctbal"), F.lit(4500.0), F.lit(3000.0)), 12).alias("density"))


_CODING = f"(SELECT id, string_agg(CASE WHEN aa = '-' THEN '' WHEN aa < 'G' THEN 'AAC' WHEN aa < 'N' THEN 'GGT' ELSE 'TCC' END, '' ORDER BY pos) AS coding FROM {COLUMNS} GROUP BY 1)"


@query(f"SELECT id, string_agg(CASE WHEN aa = '-' THEN '---' WHEN aa < 'G' THEN 'AAC' WHEN aa < 'N' THEN 'GGT' ELSE 'TCC' END, '' ORDER BY pos) AS codons FROM {COLUMNS} GROUP BY 1")
def codons_under_alignment(spark, sf_dir):
    """The codons of each row laid under its aligned residues; a gap is three."""
    a = alignment(spark, sf_dir).select("id", "seq")
    codon = lambda x: F.when(x == "-", "").when(x < "G", "AAC").when(x < "N", "GGT").otherwise("TCC")
    coding = F.array_join(F.transform(F.split("seq", ""), codon), "")
    return a.select("id", codons_on_gaps(F.col("seq"), coding).alias("codons"))


_SEGMENTS = "(SELECT p_partkey AS segment, p_partkey * 10 AS s, p_partkey * 10 + p_size % 10 AS e FROM part)"


@query(f"SELECT o_orderkey, segment FROM orders JOIN {_SEGMENTS} ON o_orderkey BETWEEN s AND e")
def positions_in_segments(spark, sf_dir):
    """Positions with the segment that holds them; some lie in none."""
    p = table(spark, sf_dir, "part")
    s = p.select(F.col("p_partkey").alias("segment"), (F.col("p_partkey") * 10).alias("s"), (F.col("p_partkey") * 10 + F.col("p_size") % 10).alias("e"))
    return al.first_segment(table(spark, sf_dir, "orders").select("o_orderkey"), s, "o_orderkey", "s", "e").select("o_orderkey", "segment")


@query("SELECT l_orderkey, s, e, coalesce(lag(e) OVER (PARTITION BY l_orderkey ORDER BY s) + 1 = s, true) AS follows FROM (SELECT DISTINCT l_orderkey, l_partkey * 10 AS s, l_partkey * 10 + 9 AS e FROM lineitem)")
def contiguous_blocks(spark, sf_dir):
    """Whether each block of a set begins where the one before it ends."""
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 10).alias("s"), (F.col("l_partkey") * 10 + 9).alias("e")).distinct()
    return b.withColumn("follows", al.contiguous(b, "l_orderkey", "s", "e"))


@query("SELECT p_partkey AS place, p_name AS name, p_size AS size, p_brand AS brand FROM part")
def zipped_tables(spark, sf_dir):
    """Two tables side by side by place; different names at a place would be an error."""
    p = table(spark, sf_dir, "part")
    left = p.select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    right = p.select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return al.zipped(left, right, "place", "name").select("place", "name", "size", F.col("brand_right").alias("brand"))


@query(f"SELECT id, seq FROM {SEQUENCES} WHERE id IN (SELECT member FROM {MEMBERS})")
def records_of_members(spark, sf_dir):
    """The records of everything that is in a cluster."""
    return grouping.records_of(sequences(spark, sf_dir), members(spark, sf_dir))


@query("SELECT o_orderkey, least(o_custkey, o_orderkey) AS a, greatest(o_custkey, o_orderkey) AS b FROM orders")
def canonical_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("bigint").alias("a"), F.col("o_custkey").cast("bigint").alias("b"))
    return pairs.canonical(o, "a", "b")


@query(f"SELECT id, count(*) AS n, CAST(min(pos) AS BIGINT) AS first, CAST(max(pos) AS BIGINT) AS last, string_agg(aa, '' ORDER BY aa) AS residues FROM {COLUMNS} GROUP BY 1")
def shuffled_profile(spark, sf_dir):
    """A profile's rows in a random order: numbered anew without gaps, with the same residues."""
    from seqloom.queries.carriers import columns

    s = stochastic.shuffled_rows(columns(spark, sf_dir).select("id", "pos", "aa"), "id", "pos", 4)
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("bigint").alias("first"), F.max("pos").cast("bigint").alias("last"), F.array_join(F.array_sort(F.collect_list("aa")), "").alias("residues"))


@query("SELECT o_custkey AS tree, concat('#', max(o_orderkey), '#') AS name FROM orders GROUP BY 1")
def reconstructed_roots(spark, sf_dir):
    """Of every tree the record of its highest-numbered inner node."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tree"), F.concat(F.lit("#"), F.col("o_orderkey").cast("string"), F.lit("#")).alias("name"))
    leaves = o.select("tree", F.lit("leaf").alias("name"))
    return trees.internal_root(o.unionByName(leaves), "tree", "name")


@query("SELECT p_partkey AS k, length(p_name) * p_size AS v FROM part WHERE p_size % 2 = 0")
def mapped_function(spark, sf_dir):
    """A plain function over rows; it gives nothing for some."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return mapped(p, lambda r, factor: (r.p_partkey, len(r.p_name) * r.p_size * factor) if r.p_size % 2 == 0 else None, "k bigint, v bigint", 1)


@query("SELECT p_partkey AS k, upper(p_name) AS name FROM part")
def piped_program(spark, sf_dir):
    """Records that go through a program, which reads and writes text."""

    def rows(text: str):
        import pandas as pd

        return pd.DataFrame([line.split("\t") for line in text.splitlines()], columns=["k", "name"]).astype({"k": "int64"})

    upper = Program(("tr", "a-z", "A-Z"), lambda b: "".join(f"{k}\t{n}\n" for k, n in zip(b["p_partkey"], b["p_name"])), rows, "k bigint, name string")
    return piped(table(spark, sf_dir, "part").select("p_partkey", "p_name"), upper)
