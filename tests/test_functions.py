import math

import pytest
from pyspark.sql import functions as F

from seqloom.functions import residues, stats, text, values
from seqloom.functions.ids import dashed, plain_members, plain_pairs, stripped, taxon


def one(spark, column, **row):
    row = row or {"x": 1}
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("r")).head().r


@pytest.mark.parametrize("raw,want", [("  a-b ", "a-b"), ("a@b", "a-b"), ("a@b-c@d", "a-b-c@d"), ("a-b@c", "a-b@c"), ("   ", None), ("", None)])
def test_plain_ids(spark, raw, want):
    assert one(spark, dashed(stripped(F.col("c"))), c=raw) == want


def test_taxon(spark):
    assert one(spark, taxon(F.col("c")), c="Bdu-Orvα1-x") == "Bdu"


def test_pairs_with_hashes_nulls_and_extra_columns(spark):
    rows = spark.createDataFrame(
        [("h1", "b-2", 1.0, 9), (" a@1", "h2 ", 2.0, 9), (None, "b-2", 3.0, 9), ("  ", "b-2", 4.0, 9), ("a-1", "nohash", 5.0, 9)], "seq1 string, seq2 string, score double, a int"
    )
    ids = spark.createDataFrame([("h1", "a-1"), ("h1", "a-1"), ("h2", "b-2"), (None, "x-1")], "hash string, name string")
    got = sorted(tuple(r) for r in plain_pairs(rows, ids, "seq1", "seq2", "score").collect())
    assert got == [("a-1", "b-2", 1.0), ("a-1", "b-2", 2.0), ("a-1", "nohash", 5.0)]
    assert plain_pairs(rows.limit(0), ids, "seq1", "seq2", "score").count() == 0
    m = spark.createDataFrame([(1, "h1"), (1, "b@2"), (2, None)], "grp int, m string")
    assert sorted(tuple(r) for r in plain_members(m, ids, "m", "grp").collect()) == [("a-1", 1), ("b-2", 1)]


def test_text_functions(spark):
    assert one(spark, text.regrep(F.col("c"), r"^(\w)(\w)$", r"\2\1"), c="ab\ncd") == "ba\ndc"
    assert one(spark, text.replace_first(F.col("c"), "a", "$", 2), c="aaa") == "$$a"
    assert one(spark, text.insert_at(F.col("c"), "[0-9]+", "$"), c="a1b22") == "a1$b22$"
    assert one(spark, text.upper_words(F.col("c")), c="ab.cd e_f") == "Ab.cd E_F"
    assert one(spark, text.spaces_for_tabs(F.col("c")), c="a\tbcde\tf") == "a   bcde    f"
    assert one(spark, text.tidy(F.col("c")), c="a  \n\n\n\nb\n\n") == "a\n\nb\n"
    assert one(spark, text.wrap(F.col("c"), 7), c=" aa bb  cc dddddddddd e") == "aa bb\ncc\ndddddddddd\ne"
    assert one(spark, text.middle_ellipsis(F.col("c"), 8), c="abcdefghij") == "abcdef ... ij"
    keys = spark.createDataFrame([("a10",), ("a9",), ("a010b",), ("b1",)], ["c"]).orderBy(text.natural_key(F.col("c")), "c")
    assert [r.c for r in keys.collect()] == ["a9", "a10", "a010b", "b1"]


def test_values(spark):
    assert [one(spark, values.pretty_time(F.lit(s))) for s in (59, 61, 3661, 90061)] == ["59 sec", "1 min, 1 sec", "1 hrs, 1 min, 1 sec", "1 days, 1 hrs, 1 min, 1 sec"]
    assert one(spark, values.pretty_number(F.lit(1234567.0))) == "1.23 M"
    assert one(spark, values.pretty_number(F.lit(999.0), "long")) == "999.0 "
    assert [one(spark, values.money(F.lit(x))) for x in ("$12.5M", "3B", "n/a", "7")] == [12.5e6, 3e9, None, 7.0]
    assert [one(spark, values.support_colour(F.lit(x).cast("double"))) for x in (0.0, 0.5, 1.0, 2.0)] == ["000000", "5757AF", "00AF57", None]
    assert len(one(spark, values.weekdays(F.to_date(F.lit("2024-02-01"))))) == 21


def test_statistics_columns(spark):
    assert abs(one(spark, stats.bit_score(F.lit(10.0))) - 8.472092770757309) < 1e-12
    for z in (-3.0, -0.5, 0.0, 1.96):
        assert abs(one(spark, stats.phi(F.lit(z))) - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-7
    assert one(spark, stats.reflected(F.lit(-3.0), F.lit(0.0), F.lit(2.0))) == pytest.approx(1.0)


def test_residues(spark):
    m = residues.parse_half_matrix(residues.BLOSUM62)
    assert len(m) == 400 and m["A", "R"] == m["R", "A"] == -1 and m["W", "W"] == 11
    assert residues.completed(m)["X", "A"] == -1
    assert one(spark, residues.translated(F.col("c")), c="ATGGCNTAAGGG") == "MX"
    assert one(spark, residues.translated(F.col("c"), False), c="ATGTAAGGGA") == "M*G"
    assert one(spark, residues.translated(F.col("c")), c="") == ""
    assert one(spark, residues.codons_on_gaps(F.col("p"), F.col("c")), p="M-A", c="ATGGCT") == "ATG---GCT"
    assert one(spark, residues.alphabet(F.col("c")), c="acgt-acgx") == "prot"
    assert one(spark, residues.fitness(F.col("c")), c="M" * 400) == 100.0 and one(spark, residues.fitness(F.col("c")), c="A") == 12.5


def test_cut_behind_a_segment(spark):
    df = spark.createDataFrame([("ABCDEFGHIJ", [("M", 1, 3), ("M", 5, 7)])], "seq string, segments array<struct<symbol string, start int, end int>>")
    cut = lambda n, extra: df.select(residues.cut_behind(F.col("seq"), F.col("segments"), n, extra).alias("r")).head().r
    assert (cut(2, 0), cut(1, 1), cut(2, 99), cut(3, 0)) == ("ABCDEFG", "ABCD", "ABCDEFGHIJ", None)


def test_short_codes_tell_collisions(spark):
    from seqloom.functions.ids import short_codes

    ids = spark.createDataFrame([(f"i{n}",) for n in range(40)] + [("i1",), (None,)], "id string")
    assert short_codes(ids, "id").count() == 40
    with pytest.raises(Exception, match="share the code"):
        short_codes(ids, "id", 1).collect()
