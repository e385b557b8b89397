"""Identity of aligned rows, gaps, spans and indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.residues import BLOSUM62, degapped, parse_half_matrix, translated
from seqloom.operators import alignment as al
from seqloom.operators import pairs as pr
from seqloom.operators.pairs import all_pairs, incremental_pairs, pairs_between, pairs_within
from seqloom.queries.carriers import COLUMNS, LETTERS, SEGMENTS, SEQUENCES, TOPOLOGY, alignment, columns, segments_topology, sequences, topology
from seqloom.queries.registry import query, table

MATRIX = parse_half_matrix(BLOSUM62)
MATRIX_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {v})" for (a, b), v in sorted(MATRIX.items())) + ") AS mat(aa1, aa2, m)"

_PAIRS = f"""FROM {COLUMNS} x JOIN {COLUMNS} y ON x.pos = y.pos AND x.id < y.id WHERE NOT (x.aa = '-' AND y.aa = '-') GROUP BY 1, 2"""


@query(f"""SELECT id1, id2, identical, alike, compared, round(identical / compared, 6) AS identity, round(alike / compared, 6) AS similarity FROM (
SELECT x.id AS id1, y.id AS id2, CAST(count(*) FILTER (WHERE x.aa = y.aa) AS INTEGER) AS identical,
 CAST(count(*) FILTER (WHERE x.aa <> '-' AND y.aa <> '-' AND (x.aa = y.aa OR coalesce(m, -1) >= 0)) AS INTEGER) AS alike, CAST(count(*) AS INTEGER) AS compared
FROM {COLUMNS} x JOIN {COLUMNS} y ON x.pos = y.pos AND x.id < y.id LEFT JOIN {MATRIX_SQL} ON aa1 = x.aa AND aa2 = y.aa
WHERE NOT (x.aa = '-' AND y.aa = '-') GROUP BY 1, 2)""")
def msa_identity_pairs(spark, sf_dir):
    p = all_pairs(alignment(spark, sf_dir), "id", "seq", LETTERS, MATRIX).where("compared > 0")
    return p.select("id1", "id2", "identical", "alike", "compared", F.round(F.col("identical") / F.col("compared"), 6).alias("identity"), F.round(F.col("alike") / F.col("compared"), 6).alias("similarity"))


@query(f"""SELECT x.id AS id1, y.id AS id2, CAST(count(*) FILTER (WHERE x.aa = y.aa) AS INTEGER) AS identical, CAST(count(*) AS INTEGER) AS compared
FROM {COLUMNS} x JOIN {COLUMNS} y ON x.pos = y.pos WHERE x.label % 2 = 0 AND y.label % 2 = 1 AND NOT (x.aa = '-' AND y.aa = '-') GROUP BY 1, 2""")
def msa_identity_between_families(spark, sf_dir):
    a = alignment(spark, sf_dir)
    p = pairs_between(a.where("label % 2 = 0"), a.where("label % 2 = 1"), "id", "seq", LETTERS)
    return p.where("compared > 0").select("id1", "id2", "identical", "compared")


@query(f"""SELECT label, count(*) AS pairs, round(avg(identical / filled), 6) AS identity FROM (SELECT x.label, x.id AS a, y.id AS b,
 count(*) FILTER (WHERE x.aa = y.aa AND x.aa <> '-')::DOUBLE AS identical, count(*) FILTER (WHERE x.aa <> '-' AND y.aa <> '-') AS filled
FROM {COLUMNS} x JOIN {COLUMNS} y ON x.pos = y.pos AND x.id < y.id AND x.label = y.label GROUP BY 1, 2, 3) WHERE filled > 0 GROUP BY 1""")
def group_mean_identity(spark, sf_dir):
    p = pairs_within(alignment(spark, sf_dir), "label", "id", "seq", LETTERS).where("filled > 0")
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("identical") / F.col("filled")), 6).alias("identity"))


@query(f"""SELECT id1, id2, round(identical / own, 6) AS identity FROM (SELECT x.id AS id1, y.id AS id2, count(*) FILTER (WHERE x.aa = y.aa AND x.aa <> '-')::DOUBLE AS identical,
 count(*) FILTER (WHERE x.aa <> '-') AS own FROM {COLUMNS} x JOIN {COLUMNS} y ON x.pos = y.pos AND x.id < y.id GROUP BY 1, 2) WHERE own > 0""")
def identity_asymmetric(spark, sf_dir):
    """Identity over the residues of the first of two rows, for all pairs."""
    a = alignment(spark, sf_dir)
    own = a.select(F.col("id").alias("id1"), F.length(degapped(F.col("seq"))).alias("own")).where("own > 0")
    return all_pairs(a, "id", "seq", LETTERS).join(own, "id1").select("id1", "id2", F.round(F.col("identical") / F.col("own"), 6).alias("identity"))


_ALIGNED = f"(SELECT x.id AS id1, y.id AS id2, x.pos AS pos, x.aa AS aa1, y.aa AS aa2 FROM {COLUMNS} x JOIN {COLUMNS} y ON x.pos = y.pos AND x.id < y.id)"


@query(f"""WITH a AS {_ALIGNED}, b AS (SELECT *, aa1 = '-' OR aa2 = '-' AS gapped, coalesce(lag(aa1 = '-' OR aa2 = '-') OVER (PARTITION BY id1, id2 ORDER BY pos), true) AS prev FROM a),
r AS (SELECT id1, id2, CAST(sum(CASE WHEN gapped AND prev THEN 0 WHEN gapped THEN -5 ELSE coalesce(p.m, 0) END) AS BIGINT) AS raw FROM b LEFT JOIN {MATRIX_SQL.replace('AS mat', 'AS p')} ON p.aa1 = b.aa1 AND p.aa2 = b.aa2 GROUP BY 1, 2),
o AS (SELECT id, CAST(coalesce(sum(m), 0) AS BIGINT) AS own FROM {COLUMNS} c LEFT JOIN {MATRIX_SQL} ON aa1 = aa AND aa2 = aa GROUP BY 1)
SELECT id1, id2, raw, x.own AS self1, y.own AS self2, CASE WHEN x.own <> 0 AND y.own <> 0 THEN round((raw / x.own + raw / y.own) / 2, 9) END AS score FROM r JOIN o x ON x.id = id1 JOIN o y ON y.id = id2""")
def affine_gap_score(spark, sf_dir):
    """Every pair of rows: the raw score, those of the rows with themselves, and the score over their mean."""
    s = pr.scored_pairs(alignment(spark, sf_dir), "id", "seq", pr.affine(MATRIX, -5, 0), "raw double, self1 double, self2 double")
    n = (F.try_divide("raw", "self1") + F.try_divide("raw", "self2")) / 2
    return s.select("id1", "id2", *[F.col(c).cast("bigint").alias(c) for c in ("raw", "self1", "self2")], F.round(n, 9).alias("score"))


_BITS = """round((0.252::DOUBLE * (t + (t / n) * (1 - g / r) * g) - ln(0.035::DOUBLE)) / ln(2) / (n + g), 6) AS bits"""
_SUMS = "count(*) FILTER (WHERE a.aa1 <> '-' AND a.aa2 <> '-') AS n, count(*) FILTER (WHERE a.aa1 = '-' OR a.aa2 = '-') AS g, count(*) FILTER (WHERE a.aa1 <> '-') + count(*) FILTER (WHERE a.aa2 <> '-') AS r"
_TILE = "total double, matches bigint, gaps bigint, residues bigint"


@query(f"""WITH a AS {_ALIGNED}, s AS (SELECT a.id1, a.id2, coalesce(sum(m) FILTER (WHERE a.aa1 <> '-' AND a.aa2 <> '-'), 0)::DOUBLE AS t, {_SUMS}
 FROM a LEFT JOIN {MATRIX_SQL} ON mat.aa1 = a.aa1 AND mat.aa2 = a.aa2 GROUP BY 1, 2) SELECT id1, id2, n AS matches, g AS gaps, {_BITS} FROM s""")
def alignment_bits(spark, sf_dir):
    s = pr.scored_pairs(alignment(spark, sf_dir), "id", "seq", pr.substitution(MATRIX), _TILE)
    return al.bits_of(s).select("id1", "id2", "matches", "gaps", F.round("bits", 6).alias("bits"))


#: Scores within a membrane: those of the matrix doubled.
_INNER = {k: 2 * v for k, v in MATRIX.items()}


@query(f"""WITH c AS (SELECT c.id, c.pos, c.aa, t.symbol FROM {COLUMNS} c JOIN {TOPOLOGY} t ON t.id = c.id AND t.pos = c.pos), a AS (SELECT x.id AS id1, y.id AS id2, x.aa AS aa1, y.aa AS aa2, x.symbol = 'M' AND y.symbol = 'M' AS inner_ FROM c x JOIN c y ON x.pos = y.pos AND x.id < y.id),
s AS (SELECT a.id1, a.id2, coalesce(sum(CASE WHEN inner_ THEN 2 * m ELSE m END) FILTER (WHERE a.aa1 <> '-' AND a.aa2 <> '-'), 0)::DOUBLE AS t, {_SUMS}
 FROM a LEFT JOIN {MATRIX_SQL} ON mat.aa1 = a.aa1 AND mat.aa2 = a.aa2 GROUP BY 1, 2) SELECT id1, id2, n AS matches, g AS gaps, {_BITS} FROM s""")
def membrane_bits(spark, sf_dir):
    """As alignment_bits, with a second matrix for columns that lie in a membrane in both rows."""
    t = topology(spark, sf_dir).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "").alias("t"))
    rows = alignment(spark, sf_dir).join(t, "id").select("id", F.concat_ws("|", "seq", "t").alias("row"))
    s = pr.scored_pairs(rows, "id", "row", pr.substitution(MATRIX, _INNER), _TILE)
    return al.bits_of(s).select("id1", "id2", "matches", "gaps", F.round("bits", 6).alias("bits"))


@query(f"""WITH w AS (SELECT id, pos, symbol, pos - row_number() OVER (PARTITION BY id, symbol ORDER BY pos) AS island FROM {TOPOLOGY})
SELECT id, concat('TMD', row_number() OVER (PARTITION BY id ORDER BY min(pos))) AS name, min(pos) AS "start", max(pos) + 1 AS "end" FROM w WHERE symbol = 'M' GROUP BY id, island""")
def tmd_spans(spark, sf_dir):
    return al.spans(topology(spark, sf_dir), "id", "pos", "symbol", "M")


@query(f"""WITH w AS (SELECT id, pos, symbol, pos - row_number() OVER (PARTITION BY id, symbol ORDER BY pos) AS island FROM {TOPOLOGY})
SELECT id, min(pos) AS "start", max(pos) + 1 AS "end" FROM w WHERE symbol = 'o' GROUP BY id, island""")
def non_tmd_spans(spark, sf_dir):
    t = topology(spark, sf_dir)
    features = al.spans(t, "id", "pos", "symbol", "M")
    lengths = t.groupBy("id").agg((F.max("pos") + 1).alias("length"))
    return al.complement(features, lengths, "id", "length")


@query(f"""WITH w AS (SELECT id, pos, symbol, pos - row_number() OVER (PARTITION BY id, symbol ORDER BY pos) AS island FROM {SEGMENTS}),
r AS (SELECT id, max(pos) + 1 AS e, row_number() OVER (PARTITION BY id ORDER BY min(pos)) AS k, count(*) OVER (PARTITION BY id) AS n FROM w WHERE symbol = 'M' GROUP BY id, island),
q AS (SELECT id, string_agg(aa, '' ORDER BY pos) AS seq FROM {COLUMNS} GROUP BY 1) SELECT id, left(seq, least(64, e + 20)) AS seq FROM r JOIN q USING (id) WHERE k = 4 AND n = 4""")
def four_tm_cut(spark, sf_dir):
    """Rows with exactly four spans, cut 20 behind the end of the fourth, within their length."""
    s = al.spans(segments_topology(spark, sf_dir), "id", "pos", "symbol", "M")
    return al.cut_at_span(alignment(spark, sf_dir).select("id", "seq"), s, "id", "seq", 4, 20, exactly=True)


@query(f"""WITH w AS (SELECT id, pos, symbol, pos - row_number() OVER (PARTITION BY id, symbol ORDER BY pos) AS island FROM {SEGMENTS}),
r AS (SELECT id, max(pos) + 1 AS e, row_number() OVER (PARTITION BY id ORDER BY min(pos)) AS k FROM w WHERE symbol = 'M' GROUP BY id, island),
q AS (SELECT id, string_agg(aa, '' ORDER BY pos) AS seq FROM {COLUMNS} GROUP BY 1) SELECT id, left(seq, e) AS seq FROM r JOIN q USING (id) WHERE k = 2""")
def second_segment_cut(spark, sf_dir):
    """Rows cut at the end of their second span; rows with fewer are left out."""
    s = al.spans(segments_topology(spark, sf_dir), "id", "pos", "symbol", "M")
    return al.cut_at_span(alignment(spark, sf_dir).select("id", "seq"), s, "id", "seq", 2)


@query(f"""SELECT id, pos, aa, CAST(CASE WHEN aa <> '-' THEN sum(CASE WHEN aa <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) - 1 END AS BIGINT) AS residue FROM {COLUMNS}""")
def ungapped_index(spark, sf_dir):
    return al.ungapped_index(columns(spark, sf_dir).select("id", "pos", "aa"), "id", "pos", "aa")


@query(f"""WITH c AS (SELECT pos, 2 * count(*) FILTER (WHERE symbol = 'M') >= count(*) AS membrane FROM {TOPOLOGY} GROUP BY 1) SELECT pos, membrane FROM c""")
def membrane_columns(spark, sf_dir):
    from seqloom.operators.pssm import membrane_columns as vote

    return vote(topology(spark, sf_dir))


@query(f"""WITH c AS (SELECT id, pos, symbol FROM {TOPOLOGY}), r AS (SELECT id, symbol, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY id, symbol ORDER BY pos) AS i FROM c) GROUP BY id, symbol, i),
k AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY s) = 1 OR e - s >= 3 THEN symbol END AS kept FROM r),
f AS (SELECT id, s, e, last_value(kept IGNORE NULLS) OVER (PARTITION BY id ORDER BY s) AS symbol FROM k),
n AS (SELECT *, CASE WHEN lag(symbol) OVER (PARTITION BY id ORDER BY s) IS DISTINCT FROM symbol THEN 1 ELSE 0 END AS new FROM f),
g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY s) AS island FROM n)
SELECT id, any_value(symbol) AS symbol, min(s) AS "start", max(e) AS "end" FROM g GROUP BY id, island""")
def smoothed_segments(spark, sf_dir):
    """Runs of a topology in which runs of one or two columns are taken up by the run before them."""
    return al.smoothed(topology(spark, sf_dir), "id", "pos", "symbol", 3)


@query(f"""WITH t AS (SELECT id, translate(left(seq, 3 * (length(seq) // 3)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS c FROM {SEQUENCES} WHERE length(seq) >= 3),
k AS (SELECT id, c, generate_series AS i FROM t, generate_series(1, 20000) WHERE generate_series * 3 <= length(c)),
a AS (SELECT id, i, substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', 1 + 16 * (strpos('TCAG', substr(c, 3 * i - 2, 1)) - 1) + 4 * (strpos('TCAG', substr(c, 3 * i - 1, 1)) - 1) + strpos('TCAG', substr(c, 3 * i, 1)) - 1, 1) AS aa FROM k)
SELECT id, split_part(string_agg(aa, '' ORDER BY i), '*', 1) AS protein FROM a GROUP BY id""")
def translate_codons(spark, sf_dir):
    """Sequences folded onto the four bases, as protein up to the first stop."""
    s = sequences(spark, sf_dir).where("length(seq) >= 3")
    coding = F.translate(F.col("seq"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    return s.select("id", translated(coding).alias("protein"))


@query("""SELECT least(a.vec_id, b.vec_id) AS id1, greatest(a.vec_id, b.vec_id) AS id2 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
WHERE a.vec_id % 10 = 0 AND (b.vec_id % 10 <> 0 OR a.vec_id < b.vec_id)""")
def incremental_pairs_added(spark, sf_dir):
    """The pairs that an update adds: ids divisible by ten are new."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return incremental_pairs(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), "vec_id")


_X = "(SELECT id, pos, CASE WHEN abs(x) >= 0.01 THEN x END AS x FROM (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))"
_PROFILE = "distance double, matched bigint, left_only bigint, right_only bigint"


def _profiles(spark, sf_dir):
    """Rows of numbers; those next to zero are missing."""
    x = F.transform("embedding", lambda v: F.when(F.abs(v.cast("double")) >= 0.01, v.cast("double")).otherwise(F.lit(float("nan"))))
    return pr.scored_pairs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x")), "id", "x", pr.profiles, _PROFILE)


@query(f"SELECT a.id AS id1, b.id AS id2, round(coalesce(sum(abs(a.x - b.x)), 0), 4) AS distance FROM {_X} a JOIN {_X} b ON a.pos = b.pos AND a.id < b.id GROUP BY 1, 2")
def profile_distance(spark, sf_dir):
    """All pairs of profiles: the summed differences over the columns that both have."""
    return _profiles(spark, sf_dir).select("id1", "id2", F.round("distance", 4).alias("distance"))


@query(f"""SELECT a.id AS id1, b.id AS id2, round(coalesce(sum(1 - abs(a.x - b.x)), 0) / (count(b.x) + count(*) FILTER (WHERE a.x IS NOT NULL AND b.x IS NULL)), 6) AS similarity
FROM {_X} a JOIN {_X} b ON a.pos = b.pos AND a.id < b.id GROUP BY 1, 2""")
def profile_similarity(spark, sf_dir):
    """All pairs of profiles, over the columns of the second and those that only the first has."""
    s = (F.col("matched") - F.col("distance")) / (F.col("matched") + F.col("right_only") + F.col("left_only"))
    return _profiles(spark, sf_dir).select("id1", "id2", F.round(s, 6).alias("similarity"))


@query(f"""WITH s AS (SELECT a.id AS id1, b.id AS id2, sum(1 - abs(a.x - b.x)) AS t, count(*) FILTER (WHERE a.x IS NOT NULL AND b.x IS NOT NULL) AS n, count(*) FILTER (WHERE a.x IS NULL OR b.x IS NULL) AS g, count(a.x) + count(b.x) AS r
FROM {_X} a JOIN {_X} b ON a.pos = b.pos AND a.id < b.id GROUP BY 1, 2) SELECT id1, id2, round((t + t / n * (1 - g / r) * g) / (n + g), 5) AS similarity FROM s""")
def gap_bonus_similarity(spark, sf_dir):
    """All pairs of profiles, with a bonus for gaps."""
    t, n, r = F.col("matched") - F.col("distance"), F.col("matched"), 2 * F.col("matched") + F.col("left_only") + F.col("right_only")
    g = F.lit(64) - n
    full = t + F.try_divide(t, n) * (1 - F.try_divide(g, r)) * g
    return _profiles(spark, sf_dir).select("id1", "id2", F.round(full / (n + g), 5).alias("similarity"))


@query(f"""WITH c AS {COLUMNS}, k AS (SELECT label, pos, aa FROM (SELECT label, pos, aa, count(*) AS n FROM c GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY label, pos ORDER BY n DESC, aa) = 1),
s AS (SELECT c.label, c.id, count(*) FILTER (WHERE c.aa = k.aa AND c.aa <> '-') / count(*) FILTER (WHERE c.aa <> '-' OR k.aa <> '-') AS identity FROM c JOIN k ON k.label = c.label AND k.pos = c.pos GROUP BY 1, 2)
SELECT label, count(*) AS members, round(avg(identity), 6) AS identity FROM s GROUP BY 1""")
def ancestor_identity(spark, sf_dir):
    """The mean identity of a family's members with its consensus, which stands for their ancestor."""
    c = columns(spark, sf_dir)
    k = al.consensus(c, ["label"], "pos", "aa").select("label", "pos", F.col("aa").alias("root"))
    s = c.join(k, ["label", "pos"]).groupBy("label", "id").agg(
        (F.count(F.when((F.col("aa") == F.col("root")) & (F.col("aa") != "-"), 1)) / F.count(F.when((F.col("aa") != "-") | (F.col("root") != "-"), 1))).alias("identity")
    )
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("identity"), 6).alias("identity"))


@query(f"""SELECT label, pos, symbol, n AS votes FROM (SELECT label, pos, CASE WHEN aa = '-' THEN '.' WHEN aa < 'L' THEN 'A' ELSE 'Z' END AS symbol, count(*) AS n FROM {COLUMNS} GROUP BY 1, 2, 3)
QUALIFY row_number() OVER (PARTITION BY label, pos ORDER BY n DESC, symbol) = 1""")
def consensus_by_family(spark, sf_dir):
    """The most frequent of three residue classes in every column of a family."""
    kind = F.when(F.col("aa") == "-", ".").when(F.col("aa") < "L", "A").otherwise("Z")
    return al.consensus(columns(spark, sf_dir).withColumn("symbol", kind), ["label"], "pos", "symbol")


@query(f"""SELECT CASE WHEN sum(length(regexp_replace(seq, '[^ACGT]', '', 'g'))) / sum(length(seq)) > 0.9 THEN 'nucl' ELSE 'prot' END AS alphabet
FROM (SELECT id, seq, sum(length(seq)) OVER (ORDER BY id) - length(seq) AS before FROM {SEQUENCES} WHERE seq <> '') WHERE before < 1000""")
def file_alphabet(spark, sf_dir):
    return al.leading_alphabet(sequences(spark, sf_dir), "seq", "id")
