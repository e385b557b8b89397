"""The chain from an alignment to position-specific scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.residues import matrix_table
from seqloom.operators import pssm
from seqloom.queries.alignments import MATRIX, MATRIX_SQL
from seqloom.queries.carriers import COLUMNS, columns
from seqloom.queries.registry import query

PRIORS_SQL = "(VALUES " + ", ".join(f"('{a}', {p}::DOUBLE)" for a, p in sorted(pssm.PRIORS.items())) + ") AS pr(aa, prior)"

_WEIGHTS = f"""c AS {COLUMNS}, n AS (SELECT pos, aa, count(*) AS n FROM c GROUP BY 1, 2), k AS (SELECT pos, count(*) AS kinds, coalesce(sum(n) FILTER (WHERE aa <> '-'), 0) AS filled FROM n GROUP BY 1),
w AS (SELECT c.id, sum(CASE WHEN filled >= 2 THEN 1.0::DOUBLE / (kinds * n.n) ELSE 0 END) AS w FROM c JOIN n ON c.pos = n.pos AND c.aa = n.aa JOIN k ON k.pos = c.pos GROUP BY 1),
weights AS (SELECT id, w / sum(w) OVER () AS weight FROM w)"""
_FREQ = f"""{_WEIGHTS}, f AS (SELECT pos, aa, sum(weight) AS f FROM c JOIN weights USING (id) GROUP BY 1, 2),
freq AS (SELECT p.pos, pr.aa, prior, coalesce(f, 0) AS freq FROM (SELECT DISTINCT pos FROM c) p CROSS JOIN {PRIORS_SQL} LEFT JOIN f ON f.pos = p.pos AND f.aa = pr.aa)"""


def _rows(spark, sf_dir):
    c = columns(spark, sf_dir).select("id", "pos", "aa")
    priors = pssm.priors_table(spark)
    return c, priors, pssm.sequence_weights(c)


@query(f"WITH {_WEIGHTS} SELECT id, round(weight, 9) AS weight FROM weights")
def seq_weights(spark, sf_dir):
    return _rows(spark, sf_dir)[2].select("id", F.round("weight", 9).alias("weight"))


@query(f"WITH {_FREQ} SELECT pos, aa, round(freq, 7) AS freq FROM freq")
def column_freqs(spark, sf_dir):
    c, priors, w = _rows(spark, sf_dir)
    return pssm.column_frequencies(c, w, priors).select("pos", "aa", F.round("freq", 7).alias("freq"))


@query(f"WITH {_FREQ} SELECT pos, aa, round((freq + prior) / 2, 7) AS freq FROM freq")
def prior_freqs(spark, sf_dir):
    c, priors, w = _rows(spark, sf_dir)
    return pssm.corrected(pssm.column_frequencies(c, w, priors), priors).select("pos", "aa", F.round("freq", 7).alias("freq"))


@query(f"""WITH {_FREQ}, mixed AS (SELECT pos, aa, prior, (freq + prior) / 2 AS freq FROM freq), subs AS (SELECT pos, aa1 AS aa, sum(freq * m) AS s FROM mixed JOIN {MATRIX_SQL} ON aa2 = aa GROUP BY 1, 2)
SELECT mixed.pos, mixed.aa, round(2 * log2(freq / prior) + coalesce(s, 0), 4) AS score FROM mixed LEFT JOIN subs ON subs.pos = mixed.pos AND subs.aa = mixed.aa""")
def pssm_lod(spark, sf_dir):
    c, priors, w = _rows(spark, sf_dir)
    return pssm.log_odds(pssm.corrected(pssm.column_frequencies(c, w, priors), priors), matrix_table(spark, MATRIX))


_LOD = f"""{_FREQ}, mixed AS (SELECT pos, aa, prior, (freq + prior) / 2 AS freq FROM freq), subs AS (SELECT pos, aa1 AS aa, sum(freq * m) AS s FROM mixed JOIN {MATRIX_SQL} ON aa2 = aa GROUP BY 1, 2),
lod AS (SELECT mixed.pos, mixed.aa, round(2 * log2(freq / prior) + coalesce(s, 0), 4) AS score FROM mixed LEFT JOIN subs ON subs.pos = mixed.pos AND subs.aa = mixed.aa)"""


@query(f"""WITH {_LOD}, v AS (SELECT x.pos AS p1, y.pos AS p2, sum(x.score * y.score) AS v FROM lod x JOIN lod y USING (aa) GROUP BY 1, 2),
spans AS (SELECT p1, sum(v) OVER d AS s, count(*) OVER d AS n FROM v WINDOW d AS (PARTITION BY p2 - p1 ORDER BY p1 ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT p1 AS start1, round(max(s), 4) AS best FROM spans WHERE n = 5 GROUP BY 1""")
def pssm_windows(spark, sf_dir):
    """The best window of five columns of the profile against itself, for every start."""
    lod = pssm_lod(spark, sf_dir)
    w = pssm.window_products(lod, lod)
    return w.groupBy("start1").agg(F.round(F.max("score"), 4).alias("best"))


@query(f"""WITH {_LOD}, r AS (SELECT id, pos, CAST(sum(CASE WHEN aa <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) - 1 AS BIGINT) AS residue, aa AS own FROM c)
SELECT id, residue AS pos, lod.aa, score FROM r JOIN lod ON lod.pos = r.pos WHERE own <> '-'""")
def residue_profiles(spark, sf_dir):
    """The profile of the alignment for each row's own residues."""
    from seqloom.operators.alignment import residue_scores

    return residue_scores(pssm_lod(spark, sf_dir), columns(spark, sf_dir).select("id", "pos", "aa"))
