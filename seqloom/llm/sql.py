"""The pN_ results in SQL, where SQL can express them over whole tables in reasonable time."""

_NAMES = "names AS (SELECT trim(hash) AS hash, min(trim(name)) AS name FROM id_map WHERE trim(hash) <> '' AND trim(name) <> '' GROUP BY 1)"
_PLAIN = "coalesce({1}.name, regexp_replace({0}, '^([^-@]*)@', '\\1-'))"
_PAIRS = f"""{_NAMES}, raw AS (SELECT nullif(trim(seq1), '') AS x, nullif(trim(seq2), '') AS y, score FROM sim_scores),
plain AS (SELECT {_PLAIN.format('x', 'n1')} AS a, {_PLAIN.format('y', 'n2')} AS b, score FROM raw LEFT JOIN names n1 ON n1.hash = x LEFT JOIN names n2 ON n2.hash = y WHERE x IS NOT NULL AND y IS NOT NULL)"""

P1 = """WITH s AS (SELECT DISTINCT id, upper(regexp_replace(seq, '[^A-Za-z]', '', 'g')) AS s FROM fasta WHERE seq IS NOT NULL),
g AS (SELECT DISTINCT id, substr(s, i, 5) AS g FROM (SELECT id, s, unnest(generate_series(1, length(s) - 4)) AS i FROM s WHERE length(s) >= 5)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), c AS (SELECT x.id AS id1, y.id AS id2, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
SELECT id1, id2 FROM c JOIN n a ON a.id = id1 JOIN n b ON b.id = id2 WHERE 5 * common >= 3 * (a.n + b.n - common)"""

P2 = f"""WITH {_NAMES}, raw AS (SELECT cluster_id, nullif(trim(m), '') AS x FROM (SELECT cluster_id, unnest(cluster) AS m FROM clusters)),
t AS (SELECT DISTINCT cluster_id, {_PLAIN.format('x', 'n1')} AS m FROM raw LEFT JOIN names n1 ON n1.hash = x WHERE x IS NOT NULL),
n AS (SELECT cluster_id, count(*) AS n FROM t GROUP BY 1), c AS (SELECT x.cluster_id AS cluster_id1, y.cluster_id AS cluster_id2, count(*) AS common FROM t x JOIN t y ON x.m = y.m AND x.cluster_id < y.cluster_id GROUP BY 1, 2)
SELECT cluster_id1, cluster_id2 FROM c JOIN n a ON a.cluster_id = cluster_id1 JOIN n b ON b.cluster_id = cluster_id2 WHERE 20 * common >= 8 * (a.n + b.n)"""

P4 = f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM plain WHERE a <> b UNION SELECT b, a FROM plain WHERE a <> b),
r(seq_id, o) AS (SELECT a, a FROM e UNION SELECT r.seq_id, e.b FROM r JOIN e ON r.o = e.a) SELECT seq_id, min(o) AS group_id FROM r GROUP BY 1"""

P5 = f"""WITH {_PAIRS}, p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score FROM plain WHERE a <> b AND score >= 0 AND score <= 1 AND NOT isnan(score) GROUP BY 1, 2),
s AS (SELECT a, b, score FROM p UNION ALL SELECT b, a, score FROM p)
SELECT a AS seq_id, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INTEGER) AS rnk, b AS partner_id FROM s QUALIFY rnk <= 5"""

#: Links counted from the pairs of :data:`P2`; the class is the smallest record of equal members.
P2_LINKS = f"""WITH {_NAMES}, raw AS (SELECT cluster_id, nullif(trim(m), '') AS x FROM (SELECT cluster_id, unnest(cluster) AS m FROM clusters)),
t AS (SELECT DISTINCT cluster_id, {_PLAIN.format('x', 'n1')} AS m FROM raw LEFT JOIN names n1 ON n1.hash = x WHERE x IS NOT NULL),
k AS (SELECT cluster_id, string_agg(m, chr(31) ORDER BY m) AS k, count(*) AS n FROM t GROUP BY 1), f AS ({P2})
SELECT cluster_id, min(cluster_id) OVER (PARTITION BY k) AS class_id, (SELECT count(*) FROM f WHERE cluster_id1 = k.cluster_id OR cluster_id2 = k.cluster_id) AS links FROM k"""

#: What decoding must give back.
P6_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

_BLANK = r"\s\x{0b}\x{a0}\x{ad}\x{85}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}\x{00}-\x{1f}\x{7f}-\x{9f}"
#: Statistics of every visible text, and scores from exact ranks in its language and in the corpus.
P8_SCORES = rf"""WITH w AS (SELECT list(DISTINCT lower(word)) AS w FROM common_words WHERE word IS NOT NULL),
t AS (SELECT doc_id, CASE WHEN regexp_matches(trim(lang), '^[A-Za-z]{{2,3}}([-_].*)?$') THEN lower(regexp_extract(trim(lang), '^([A-Za-z]{{2,3}})', 1)) ELSE 'und' END AS language, length(regexp_replace(text, '[{_BLANK}]+', '', 'g')) AS visible,
 regexp_extract_all(text, '\p{{L}}+') AS words, list_filter(regexp_split_to_array(text, '[\r\n]'), lambda l: regexp_matches(l, '[^\s\x{{0b}}\x{{a0}}\x{{2000}}-\x{{200f}}\x{{3000}}\x{{feff}}]')) AS lines FROM documents),
c AS (SELECT doc_id, language, visible, len(words)::DOUBLE AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::DOUBLE AS letters, len(list_filter(words, lambda x: list_contains(w.w, lower(x)))) AS hits,
 len(lines) AS n_lines, len(list_filter(lines, lambda l: regexp_matches(l, '[.!?…][''"”’)»]*[ \t\x{{a0}}]*$'))) AS ended FROM t, w WHERE visible > 0),
s AS (SELECT doc_id, language, visible, n_words, CASE WHEN n_words > 0 THEN round(letters / n_words, 6) ELSE 0 END AS mean_word_length, round(1 - letters / visible, 6) AS symbol_share,
 CASE WHEN n_lines > 0 THEN round(ended / n_lines, 6) ELSE 0 END AS punctuated_lines, CASE WHEN n_words > 0 THEN round(hits / n_words, 6) ELSE 0 END AS common_share FROM c),
v AS (SELECT doc_id, language, unnest([-symbol_share, punctuated_lines, common_share]) AS value, unnest([1, 2, 3]) AS stat FROM s),
r AS (SELECT doc_id, greatest(-ln(count(*) OVER (PARTITION BY language, stat ORDER BY value) / count(*) OVER (PARTITION BY language, stat)), -ln(count(*) OVER (PARTITION BY stat ORDER BY value) / count(*) OVER (PARTITION BY stat))) AS tail FROM v)
SELECT s.*, round(o.score, 6) AS outlier_score FROM s JOIN (SELECT doc_id, sum(tail) AS score FROM r GROUP BY 1) o USING (doc_id)"""

#: Groups by what the pairs of :data:`P1` link, directly or over others.
P1_GROUPS = f"""WITH RECURSIVE f AS ({P1}), e AS (SELECT id1 AS a, id2 AS b FROM f UNION SELECT id2, id1 FROM f), v AS (SELECT DISTINCT id FROM fasta WHERE length(regexp_replace(seq, '[^A-Za-z]', '', 'g')) >= 5),
r(id, o) AS (SELECT id, id FROM v UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a) SELECT id, min(o) AS group_id FROM r GROUP BY 1"""

#: Those pairs of :data:`P2` of which one record has a name and the other has none.
P2_BETWEEN = f"""WITH p AS ({P2}), n AS (SELECT DISTINCT cluster_id FROM clusters WHERE cluster_name IS NOT NULL)
SELECT CASE WHEN a IN (SELECT cluster_id FROM n) THEN a ELSE b END AS cluster_id1, CASE WHEN a IN (SELECT cluster_id FROM n) THEN b ELSE a END AS cluster_id2 FROM (SELECT cluster_id1 AS a, cluster_id2 AS b FROM p)
WHERE (a IN (SELECT cluster_id FROM n)) <> (b IN (SELECT cluster_id FROM n))"""

P7_INVARIANTS = "SELECT count(*) AS keys, CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS wrong FROM documents"

ORACLE = {"p2_between": P2_BETWEEN, "p7_invariants": P7_INVARIANTS, "p8_scores": P8_SCORES, "p1_groups": P1_GROUPS, "p6_decoded": P6_DECODED, "p2_links": P2_LINKS, "p1_found": P1, "p2_found": P2, "p4_found": P4, "p5_found": P5}
