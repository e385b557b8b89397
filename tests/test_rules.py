import random
import zipfile

import pytest
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.functions import values as vl
from seqloom.functions.residues import reading_frame
from seqloom.operators import alignment, dedup, graphs, grouping, orthologs, pairs, statistics
from seqloom.queries import QUERIES, SQL
from seqloom.sinks import writers
from seqloom.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_no_query_with_sql_is_empty():
    duckdb = pytest.importorskip("duckdb")
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    assert [n for n, sql in SQL.items() if not con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]] == []
    assert set(SQL) <= set(QUERIES)


def test_routes_and_their_error(spark):
    df = spark.createDataFrame([("ab",), ("bc",)], "t string")
    assert rows(df.select(tx.routed(F.col("t"), [("^a", 1), ("c", 2)]))) == [(1,), (2,)]
    with pytest.raises(Exception, match="no route"):
        df.select(tx.routed(F.col("t"), [("^a", 1)])).collect()


def test_commands_of_a_history(spark):
    c = ["ls -la", "ls | wc", "cat x", "grep ls", ":; head x", "lsof", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(c)], "i int, c string")
    got = {r.i: r.k for r in df.select("i", tx.kept_command(F.col("c")).alias("k")).collect()}
    assert got == {0: None, 1: "ls | wc", 2: None, 3: "grep ls", 4: "head x", 5: None, 6: None}


def test_callbacks_encodings_and_dates(spark):
    df = spark.createDataFrame([("a1b22", "cafÃ©", "03/01/2026"), (None, "café", "n/a"), ("x", "日本", "")], "t string, e string, d string")
    assert rows(df.where("t is not null").select(tx.replaced_by(F.col("t"), "[0-9]+", lambda m: f"<{int(m[0]) * 2}>"))) == [("a<2>b<44>",), ("x",)]
    assert sorted(r[0] for r in df.select(tx.repaired_encoding(F.col("e"))).collect()) == ["café", "café", "日本"]
    assert [r[0] for r in df.select(vl.epoch(F.col("d"))).collect()] == [1772323200, None, None]
    assert df.select(vl.contrast_colour(F.lit(21))).head()[0] == vl.CONTRAST[1]
    red = df.limit(1).select(vl.jittered_colour(F.lit(250), F.lit(0), F.lit(9), F.lit("k"))).head()[0]
    assert len(red) == 7 and int(red[1:3], 16) >= 230 and int(red[3:5], 16) <= 20


def test_reading_frame_and_unique_names_fail_loudly(spark):
    df = spark.createDataFrame([("ACG", "a"), ("ACGT", "a")], "s string, n string")
    assert df.where("s = 'ACG'").select(reading_frame(F.col("s"))).head()[0] == "ACG"
    with pytest.raises(Exception, match="no multiple of three"):
        df.select(reading_frame(F.col("s"))).collect()
    with pytest.raises(Exception, match="repeated name"):
        dedup.unique_names(df, "n").collect()


def test_greedy_rules_against_plain_loops(spark):
    rng = random.Random(3)
    likes = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    kept = []
    for i in range(40):
        if not any((k, i) in likes for k in kept):
            kept.append(i)
    r = spark.range(40).withColumnRenamed("id", "n")
    got = dedup.greedy_unlike(r, spark.createDataFrame(list(likes), "a bigint, b bigint"), "n")
    assert [x[0] for x in rows(got)] == kept
    assert dedup.greedy_unlike(r, spark.createDataFrame([], "a bigint, b bigint"), "n").count() == 40

    lists = [(i, rng.sample("abcdefghijklmnopqrst", rng.randint(1, 3))) for i in range(12)]
    groups = []
    for i, ms in lists:
        found = next((g for m in ms for g in groups if m in g[1]), None)
        if found:
            found[1].update(ms)
        else:
            groups.append((i, set(ms)))
    got = dedup.first_match_groups(spark.createDataFrame(lists, "i int, ms array<string>"), "i", "ms")
    assert rows(got) == sorted((i, m) for i, g in groups for m in g)

    hits = [(i, rng.randrange(3)) for i in range(20)]
    want, left = [], 0
    for i, h in hits:
        if left:
            left -= 1
        else:
            now, left = i, h
        want.append((i, now))
    assert rows(dedup.skip_groups(spark.createDataFrame(hits, "i int, h int"), "i", "h")) == want


def test_chunks_and_loads(spark):
    df = spark.range(23)
    assert sorted(r["count"] for r in dedup.chunks(df, 5, "id").groupBy("chunk").count().collect()) == [4, 4, 5, 5, 5]
    assert [r.chunk for r in dedup.chunks(df, 5, "id").orderBy("id").collect()] == [1] * 5 + [2] * 5 + [3] * 5 + [4] * 4 + [5] * 4
    shares = dedup.by_load(df, 4, F.col("id"), "id").groupBy("share").agg(F.sum("id").alias("s")).collect()
    assert len(shares) == 4 and max(r.s for r in shares) - min(r.s for r in shares) <= 23


def test_scored_pairs_agree_with_the_joined_form(spark):
    rng = random.Random(8)
    matrix = {(a, b): rng.randrange(-3, 5) for a in "ACD" for b in "ACD"}
    matrix |= {(b, a): matrix[a, b] for a in "ACD" for b in "ACD" if a < b}
    seqs = [(i, "".join(rng.choice("ACD-") for _ in range(9)), "".join(rng.choice("Mo") for _ in range(9))) for i in range(11)]
    df = spark.createDataFrame(seqs, "id int, seq string, top string")
    ids = spark.createDataFrame([(a, b) for a in range(11) for b in range(a + 1, 11)], "id1 int, id2 int")
    m = spark.createDataFrame([(a, b, v) for (a, b), v in matrix.items()], "aa1 string, aa2 string, score int")
    joined = alignment.aligned_columns(alignment.long_form(df, "id", "seq"), ids)
    got = pairs.scored_pairs(df, "id", "seq", pairs.affine(matrix, -5, -1), "raw double, self1 double, self2 double", block=4)
    want = alignment.affine_scores(joined, m, -5, -1)
    assert rows(got.selectExpr("id1", "id2", "raw", "self1", "self2")) == rows(want.selectExpr("id1", "id2", "double(raw)", "double(self1)", "double(self2)"))
    inner = {k: 3 * v for k, v in matrix.items()}
    row = df.select("id", F.concat_ws("|", "seq", "top").alias("r"))
    tile = pairs.scored_pairs(row, "id", "r", pairs.substitution(matrix, inner), "total double, matches bigint, gaps bigint, residues bigint", block=4)
    residues = alignment.ungapped_index(alignment.long_form(df, "id", "seq"), "id", "pos", "aa").join(
        df.select("id", F.posexplode(F.split("top", "")).alias("pos", "symbol")), ["id", "pos"]
    ).where("residue is not null").select("id", "residue", "symbol")
    n = spark.createDataFrame([(a, b, v) for (a, b), v in inner.items()], "aa1 string, aa2 string, score int")
    want = alignment.alignment_bits(joined, m, n, residues)
    assert rows(alignment.bits_of(tile).select("id1", "id2", "matches", "gaps", F.round("bits", 9))) == rows(want.select("id1", "id2", "matches", "gaps", F.round("bits", 9)))
    grouped = pairs.pairs_within(df.withColumn("g", F.col("id") % 2), "g", "id", "seq", "ACD", block=2)
    assert grouped.count() == 15 + 10 and grouped.where("id1 % 2 <> g or id2 % 2 <> g").count() == 0


def test_gap_bonus_in_both_forms(spark):
    from seqloom.operators.pairs import profiles, scored_pairs

    df = spark.createDataFrame([(0, 1, 0.2, 0.5), (0, 1, None, 0.1), (0, 1, 0.9, 0.4)], "k int, p int, a double, b double")
    s = alignment.gap_bonus_similarity(df, ["k"], ["a"], ["b"]).head().similarity
    t, g = (1 - 0.3) + (1 - 0.5), 1
    assert s == pytest.approx((t + t / 2 * (1 - g / 5) * g) / 3, abs=1e-5)
    tile = scored_pairs(spark.createDataFrame([(0, [0.2, float("nan"), 0.9]), (1, [0.5, 0.1, 0.4])], "id int, x array<double>"), "id", "x", profiles, "distance double, matched bigint, left_only bigint, right_only bigint").head()
    assert (tile.matched, tile.left_only, tile.right_only) == (2, 0, 1) and tile.distance == pytest.approx(0.8)


def test_shapiro_for_any_size(spark):
    rng = random.Random(2)
    data = {"few": [rng.gauss(0, 1) for _ in range(5)], "some": [rng.expovariate(1) for _ in range(60)], "many": [rng.gauss(5, 2) for _ in range(6000)], "flat": [1.0] * 9, "two": [1.0, 2.0]}
    got = {r.g: r for r in statistics.shapiro_tests(spark.createDataFrame([(g, x) for g, v in data.items() for x in v], "g string, x double"), "g", "x").collect()}
    for g in ("few", "some", "many"):
        assert got[g].w == pytest.approx(statistics.shapiro_wilk(data[g]), abs=1e-9)
    assert got["some"].p < 1e-4 and got["many"].p > 0.001 and 0 < got["few"].p <= 1
    assert got["flat"].w is None and got["two"].w is None


def test_markov_clustering_has_no_caps_and_raises(spark):
    hub = [("hub", f"x{i}", 0.9) for i in range(70)]
    two = [(f"{g}{i}", f"{g}{j}", 0.9) for g in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 0.5)]
    df = spark.createDataFrame(hub + two, "seq1 string, seq2 string, score double")
    got = {}
    for m, g in rows(graphs.markov_clusters(df, 2.0)):
        got.setdefault(g, set()).add(m)
    assert {f"x{i}" for i in range(70)} | {"hub"} in got.values()
    assert {f"a{i}" for i in range(5)} in got.values()
    grid = graphs.markov_grid(df, [(2.0, 0.0), (2.0, 0.8)])
    assert {r.k for r in grid.select("k").distinct().collect()} == {0, 1}
    with pytest.raises(RuntimeError):
        graphs.markov_clusters(df, 1.3, rounds=1)


def test_markov_clustering_by_joins_counts_products_of_hubs(spark, monkeypatch):
    """Tables and tasks agree with full matrices, also where a vertex is tied to so many others that its products are only counted."""
    import numpy as np

    from seqloom.operators import markov

    rng = random.Random(8)
    edges = {("hub", f"x{i}"): round(rng.uniform(0.5, 0.99), 3) for i in range(60)}
    edges |= {("y0", f"x{i}"): 0.55 for i in range(0, 20, 3)}
    for g in range(4):
        ids = [f"x{i}" for i in range(12 * g, 12 * g + 6)] + [f"z{g}{i}" for i in range(4)]
        edges |= {(a, b): round(rng.uniform(0.6, 0.95), 3) for i, a in enumerate(ids) for b in ids[i + 1 :] if rng.random() < 0.8}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "seq1 string, seq2 string, score double")
    settings = [(1.5, 0.5), (2.0, 0.5), (2.0, 0.7), (4.0, 0.6)]
    ids, at = np.unique([x for e in edges for x in e], return_inverse=True)
    at = at.reshape(-1, 2)
    want = []
    for k, vertices, labels in markov.clustered(at[:, 0], at[:, 1], np.array(list(edges.values())), len(ids), settings, 1e-4, 100):
        want += [(k, str(ids[v]), str(ids[g])) for v, g in zip(vertices, labels)]
    assert rows(graphs.markov_grid(df, settings)) == sorted(want)
    monkeypatch.setattr(graphs, "MOST_MEMBERS", 5)
    for heavy in (10, 1000):
        monkeypatch.setattr(graphs, "HEAVY", heavy)
        assert rows(graphs.markov_grid(df, settings)) == sorted(want)


def test_blocks_are_components(spark):
    from seqloom.plans.stages import Stages

    rng = random.Random(3)
    edges = [(f"a{rng.randrange(300)}", f"b{rng.randrange(300)}", 0.5) for _ in range(250)] + [(f"p{i}", f"p{i + 1}", 0.5) for i in range(90)]
    df = spark.createDataFrame(edges, "seq1 string, seq2 string, score double")
    blocks = {r.key: r.block for r in graphs._blocks(df, Stages(spark, "test")).collect()}
    keys = {r.id: r.k for r in df.selectExpr("explode(array(seq1, seq2)) AS id").distinct().selectExpr("id", "xxhash64(id) AS k").collect()}
    of = dict(rows(graphs.components(df)))
    assert len(blocks) == len(keys) == len(of)
    assert len({(blocks[keys[m]], g) for m, g in of.items()}) == len(set(of.values())) == len(set(blocks.values()))


def planted(seed=4):
    rng = random.Random(seed)
    taxa = [f"T{i}" for i in range(6)]
    edges = []
    ids = [[f"{t}-{g}" for t in taxa] for g in range(3)]
    for g in ids:
        edges += [(a, b, round(rng.uniform(0.8, 0.95), 4)) for i, a in enumerate(g) for b in g[i + 1 :]]
    for x in range(3):
        for y in range(x + 1, 3):
            edges += [(a, b, round(rng.uniform(0.05, 0.3), 4)) for a in ids[x] for b in ids[y] if rng.random() < 0.5]
    return ids, edges


def test_ortholog_caller_finds_planted_families(spark):
    ids, edges = planted()
    e = spark.createDataFrame(edges, "seq1 string, seq2 string, score double")
    members = spark.createDataFrame([("group_0", m) for g in ids for m in g], "grp string, member string")
    for most in (400, 5):  # in one task, and by the distributed search first
        got = {}
        for r in orthologs.orthogroups(e, members, steps=15, most=most).collect():
            got.setdefault(r.grp, set()).add(r.member)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, ids))
        assert all(g.startswith("group_0_") for g in got)
    assert orthologs.orthogroups(e.limit(0), members.limit(0)).count() == 0


def test_subdivision_goes_on_to_the_end(spark):
    ids, edges = planted(5)
    e = spark.createDataFrame(edges, "seq1 string, seq2 string, score double")
    members = spark.createDataFrame([(m,) for g in ids for m in g], "member string")
    got = {}
    for r in grouping.subdivided(e, members, [grouping.Setting(1.5, 0.0), grouping.Setting(2.0, 0.6)]).collect():
        got.setdefault(r.grp, set()).add(r.member)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, ids))


def test_subdivision_keeps_whole_groups_whatever_their_rounding(spark):
    """A setting that leaves a group whole may sum its large score in another order, to a little more."""
    rng = random.Random(1)
    edges, members = [], []
    for g in range(8):
        ids = [f"T{t}-{g}x{i}" for t in range(40) for i in range(rng.choice([3, 5, 7]))]
        members += [(f"g{g}", m) for m in ids]
        edges += [(ids[0], m, 0.9) for m in ids[1:]]
    e = spark.createDataFrame(edges, "seq1 string, seq2 string, score double")
    settings = [grouping.Setting(1.5, 0.0), grouping.Setting(1.5, 0.5)]
    usual = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        got = rows(grouping.subdivided(e, spark.createDataFrame(members, "grp string, member string"), settings))
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    assert got == sorted(members)


def test_guessed_formats_and_zip(spark, tmp_path):
    aligned = spark.createDataFrame([("a", "AC-GT"), ("b", "ACCGT")], "id string, seq string")
    writers.phylip(aligned, f"{tmp_path}/phylip")
    assert readers.guessed_format(spark, f"{tmp_path}/phylip") == "phylip"
    assert rows(readers.sequences(spark, f"{tmp_path}/phylip")) == rows(aligned)
    (tmp_path / "odd.txt").write_text("what is this\n")
    with pytest.raises(ValueError):
        readers.guessed_format(spark, f"{tmp_path}/odd.txt")
    for n in ("x.txt", "y.txt", "z.csv"):
        (tmp_path / n).write_text(n)
    assert writers.zip_files(spark, str(tmp_path), r"^[xy]\.txt$", f"{tmp_path}/out/all.zip") == 2
    assert zipfile.ZipFile(tmp_path / "out" / "all.zip").namelist() == ["x.txt", "y.txt"]
    assert rows(readers.zipped_texts(spark, f"{tmp_path}/out/all.zip", "^x").select("name", "value")) == [("x.txt", "x.txt")]


def test_long_tables_say_that_they_go_on(spark):
    text = writers.ascii_table(spark.range(5), rows=3)
    assert text.splitlines()[-1] == "... more than 3 rows" and "more" not in writers.ascii_table(spark.range(3), rows=3)


def test_every_draw_is_picked(spark):
    w = spark.createDataFrame([(i, 0.1) for i in range(10)], "id int, w double")
    draws = spark.createDataFrame([(i, u) for i, u in enumerate([0.0, 0.05, 0.1, 0.55, 0.999999999999, 1.0])], "d int, u double")
    got = rows(statistics.picked(statistics.cumulative(w, "w", "id").select("id", "share", "cumulative"), draws, "id").select("d"))
    assert [d for (d,) in got] == list(range(6))


def test_objectives_and_open_files(spark):
    import io

    from seqloom.operators.stochastic import Variable, coupled_chains, pointwise

    plain = pointwise(lambda v: -v[0] ** 2 - v[1] ** 2, ["x", "y"])
    shifted = pointwise(lambda v, p: -(v[0] - p[0]) ** 2 - v[1] ** 2, ["x", "y"], 3.0)
    assert plain([{"y": 2, "x": 1}]) == [-5.0] and shifted([{"x": 3, "y": 0}]) == [0.0]
    _, best, score = coupled_chains([Variable("x", -10, 10), Variable("y", -10, 10)], shifted, 400, seed=3)
    assert abs(best["x"] - 3) < 1.5 and score > -3
    assert readers.whole_text(spark, io.BytesIO(b"a\r\xffb")).head().value == "a\n\ufffdb"
    assert readers.whole_text(spark, io.StringIO("x\ry")).head().value == "x\ny"
