import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions.ids import taxon
from seqloom.operators import alignment, dedup, graphs, groups, grouping, hits, pairs, pssm, statistics, stochastic, trees
from seqloom.operators.external import Program, mapped, piped

ALPHABET = "ARNDCQEGHILKMFPSTWYV"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_all_pairs_against_brute_force(spark):
    rng = random.Random(1)
    seqs = {i: "".join(rng.choice("AR-") for _ in range(12)) for i in range(23)}
    df = spark.createDataFrame(list(seqs.items()) + [(99, None)], "id int, seq string")
    want = []
    for a, b in itertools.combinations(seqs, 2):
        z = [(x, y) for x, y in zip(seqs[a], seqs[b]) if (x, y) != ("-", "-")]
        want.append((a, b, sum(x == y for x, y in z), sum(x == y for x, y in z), len(z), sum(x != "-" != y for x, y in z)))
    assert rows(pairs.all_pairs(df, "id", "seq", ALPHABET, block=5)) == want
    between = pairs.pairs_between(df.where("id < 5"), df.where("id >= 5 and id < 99"), "id", "seq", ALPHABET, block=3)
    assert between.count() == 5 * 18
    assert pairs.all_pairs(df.limit(0), "id", "seq", ALPHABET).count() == 0


def test_incremental_pairs_complete_the_old_ones(spark):
    ids = spark.range(9)
    old, new = ids.where("id % 3 > 0"), ids.where("id % 3 = 0")
    got = rows(pairs.incremental_pairs(old, new, "id"))
    before = {p for p in itertools.combinations(range(9), 2) if p[0] % 3 and p[1] % 3}
    assert sorted(set(itertools.combinations(range(9), 2)) - before) == got


def test_runs_spans_and_complement(spark):
    s = spark.createDataFrame([(1, i, c) for i, c in enumerate("ooMMMoMMoo")] + [(2, 0, "o")], "id int, pos int, symbol string")
    assert rows(alignment.spans(s, "id", "pos", "symbol", "M")) == [(1, "TMD1", 2, 5), (1, "TMD2", 6, 8)]
    lengths = s.groupBy("id").agg((F.max("pos") + 1).alias("n"))
    assert rows(alignment.complement(alignment.spans(s, "id", "pos", "symbol", "M"), lengths, "id", "n")) == [(1, 0, 2), (1, 5, 6), (1, 8, 10), (2, 0, 1)]
    assert [tuple(r)[1:] for r in sorted(alignment.smoothed(s, "id", "pos", "symbol").collect(), key=lambda r: (r.id, r.start))][:2] == [("o", 0, 2), ("M", 2, 10)]


def test_affine_gaps(spark):
    a = spark.createDataFrame([(1, 2, i, x, y) for i, (x, y) in enumerate(zip("-AA--A", "AAA-AA"))], "id1 int, id2 int, pos int, aa1 string, aa2 string")
    m = spark.createDataFrame([("A", "A", 4)], "aa1 string, aa2 string, score int")
    r = alignment.affine_scores(a, m, -5, 0).head()
    assert (r.raw, r.self1, r.self2) == (0 + 4 + 4 - 5 + 0 + 4, 12, 20)


def test_best_hits_ties_and_reciprocity(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9), ("b", "d", 0.5)], "seq1 string, seq2 string, score double")
    assert hits.best_hits(e, "seq1", "seq2", "score").where("a = 'a'").count() == 2
    assert hits.best_hits(e, "seq1", "seq2", "score", ties=False).where("a = 'a'").head().b == "b"
    assert rows(hits.reciprocal(hits.best_hits(e, "seq1", "seq2", "score"))) == [("a", "b"), ("a", "c")]


def test_decode_reports_missing(spark):
    h = spark.createDataFrame([("x", "y", 1), ("x", "z", 2)], "q string, s string, n int")
    names = spark.createDataFrame([("x", "X"), ("y", "Y")], "hash string, name string")
    good, bad = hits.decoded(h, names, "hash", "name", "q", "s")
    assert rows(good) == [("X", "Y", 1)] and rows(bad) == [("x", "z", 2)]


def members(spark, *groups_):
    return spark.createDataFrame([(i, m, m.split("-")[0]) for i, g in enumerate(groups_) for m in g], "grp int, member string, taxon string")


def test_group_scores(spark):
    nine = [f"T{i}-g" for i in range(9)]
    m = members(spark, nine, ["A-1", "A-2", "B-1"], ["A-3"])
    assert [r.score for r in groups.squared_scores(m).orderBy("grp").collect()] == [81, -1, 0]
    assert [r.score for r in groups.plus_minus_scores(m).orderBy("grp").collect()] == [9, 0, 1]
    product = {r.grp: r.score for r in groups.product_scores(m).collect()}
    assert product[1] == pytest.approx(2 * (1 + 1 / 3) - 2 * (2 / 2)) and product[2] == 0
    assert {r.grp: r.score for r in groups.product_scores(members(spark, ["A-1", "A-2"])).collect()} == {0: None}
    same = groups.set_overlap(groups.overlaps(m, m)).head().score
    assert same == pytest.approx(1.0)


def random_graph(spark, n, p, seed, scores=False):
    rng = random.Random(seed)
    e = [(f"v{a:02}", f"v{b:02}", round(rng.random(), 3)) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]
    return e, spark.createDataFrame(e, "seq1 string, seq2 string, score double")


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    e, df = random_graph(spark, 40, 0.04, seed)
    label = {v: v for x in e for v in x[:2]}
    for _ in label:
        for a, b, _s in e:
            label[a] = label[b] = min(label[a], label[b])
    assert rows(graphs.components(df)) == sorted(label.items())
    assert graphs.components(df.limit(0)).count() == 0
    big = rows(graphs.sized_components(df, 3))
    assert all(list(label.values()).count(g) >= 3 for _, g in big)


def test_split_graph_leaves_edges_with_one_end(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "seq1 string, seq2 string, score double")
    m = spark.createDataFrame([("a",), ("b",)], "member string")
    removed, remaining = graphs.split(e, m)
    assert rows(removed) == [("a", "b", 1.0)] and rows(remaining) == [("c", "d", 1.0)]


def test_markov_clusters_split_two_cliques(spark):
    e = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i, j in itertools.combinations(range(5), 2)] + [("a0", "b0", 0.1)]
    got = dict(rows(graphs.markov_clusters(spark.createDataFrame(e, "seq1 string, seq2 string, score double"))))
    assert len(got) == 10 and {got[f"a{i}"] for i in range(5)}.isdisjoint({got[f"b{i}"] for i in range(5)}) and len(set(got.values())) == 2


def test_paralogs_fold(spark):
    e = spark.createDataFrame([("A-1", "A-2", 0.9), ("A-1", "B-1", 0.5), ("A-2", "B-1", 0.4)], "seq1 string, seq2 string, score double")
    folded, left = graphs.collapse_paralogs(e, taxon)
    assert rows(folded) == [("A-2", "A-1")] and rows(left) == [("A-1", "B-1", 0.5)]


def test_linkage(spark):
    e = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.92), ("a", "c", 0.2)], "seq1 string, seq2 string, score double")
    assert len({g for _, g in rows(graphs.linkage(e, 0.1))}) == 1
    assert dict(rows(graphs.linkage(e, 0.1, "complete"))) == {"a": "a", "b": "a", "c": "c"}


def test_dedup(spark):
    r = spark.createDataFrame([(1, "x", "S"), (2, "x", "T"), (3, "y", "T"), (4, "z", "S"), (5, "w", None)], "n int, id string, seq string")
    assert [x[0] for x in rows(dedup.greedy_either(r, "id", "seq", "n"))] == [1, 3, 5]  # 2 goes for its id, so 3 may keep T
    assert [x[0] for x in rows(dedup.first_of(r, "id", "n"))] == [1, 3, 4, 5]
    numbered = dedup.with_row_number(r, "k", F.desc("n"))
    assert [(x.n, x.k) for x in numbered.orderBy("k").collect()] == [(5, 1), (4, 2), (3, 3), (2, 4), (1, 5)]
    assert dedup.within_deviation(spark.createDataFrame([(v,) for v in (1, 5, 5, 5, 9)], ["v"]), F.col("v")).count() == 3


def test_weights_sum_to_one_and_gaps_count(spark):
    c = spark.createDataFrame([(i, p, a) for i, s in enumerate(["AC-", "AD-", "AC-"]) for p, a in enumerate(s)], "id int, pos int, aa string")
    w = {r.id: r.weight for r in pssm.sequence_weights(c).collect()}
    assert sum(w.values()) == pytest.approx(1) and w[1] > w[0] == pytest.approx(w[2])
    letters = pssm.priors_table(spark)
    f = pssm.column_frequencies(c, pssm.sequence_weights(c), letters)
    assert f.count() == 3 * 22 and f.groupBy("pos").agg(F.sum("freq").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_statistics(spark):
    v = spark.createDataFrame([("g", float(i)) for i in range(10)], "g string, v double")
    assert [r.v for r in statistics.index_percentiles(v, "g", "v", [0.1, 0.5, 1.0]).orderBy("share").collect()] == [1.0, 5.0, 9.0]
    scaled = [r.scaled for r in statistics.normalised(v, "v").orderBy("v").collect()]
    assert scaled[0] == 0 and scaled[-1] == 1
    assert statistics.normalised(v.where("v = 1"), "v").head().scaled is None
    h = statistics.histogram(v, "v", 3).orderBy("bin").collect()
    assert [r.n for r in h] == [3, 3, 4]
    r = spark.createDataFrame([("k", i, x) for i, x in enumerate((1.0, 2.0, 4.0))], "k string, i int, x double")
    assert statistics.running_mean(r, ["k"], "x", "i").head().halved == pytest.approx(2.75)


def test_distributions():
    assert statistics.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert statistics.t_two_sided(0.0, 5) == pytest.approx(1.0, abs=1e-9)
    assert statistics.studentized_range_cdf(3.877, 3, 10) == pytest.approx(0.95, abs=2e-3)
    assert 0.9 < statistics.shapiro_wilk([1, 2, 3, 4, 5, 6, 7, 8, 9, 10.5]) <= 1


def test_kde_interval_brackets_the_mass(spark):
    rng = random.Random(3)
    v = spark.createDataFrame([("g", rng.gauss(0, 1)) for _ in range(400)], "g string, v double")
    r = statistics.kde_interval(v, "g", "v").head()
    assert -2.6 < r.low < -1.7 and 1.7 < r.high < 2.6


def tree(spark):
    return spark.createDataFrame([(0, None, 0.0, "r"), (1, 0, 1.0, "a"), (2, 0, 2.0, "b"), (3, 1, 3.0, "c"), (4, 1, 4.0, "d")], "node int, parent int, length double, label string")


def test_trees(spark):
    t = tree(spark)
    assert {r.node: (r.depth, r.distance) for r in trees.depths(t, "node", "parent", "length").collect()}[4] == (2, 5.0)
    assert dict(rows(trees.leaf_counts(t, "node", "parent"))) == {0: 3, 1: 2, 2: 1, 3: 1, 4: 1}
    m = spark.createDataFrame([("x", 3), ("x", 4), ("y", 3), ("y", 2)], "grp string, node int")
    assert rows(trees.lowest_common_ancestor(t, "node", "parent", m, "grp")) == [("x", 1), ("y", 0)]
    text = trees.newick(t.withColumn("tree", F.lit(1)), "tree", "node", "parent", "label", "length").head().newick
    assert text == "((c:3,d:4)a:1,b:2)r:0;"
    turned = {r.node: (r.parent, r.length) for r in trees.rerooted(t, "node", "parent", "length", 1).collect()}
    assert turned[1][0] is None and turned[0] == (1, 1.0) and turned[2] == (0, 2.0) and turned[3] == (1, 3.0)
    cut = {r.node: r.parent for r in trees.collapsed(t, t.where("node = 1"), "node", "parent").collect()}
    assert cut == {0: None, 2: 0, 3: 0, 4: 0}


def test_common_ancestor(spark):
    g = spark.createDataFrame([(0, 1, None), (1, 2, 1), (1, 3, 1), (2, 4, 2), (2, 5, 2)], "generation int, node int, parent int")
    r = trees.common_ancestor_of_all(g, "generation", "node", "parent").head()
    assert (r.generation, r.ancestor) == (1, 2)


def test_shuffles_keep_regions(spark):
    c = spark.createDataFrame([("s", i, a, r) for i, (a, r) in enumerate(zip("ABCDEFGH", "MMMMoooo"))], "id string, pos int, aa string, region string")
    s = stochastic.region_shuffle(c, "region", 3, 1)
    for k in range(3):
        out = "".join(r.aa for r in s.where(F.col("shuffle") == k).orderBy("pos").collect())
        assert sorted(out[:4]) == list("ABCD") and sorted(out[4:]) == list("EFGH")
    assert rows(s) == rows(stochastic.region_shuffle(c.repartition(3), "region", 3, 1))


def test_simulation_is_repeatable(spark):
    sub = {"M": ("MA", [0.9, 1.0]), "A": ("A", [1.0])}
    a = stochastic.simulate("M" * 30, 20, 2, 5, sub, spark)
    assert a.where("generation = 2").count() == 20
    assert a.where("size(positions) <> length(seq)").count() == 0
    assert rows(a.select("id", "seq")) == rows(stochastic.simulate("M" * 30, 20, 2, 5, sub, spark).select("id", "seq"))


def test_coupled_chains_find_the_top():
    v = [stochastic.Variable("x", -4, 4)]
    trace, best, score = stochastic.coupled_chains(v, lambda b: [-6 * c["x"] ** 2 + 2 * c["x"] + 4 for c in b], steps=400, seed=2)
    assert len(trace) == 301 and abs(best["x"] - 1 / 6) < 0.1 and score == pytest.approx(25 / 6, abs=0.1)
    assert trace["x"].between(-4, 4).all()


def test_small_groups_merge(spark):
    m = spark.createDataFrame([("L", f"l{i}") for i in range(5)] + [("K", f"k{i}") for i in range(5)] + [("s", "x")], "grp string, member string")
    e = spark.createDataFrame([("x", f"l{i}", 0.9 + i / 100) for i in range(5)] + [("x", f"k{i}", 0.1 + i / 100) for i in range(5)], "seq1 string, seq2 string, score double")
    assert dict((b, a) for a, b in rows(grouping.merged_small(m, e)))["x"] == "L"


def test_merging_makes_no_pairs_without_an_edge(spark, monkeypatch):
    """Equal to the test over all pairs, zeros included; what is written between has no more rows than there are edges."""
    rng = random.Random(4)
    sizes = {"L": 40, "K": 30, "J": 4} | {f"s{i}": 1 + i % 2 for i in range(12)}
    of = {f"{g}_{i}": g for g, n in sizes.items() for i in range(n)}
    edges = {}
    for a, g in of.items():
        if g[0] == "s":
            # every third group is close to L, the others have a few edges to each
            near = int(g[1:]) % 3 == 0
            for h, n in {"L": 35, "K": 5, "J": 1}.items() if near else {"L": 4, "K": 4, "J": 1}.items():
                for b in rng.sample([x for x, k in of.items() if k == h], n):
                    edges[a, b] = None if rng.random() < 0.02 else 0.4 + 0.1 * rng.random()
    m = spark.createDataFrame([(g, a) for a, g in of.items()], "grp string, member string")
    e = spark.createDataFrame([(a, b, s) if i % 2 else (b, a, s) for i, ((a, b), s) in enumerate(edges.items())], "seq1 string, seq2 string, score double")
    linked = {(of[a], of[b]) for a, b in edges}
    every = [(of[a], of[b], edges.get((a, b)) or 0.0) for a in of for b in of if (of[a], of[b]) in linked]
    mean = {k: sum(s for *x, s in every if tuple(x) == k) / sum(tuple(x) == k for *x, _ in every) for k in linked}
    top = {g: max((v, h) for (f, h), v in mean.items() if f == g)[1] for g, _ in linked}
    test = statistics.tukey_hsd(spark.createDataFrame(every, "t string, g string, v double"), "t", "g", "v").collect()
    moved = {g for g in top if all(r.differs for r in test if r.t == g and top[g] in (r.group1, r.group2))}
    assert 0 < len(moved) < len(top)

    written, cut = [], grouping.Stages.cut_counted
    monkeypatch.setattr(grouping.Stages, "cut_counted", lambda *a, **k: written.append(cut(*a, **k)) or written[-1])
    assert rows(grouping.merged_small(m, e)) == sorted((top[g] if g in moved else g, a) for a, g in of.items())
    assert len(every) > len(edges) >= max(n for _, n in written)


def test_external_programs(spark):
    import pandas as pd

    p = Program(("cat",), lambda b: "\n".join(b["v"]), lambda t: pd.DataFrame({"v": t.split("\n")}), "v string")
    assert sorted(r.v for r in piped(spark.createDataFrame([("a",), ("b",)], "v string"), p).collect()) == ["a", "b"]
    assert rows(mapped(spark.range(3), lambda r, k: (r.id * k,) if r.id else None, "v bigint", 10)) == [(10,), (20,)]


def test_zip_checks_keys(spark):
    a = spark.createDataFrame([(0, "x", 1), (1, "y", 2)], "n int, id string, v int")
    assert rows(alignment.zipped(a, a.drop("v"), "n", "id")) == [(0, "x", 1), (1, "y", 2)]
    with pytest.raises(Exception, match="different records"):
        alignment.zipped(a, a.withColumn("id", F.lit("x")), "n", "id").collect()


def test_contiguous_blocks(spark):
    b = spark.createDataFrame([("s", 1, 10), ("s", 11, 20), ("s", 22, 30)], "k string, start int, end int")
    assert [r.ok for r in b.withColumn("ok", alignment.contiguous(b, "k", "start", "end")).orderBy("start").collect()] == [True, True, False]
    p = spark.createDataFrame([(5,), (15,)], "pos int")
    assert sorted((r.pos, r.start) for r in alignment.first_segment(p, b, "pos", "start", "end").collect()) == [(5, 1), (15, 11)]


def test_shapiro_by_group(spark):
    rng = random.Random(2)
    v = [("normal", rng.gauss(0, 1)) for _ in range(200)] + [("skewed", rng.expovariate(1) ** 2) for _ in range(200)] + [("few", 1.0), ("few", 2.0)]
    w = {r.g: r.w for r in statistics.shapiro_tests(spark.createDataFrame(v, "g string, x double"), "g", "x").collect()}
    assert w["normal"] > 0.98 > 0.8 > w["skewed"] and w["few"] is None
