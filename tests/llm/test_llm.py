import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("seqloom.llm")

from seqloom.llm import byte_bpe, clustering, components, dart_minhash, encoding, near_duplicates, packing, quality, sentences, set_join, top_n  # noqa: E402
from seqloom.plans.stages import Stages  # noqa: E402

VOCABULARY = encoding.public_vocabulary()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# near duplicates


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    row, element, weight, exact, n = [], [], [], [], 300
    for i in range(n):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        w = rng.uniform(0.2, 6, (2, 60))
        exact.append(np.minimum(*w).sum() / np.maximum(*w).sum())
        for side in (0, 1):
            row.append(np.full(60, 2 * i + side))
            element.append(base)
            weight.append(w[side])
    s = dart_minhash.signatures(np.concatenate(row), np.concatenate(element), 2 * n, 64, np.concatenate(weight))
    assert abs((s[0::2] == s[1::2]).mean() - np.mean(exact)) < 0.015
    assert not (s == dart_minhash.EMPTY).any()


def test_repeated_elements_count_once_and_empty_rows_stay_empty():
    e = np.arange(20, dtype=np.uint64) * np.uint64(7919)
    once = dart_minhash.signatures(np.zeros(20, int), e, 2, 32)
    twice = dart_minhash.signatures(np.zeros(40, int), np.concatenate([e, e]), 2, 32)
    assert (once[0] == twice[0]).all() and (once[1] == dart_minhash.EMPTY).all()


def shingles(s):
    return {s[i : i + 5] for i in range(len(s) - 4)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(40, 120))) for _ in range(25)]
    texts = []
    for i, b in enumerate(base):
        texts.append((f"r{i:02}", b))
        for k in range(3):
            c = list(b)
            for _ in range(rng.randint(0, 6)):
                p = rng.randrange(len(c))
                c[p : p + rng.choice([0, 1])] = rng.choice("ACDEFGHIKL")
            texts.append((f"r{i:02}-{k}", " \n".join("".join(c)[j : j + 30] for j in range(0, len(c), 30)).lower()))
    texts += [("null", None), ("empty", ""), ("short", "ab-c d"), (None, base[0]), ("r00", base[0]), ("long", "ACDEFGHIK" * 3000), ("é1", "ΑΒΓΔΕΖΗΘαβγ"), ("é2", "αβγδεζηθαβγ")]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in texts], "id string, seq string, h int, content int")
    pairs, members = near_duplicates.near_duplicates(df, "id", near_duplicates.letters(F.col("seq")))
    got = rows(near_duplicates.record_pairs(pairs, members))
    clean = {}
    for a, b in texts:
        s = "".join(x for x in (b or "") if x.isalpha()).upper()
        if a and len(s) >= 5:
            clean[a] = shingles(s)
    want = sorted((a, b) for a, b in itertools.combinations(sorted(clean), 2) if len(clean[a] & clean[b]) >= 0.6 * len(clean[a] | clean[b]))
    assert got == want and len(got) > 30 and ("é1", "é2") in got
    groups = dict(rows(near_duplicates.linked_groups(pairs, members)))
    assert groups.keys() == clean.keys() and all(groups[a] == groups[b] for a, b in got) and all(g <= r for r, g in groups.items())
    pairs, members = near_duplicates.near_duplicates(df.limit(0), "id", F.col("seq"))
    assert near_duplicates.record_pairs(pairs, members).count() == 0


# set join


@pytest.mark.parametrize("threshold,small", [(0.8, 8), (0.8, 3), (0.6, 5), (1.0, 4)])
def test_set_join_against_brute_force(spark, threshold, small):
    rng = random.Random(int(threshold * 100) + small)
    records = []
    for g in range(18):
        base = rng.sample(range(60), rng.randint(1, 22))
        for _ in range(4):
            s = set(base)
            for _ in range(rng.randint(0, 3)):
                s ^= {rng.randrange(60)}
            records.append([f"m{x}" for x in s] + ["hot"] * rng.randint(0, 1))
    data = [(i, m + m[:1] + [None], "x") for i, m in enumerate(records)] + [(500, None, "x"), (501, [], "x"), (502, [None], "x"), (None, ["a"], "x")]
    df = spark.createDataFrame(data, "cls int, ms array<string>, tokens string")
    pairs, belongs = set_join.similar_records(df, "cls", "ms", threshold, small)
    got = rows(set_join.record_pairs(pairs, belongs))
    sets = {i: set(m) for i, m in enumerate(records) if m}
    want = [(a, b) for a, b in itertools.combinations(sets, 2) if 2 * len(sets[a] & sets[b]) >= threshold * (len(sets[a]) + len(sets[b])) - 1e-9]
    assert got == sorted(want)
    links = {r.rec: r.links for r in set_join.link_counts(pairs, belongs).collect()}
    assert links == {i: sum(i in p for p in want) for i in sets}


def test_set_join_between_two_tables(spark):
    rng = random.Random(21)
    tables = []
    for _ in range(2):
        base = [rng.sample(range(40), rng.randint(1, 16)) for _ in range(8)] if not tables else [r for r in tables[0][::3]]
        records = []
        for b in base:
            for _ in range(3):
                s = set(b)
                for _ in range(rng.randint(0, 2)):
                    s ^= {rng.randrange(40)}
                records.append(sorted(s))
        tables.append(records)
    left, right = (spark.createDataFrame([(i, [f"m{x}" for x in r]) for i, r in enumerate(t)] + [(900, None), (None, ["m1"])], "rec int, ms array<string>") for t in tables)
    got = rows(set_join.similar_between(left, right, "rec", "ms", 0.8))
    want = [(i, j) for i, a in enumerate(tables[0]) for j, b in enumerate(tables[1]) if a and b and 2 * len({*a} & {*b}) >= 0.8 * (len(a) + len(b)) - 1e-9]
    assert got == sorted(want) and len(want) > 20
    assert set_join.similar_between(left.limit(0), right, "rec", "ms", 0.8).count() == 0


def test_set_join_of_nothing(spark):
    df = spark.createDataFrame([], "rec int, members array<string>")
    pairs, belongs = set_join.similar_records(df, "rec", "members", 0.8)
    assert set_join.record_pairs(pairs, belongs).count() == 0
    with pytest.raises(ValueError):
        set_join.Dice(0)


# clusters


def test_pivot_clusters_find_planted_clusters(spark):
    rng = random.Random(6)
    planted = [[f"c{g}-{i}" for i in range(rng.randint(5, 14))] for g in range(12)]
    e = []
    for m in planted:
        for a, b in itertools.combinations(m, 2):
            if rng.random() < 0.85:
                e.append((a, b, round(rng.uniform(0.5, 1), 3)))
            else:
                e.append((a, b, 0.1))
    everyone = [x for m in planted for x in m]
    for _ in range(40):
        a, b = rng.sample(everyone, 2)
        if a.split("-")[0] != b.split("-")[0]:
            e.append((a, b, 0.6))
    e += [(b, a, s) for a, b, s in e[:20]] + [("x", "y", 0.9), (None, "x", 0.9), ("x", "x", 1.0), ("x", "z", None), ("x", "z", float("nan"))]
    df = spark.createDataFrame(e, "label string, v string, n double")
    tied = {frozenset((a, b)) for a, b, s in e if a and b and a != b and s and s >= 0.5}
    got = {}
    for c, m in rows(clustering.pivot_clusters(df, "label", "v", "n", 0.5)):
        got.setdefault(c, set()).add(m)

    def good(m):
        inside = all(sum(frozenset((x, y)) in tied for y in m if y != x) > (len(m) - 1) / 2 for x in m)
        outside = all(sum(frozenset((x, y)) in tied for y in m) <= len(m) / 4 for x in everyone if x not in m)
        return inside and outside

    assert all(min(m) == c and good(m) for c, m in got.items())
    assert {frozenset(m) for m in planted if good(set(m))} <= {frozenset(m) for m in got.values()}
    d = clustering.described_clusters(df, "label", "v", "n", 0.5)
    assert {c: n for c, n in rows(d.select("cluster_id", "size").distinct())} == {c: len(m) for c, m in got.items()}
    assert d.where("place = 1").count() == len(got)
    best = {}
    for x, y, w in e:
        if x and y and x != y and w and w >= 0.5:
            best[frozenset((x, y))] = max(w, best.get(frozenset((x, y)), 0))
    for c, m in got.items():
        typical = {x: round(sum(best.get(frozenset((x, y)), 0) for y in m if y != x) / (len(m) - 1), 6) for x in m}
        want = [(x, k + 1, typical[x]) for k, x in enumerate(sorted(m, key=lambda x: (-typical[x], x)))]
        found = sorted((r.seq_id, r.place, r.typicality) for r in d.where(F.col("cluster_id") == c).collect())
        assert [x[:2] for x in found] == [x[:2] for x in sorted(want)] and all(f[2] == pytest.approx(w[2], abs=2e-6) for f, w in zip(found, sorted(want)))
    assert clustering.pivot_clusters(df.limit(0), "label", "v", "n", 0.5).count() == 0


def test_clusters_that_the_cycles_leave_are_searched_exactly(spark):
    # every member of a bipartite cluster is tied to just over half of the others, and the cycles rarely settle it
    planted = [[f"b{g}-{i:02}" for i in range(2 * m)] for g, m in enumerate((3, 4, 6, 9, 12))]
    e = [(a, b, 0.8) for m in planted for a, b in itertools.product(m[::2], m[1::2])]
    e += [(m[0], n[1], 0.7) for m, n in itertools.pairwise(planted)]
    df = spark.createDataFrame(e, "a string, b string, s double")
    want = sorted((min(m), x) for m in planted for x in m)
    for cycles in (0, 1):
        assert rows(clustering.pivot_clusters(df, "a", "b", "s", 0.5, max_cycles=cycles)) == want


def test_exact_clusters_against_brute_force():
    from seqloom.llm.exact_clusters import all_clusters

    rng = random.Random(12)
    some = 0
    for _ in range(150):
        n = rng.randint(6, 11)
        near = {frozenset(p) for p in itertools.combinations(range(n), 2) if rng.random() < (0.8 if (p[0] < n // 2) == (p[1] < n // 2) else 0.1)}
        marked = {v for v in range(n) if rng.random() < 0.1}

        def good(m):
            inside = all(sum(frozenset((x, y)) in near for y in m) > (len(m) - 1) / 2 for x in m)
            return inside and all(sum(frozenset((x, y)) in near for y in m) <= len(m) / 4 for x in range(n) if x not in m)

        valid = [set(m) for k in range(5, n + 1) for m in itertools.combinations([v for v in range(n) if v not in marked], k) if good(m)]
        got = [set(m) for m in all_clusters([(*sorted(p), min(p) in marked, max(p) in marked) for p in near], 5, 0.5, 0.25)]
        assert all(m in valid for m in got) and all(any(m & g for g in got) for m in valid)
        some += bool(valid)
    assert some > 10
    with pytest.raises(RuntimeError):
        all_clusters([(a, b, False, False) for a, b in itertools.combinations(range(8), 2) if (a + b) % 4], 5, 0.5, 0.25, most_steps=0)


# components


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    e = [(f"v{rng.randrange(120)}", f"v{rng.randrange(120)}") for _ in range(70)]
    e += [(f"p{i:03}", f"p{i + 1:03}") for i in range(150)] + [("hub", f"h{i}") for i in range(60)] + [("a", None), (None, None), ("only", "only")] + e[:5]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in e], "src string, dst string, label int, v int")
    assert rows(components.connected_components(df)) == sorted((v, find(v)) for v in parent)
    assert components.connected_components(df.limit(0)).count() == 0
    assert components.connected_components(df.where("src = 'only'")).count() == 0


# top n


def test_top_n_against_sorting(spark):
    rng = random.Random(8)
    data = [(rng.choice("abc") if rng.random() < 0.9 else None, f"i{rng.randrange(40)}", rng.choice([0.1, 0.5, 0.9, None, float("nan"), -0.0]), 7) for _ in range(600)]
    df = spark.createDataFrame(data, "seq string, partner string, value double, rnk int")
    best = {}
    for g, i, s, _ in data:
        if g and s is not None and s == s:
            best[g, i] = max(best.get((g, i), -9), s)
    want = []
    for g in "abc":
        order = sorted((-s, i) for (h, i), s in best.items() if h == g)[:5]
        want += [(g, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    for salts in (1, 3, 16):
        assert rows(top_n.top_n(df, F.col("seq"), F.col("partner"), F.col("value"), 5, salts)) == sorted(want)
    assert top_n.top_n(df.limit(0), F.col("seq"), F.col("partner"), F.col("value"), 5).count() == 0
    with pytest.raises(ValueError):
        top_n.top_n(df, F.col("seq"), F.col("partner"), F.col("value"), 0)


# tokenizer

TEXTS = ["", None, "Hello  world's 123 <|endoftext|>\n\n x", "日本語 αβγ 🎉🎉   é\x00\x1c", " " * 3000 + "a" * 5000, "\t\r\n", "don't we'll I've", "é" * 50]


@needs_vocabulary
def test_encoding_is_that_of_the_vocabulary():
    tiktoken = pytest.importorskip("tiktoken")
    tokens = byte_bpe.read_ranks(VOCABULARY)
    own = byte_bpe.Tokenizer(tokens, remember=5)
    other = tiktoken.Encoding("other", pat_str=byte_bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FFF), rng.randrange(0x1F300, 0x1F9FF)])) for _ in range(60)) for _ in range(200)]
    for _ in range(2):
        ids, counts = own.encode_batch(texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [other.encode_ordinary(t) for t in texts]
        assert own.count_batch(texts).tolist() == counts.tolist()
    assert [own.decode(x) for x in got] == texts


@needs_vocabulary
def test_encoding_of_a_table(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, "x", "k")], "doc int, text string, key string")
    ids = encoding.encoded(df, "doc", "text", VOCABULARY)
    got = {r.key: r.ids for r in ids.collect()}
    assert len(got) == len(TEXTS) + 1 and got[0] == got[1] == []
    assert {r.key: r.text for r in encoding.decoded(ids, "key", "ids", VOCABULARY).collect()} == {i: t or "" for i, t in enumerate(TEXTS)} | {None: "x"}
    assert {r.key: r.n_tokens for r in encoding.token_counts(df, "doc", "text", VOCABULARY).collect()} == {k: len(v) for k, v in got.items()}
    assert encoding.encoded(df.limit(0), "doc", "text", VOCABULARY).count() == 0


# packing


def test_pack_keeps_capacity_and_items():
    rng = random.Random(5)
    for n, top in ((1, 100), (40, 100), (300, 100), (300, 30)):
        sizes = sorted((rng.randint(1, top) for _ in range(n)), reverse=True)
        windows = packing.pack(sizes, 100)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert max(sum(sizes[i] for i in w) for w in windows) <= 100
        if top == 30:
            assert len(windows) <= -(-sum(sizes) // 100) + 1
    assert packing.pack([], 10) == []


def test_differencing_opposes_imbalances():
    loads = sorted(sum(w) for w in [[[8, 7, 6, 5, 4][i] for i in x] for x in packing.difference([8, 7, 6, 5, 4], 2)])
    assert loads == [14, 16]


def test_fill_containers(spark):
    rng = random.Random(9)
    data = [(i, rng.choice([0, 1, 5, 17, 40, 99, 100, 101, 250, 300]), "x") for i in range(400)] + [(1000, None, "x"), (None, 7, "x"), (3, 9, "x")]
    df = spark.createDataFrame(data, "doc int, size int, container string")
    got = packing.fill_containers(df, "doc", "size", 100, shard_items=60).collect()
    assert sum(r.length for r in got) == sum(s or 0 for _, s, _ in data)
    places = {}
    for r in got:
        if r.length:
            places.setdefault(r.container, []).append((r.place, r.length))
        else:
            assert r.container is None and r.place is None
    for p in places.values():
        at = 0
        for place, length in sorted(p):
            assert place == at
            at += length
        assert at <= 100
    pieces = {}
    for r in got:
        pieces.setdefault(r.key, []).append(r)
    for i, s, _ in data:
        if i not in (None, 3) and s:
            assert len(pieces[i]) == -(-s // 100) and sorted(r.piece for r in pieces[i]) == list(range(len(pieces[i])))
    assert packing.fill_containers(df.limit(0), "doc", "size", 100).count() == 0
    found = packing.packing_invariants(packing.fill_containers(df.where("doc is not null").dropDuplicates(["doc"]), "doc", "size", 100, shard_items=60), "key", 100).head()
    assert (found.too_full, found.overlaps, found.wrong) == (0, 0, 0) and found["keys"] == 401


# text quality

PROSE = "The second search was run again because the first one had lost some of its hits, and we do not know why it did. It is not clear to us if the same is true of the other half."
JUNK = "\n".join(f"{i};Bdu-{i};{i * 7 % 13}.5;NA" for i in range(40))


def documents(spark):
    data = [(i, PROSE + (" And so on, for the rest of them." * (i % 3)), ["en", "EN", "en-GB", "de_DE", None][i % 5]) for i in range(30)]
    data += [(100, JUNK, "en"), (101, PROSE + "\n" + JUNK, None), (102, PROSE * 4 + "\n" + JUNK[:60], "en"), (103, None, "en"), (104, "", "en"), (105, "   \n", "en"), (106, "> " + PROSE.replace(", ", ",\n> "), "en"), (107, PROSE.upper(), "en")]
    return spark.createDataFrame([(a, b, c, 1.0) for a, b, c in data], "doc int, text string, lang string, value double")


def words(spark):
    return spark.createDataFrame([("en", w) for w in "the was again because one had of its and we do not know why it did is to us if same true other so on for them some first".split()] + [("en", None)], "lang string, word string")


def test_quality_finds_what_is_not_prose(spark):
    found = quality.mostly_outside_sentences(documents(spark), "doc", "text", "lang", words(spark))
    assert sorted(r.key for r in found.collect()) == [100, 101]


def test_quality_finds_junk_whatever_else_shares_its_language(spark):
    alone, copies = [(200, JUNK, "fi")], [(300 + i, JUNK, "xx") for i in range(6)] + [(310 + i, PROSE, "xx") for i in range(4)]
    tables = [(400 + i, JUNK.replace("Bdu", f"Hsa{i}"), "pl") for i in range(5)]
    more = spark.createDataFrame([(a, b, c, 1.0) for a, b, c in alone + copies + tables], documents(spark).schema)
    found = quality.mostly_outside_sentences(documents(spark).unionByName(more), "doc", "text", "lang", words(spark))
    assert sorted(r.key for r in found.collect()) == [100, 101, 200, *range(300, 306), *range(400, 405)]


def test_statistics_of_blank_texts_are_null(spark):
    s = {r.key: r for r in quality.text_statistics(documents(spark), "doc", "text", "lang", words(spark)).collect()}
    assert len(s) == 38 and all(s[k].visible == 0 and s[k].common_share is None for k in (103, 104, 105))
    assert s[0].language == s[1].language == s[2].language == "en" and s[3].language == "de" and s[4].language == "und"
    assert s[0].n_words == len(PROSE.split()) and s[0].punctuated_lines == 1 and s[100].punctuated_lines == 0
    letters = sum(c.isalpha() for c in PROSE)
    assert s[0].mean_word_length == pytest.approx(letters / s[0].n_words, abs=1e-6)
    assert s[0].symbol_share == pytest.approx(1 - letters / len(PROSE.replace(" ", "")), abs=1e-6)


def test_share_outside_sentences():
    common = frozenset("the was again because one had of its and we do not know why it did is to us if same true other so on for them some first".split())
    assert sentences.outside_share(PROSE, common) == 0 and sentences.outside_share(JUNK, common) == 1
    assert sentences.outside_share(" \n\u00a0", common) is None and sentences.outside_share(None, common) is None


def test_tail_probabilities_are_exact(spark):
    rng = random.Random(3)
    data = [(rng.choice(["en", "de"]), "a", float(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame(data, "language string, stat string, value double")
    got = rows(quality.tail_probabilities(df, Stages(spark, "test")))
    assert {r[0] for r in got} == {"en", "de", quality.CORPUS}
    for language, _, value, low, high in got:
        own = [v for k, _, v in data if language in (k, quality.CORPUS)]
        assert low == pytest.approx(sum(v <= value for v in own) / len(own)) and high == pytest.approx(sum(v >= value for v in own) / len(own))


def test_bars_enclose_what_was_seen_of_both(spark):
    def of(*x):
        return quality.bars(spark.createDataFrame([(float(a), float(b)) for a, b in x], "outlier_score double, share double"))

    prose, junk = [(s / 10, 0) for s in range(20)], [(s / 10, 1) for s in range(15, 40)]
    low, high = of(*prose, *junk)
    assert 1.3 < low < 1.5 and 1.9 < high < 2.1
    assert of(*junk) == (float("-inf"), float("inf")) == of()
    low, high = of(*prose)
    assert 1.7 <= low <= 1.9 and high == float("inf")


def test_quality_between_and_outside_the_bars(spark):
    """With few labelled documents most are decided by score or by a look between the bars; the result is that of a look at all."""
    rng = random.Random(5)
    sentence = ["The second search was run again, and we do not know why it did.", "It is the same for the other one.", "We had some of them, and it was true."]
    data = []
    for i in range(400):
        prose = " ".join(rng.choice(sentence) for _ in range(rng.randint(2, 9)))
        table = "\n".join(f"{rng.choice('ABC')}du-{rng.randrange(99)};{rng.randrange(999)}.5;NA" for _ in range(rng.randint(3, 30)))
        data.append((i, [prose, prose, table, prose + "\n" + table][i % 4], rng.choice(["en", "de", "fi"])))
    df = spark.createDataFrame(data + data[:5], "doc int, text string, lang string")
    w = words(spark)
    common = frozenset(r.word for r in w.collect() if r.word)
    want = sorted(i for i, t, _ in data + data[:5] if sentences.outside_share(t, common) > 0.5)
    for labelled in (120, 4000):
        assert sorted(r.key for r in quality.mostly_outside_sentences(df, "doc", "text", "lang", w, labelled).collect()) == want


def test_quality_looks_at_every_text(spark):
    """A case may score like prose: its few words are frequent ones, most of its letters lie in long words outside them; a sample misses it."""
    mixed = PROSE + "\n" + "\n".join("x" * 200 + "." for _ in range(8))
    prose = [PROSE[:-1] + " kappa" * (i % 20) + "." for i in range(20)]
    data = [(i, prose[i % 20], "en") for i in range(9000)] + [(9000 + i, JUNK, "en") for i in range(300)] + [(10000, mixed, "en")]
    df = spark.createDataFrame(data, "doc int, text string, lang string")
    common = frozenset(r.word for r in words(spark).collect() if r.word)
    want = sorted(i for i, t, _ in data if sentences.outside_share(t, common) > 0.5)
    assert 10000 in want
    assert sorted(r.key for r in quality.mostly_outside_sentences(df, "doc", "text", "lang", words(spark)).collect()) == want


def test_quality_of_nothing(spark):
    d = documents(spark).limit(0)
    assert quality.mostly_outside_sentences(d, "doc", "text", "lang", words(spark)).count() == 0
