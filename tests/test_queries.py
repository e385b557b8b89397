from datetime import datetime

import pytest

from seqloom.queries import QUERIES
from seqloom.queries.carriers import graph


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


CLUSTERS = "cluster_id bigint, cluster array<string>"
ID_MAP = "hash string, name string"


def test_large_groups_have_a_product_score(spark, tmp_path):
    large = [f"T{i}-1" for i in range(130)] + [f"D-{i}" for i in range(10)]
    d = written(spark, tmp_path, clusters=([(1, large), (2, ["A-1", "B-1"])], CLUSTERS), id_map=([("h", "A-9")], ID_MAP))
    got = {r.grp: r.score for r in QUERIES["cluster_score_product"](spark, d).collect()}
    assert got[2] == 8 and got[1] == pytest.approx((2 * (1 + 1 / 140)) ** 130 - 10) and len(got) == 2


def test_hashes_in_scores_and_clusters_mean_the_sequence(spark, tmp_path):
    scores = [("A-1", "B-1", 0.6), ("habc", " B@1", 0.9), ("A-1", "habc", 1.0), ("B-1", "unknown", 0.7)]
    d = written(
        spark,
        tmp_path,
        sim_scores=(scores, "seq1 string, seq2 string, score double"),
        clusters=([(1, ["A-1", "habc", " B@1", None, ""])], CLUSTERS),
        id_map=([("habc", "A-1"), ("habc", "A-1")], ID_MAP),
    )
    assert sorted(map(tuple, graph(spark, d).collect())) == [("A-1", "B-1", 0.9), ("B-1", "unknown", 0.7)]
    assert sorted(map(tuple, QUERIES["taxon_counts"](spark, d).select("grp", "taxon", "k", "size").collect())) == [(1, "A", 1, 2), (1, "B", 1, 2)]


def test_texts_with_carriage_returns_are_tidied(spark, tmp_path):
    d = written(spark, tmp_path, documents=([(1, "a  \r\n\r\n\r\nb \rc\r\n"), (2, "a \n"), (3, None)], "doc_id bigint, text string"))
    assert sorted(map(tuple, QUERIES["tidy_text"](spark, d).collect())) == [(1, "a\n\nb\nc\n"), (2, "a\n")]


def test_history_search_sees_every_process(spark, tmp_path):
    events = [(i, i, datetime(2026, 1, 1 + i), "click" if i else "view") for i in range(4)]
    d = written(spark, tmp_path, events=(events, "event_id bigint, user_id bigint, ts timestamp, event_type string"))
    assert [r.event_id for r in QUERIES["history_search"](spark, d).collect()] == [3, 2, 1]


def test_recursive_groups_begin_with_components(spark, tmp_path):
    clique = lambda ids: [(a, b, 0.9) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    one, two = [[f"{t}-{g}" for t in "ABCDEF"] for g in (1, 2)]
    three = ["G-1", "H-1", "I-1"]
    # the first tie makes one component of two families, the second one is too weak for that
    ties = [("A-1", "B-2", 0.75), ("C-1", "G-1", 0.65)]
    d = written(spark, tmp_path, sim_scores=(clique(one) + clique(two) + clique(three) + ties, "seq1 string, seq2 string, score double"), id_map=([("h", "A-9")], ID_MAP))
    got = {}
    for r in QUERIES["recursive_groups"](spark, d).collect():
        got.setdefault(r.grp, []).append(r.member)
    assert {g: sorted(m) for g, m in got.items()} == {"group_0_0": one, "group_0_1": two, "group_1": three}
