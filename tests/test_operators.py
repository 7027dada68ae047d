"""Kernels and operators that SQL does not check."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from termloom.operators import candidates as C
from termloom.operators import clustering as K
from termloom.operators import dictionary as D
from termloom.operators import generation as L
from termloom.operators import joins
from termloom.operators import ranking as R
from termloom.operators import similarity as V
from termloom.operators.components import connected_components

TOKENS = [("新型", "名詞"), ("機関", "名詞"), ("室", "名詞"), ("の", "助詞"), ("温度", "名詞"), ("計", "名詞"), ("は", "助詞")]


def tokens(spark):
    return spark.createDataFrame([(1, 0, i, s, p) for i, (s, p) in enumerate(TOKENS)], "doc_id long, sent_no int, pos int, surface string, pos_tag string")


def counts(df):
    return {r["term"]: r["freq"] for r in df.collect()}


def test_noun_phrases(spark):
    assert counts(C.noun_phrases(tokens(spark))) == {"新型機関室": 1, "温度計": 1}
    assert counts(C.noun_phrases_v3(tokens(spark))) == {"新型機関室": 2, "機関室": 1, "温度計": 1}
    assert counts(C.noun_ngrams(tokens(spark))) == {"新型機関": 1, "機関室": 1, "新型機関室": 1, "温度計": 1}


def test_prefilter(spark):
    x = spark.createDataFrame([(1, "データ", 1.0), (1, "弁", 1.0), (1, "2024", 1.0), (1, "圧力", 1.0), (1, "圧力容器", 1.0), (1, "１２３", 1.0)], "doc_id long, term string, score double")
    got = {r["term"]: (r["score"], r["contained"]) for r in C.prefiltered(x).collect()}
    assert got == {"圧力": (0.3, True), "圧力容器": (1.0, False)}


def test_components_of_a_hub(spark):
    """One node with 10^5 edges, chains that hang on it, and pairs apart from it."""
    hub = spark.range(100_000).selectExpr("7L AS a", "id + 1000 AS b")
    chain = spark.range(3000).selectExpr("id + 50000 AS a", "id + 200000 AS b")
    apart = spark.range(500).selectExpr("id * 2 + 900000 AS a", "id * 2 + 900001 AS b")
    got = connected_components(hub.union(chain).union(apart)).toPandas()
    label = dict(zip(got["node"], got["component"], strict=True))
    assert len(label) == 1 + 100_000 + 3000 + 1000
    assert all(c == (7 if n < 900_000 else n - n % 2) for n, c in label.items())


def test_join_spread_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST_HOT", 3)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 2), (3, 4), (None, 3), (9, 1)) for i in range(n)], "k int, i int")
    keyed = spark.createDataFrame([(1, "a", 50), (2, "b", 2), (3, "c", 4)], "k int, v string, n long")
    assert joins.join_spread(rows, keyed, "k", 60).count() == 56
    left = joins.join_spread(rows, keyed, "k", 60, how="left")
    assert left.columns == ["k", "i", "v"] and left.count() == 60 and left.filter("v IS NULL").count() == 4


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    label = {v: v for e in edges for v in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame(edges, "a int, b int"))
    real = {v for a, b in edges if a != b for v in (a, b)}
    assert {r["node"]: r["component"] for r in got.collect()} == {v: label[v] for v in real}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_mmr_prefers_the_different(spark):
    x = spark.createDataFrame([(1, "abcd", 1.0), (1, "abce", 0.95), (1, "zzzz", 0.9)], "doc_id long, term string, score double")
    assert [r["term"] for r in R.mmr(x, 2).orderBy("pick").collect()] == ["abcd", "zzzz"]


def test_hdbscan_finds_separate_groups(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (6, 2)) for c in (0, 5, 10)] + [np.array([[30.0, -30.0]])])
    label, tree, _ = K.hdbscan(x, 3)
    groups = [set(label[i : i + 6].tolist()) for i in (0, 6, 12)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and label[-1] == -1
    assert tree and (K.hdbscan(x[:1])[0] == -1).all()
    rows = spark.createDataFrame([(1, f"t{i:02}", v.tolist()) for i, v in enumerate(x)], "doc_id long, term string, embedding array<double>")
    assert K.cluster_labels(rows, 3).select("cluster_id").distinct().count() == 4
    assert K.cluster_tree(rows, 3).count() == len(tree)


def test_hierarchy(spark):
    reps = spark.createDataFrame([(0, "弁"), (1, "安全弁"), (2, "管")], "cluster_id int, representative string")
    tree = spark.createDataFrame([(10, 11, 0), (10, 12, 1), (13, 14, 2)], "parent int, child int, child_label int")
    r = K.parents_from_tree(tree, reps).collect()
    assert [(x["parent"], x["representative"], x["name"], x["children"]) for x in r] == [(10, "弁", "弁系", [0, 1])]
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "cluster_id int, level int")
    terms = spark.createDataFrame([(0, "弁"), (1, "安全弁"), (2, "管")], "cluster_id int, term string")
    got = {x["cluster_id"]: (x["parent_id"], x["level"]) for x in K.attach_by_subsumption(clusters, K.subsumption_pairs(terms)).collect()}
    assert got == {0: (None, 0), 1: (0, 1), 2: (None, 0)}


def test_similarity_blocks_give_all_pairs(spark):
    x = np.random.default_rng(0).normal(size=(50, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in itertools.combinations(range(50), 2) if u[i] @ u[j] >= 0.5}
    assert {(r["a"], r["b"]) for r in V.pairs_above(df, 0.5, block=7).collect()} == want
    hits = V.search(df.filter("id < 2"), df, 3).collect()
    assert {(r["query_id"], r["doc_id"]) for r in hits if r["rank"] == 1} == {(0, 0), (1, 1)} and len(hits) == 6


def test_dictionary(spark):
    known = spark.createDataFrame([("a", "x"), ("b", "y")], "term string, definition string")
    change = spark.createDataFrame([("b", "z", 1), ("c", "w", 2), ("c", "v", 3)], "term string, definition string, ord int")
    both = lambda df: {r["term"]: r["definition"] for r in df.collect()}
    assert both(D.upsert(known, change)) == {"a": "x", "b": "z", "c": "v"}
    assert both(D.new_terms(change, known)) == {"c": "w"}
    assert both(D.update(known, change.filter("term = 'b'"))) == {"a": "x", "b": "z"}
    assert both(D.remove(known, change)) == {"a": "x"}


def test_evaluation(spark):
    rows = [("t1", "d", "e", 0.9), ("t2", "d", "e", 0.1), ("t3", "d", "これは定義不明です", 0.9), ("t4", "", "e", 0.9), ("t5", None, None, None)]
    judged = D.evaluate(spark.createDataFrame(rows, "term string, original_definition string, context_free_definition string, similarity double"))
    assert {r["term"]: r["status"] for r in judged.collect()} == {"t1": "known", "t2": "unknown", "t3": "unknown", "t4": "error", "t5": "error"}
    s = D.evaluation_summary(judged).first()
    assert (s["total"], s["unknown"], s["known"], s["explicitly_unknown"], s["errors"]) == (5, 2, 1, 1, 2)
    assert D.shown(judged, 1, 1).count() == 2


def test_model_replies(spark):
    replies = spark.createDataFrame([("```json\n{\"is_technical\": true}\n```",), ('{"is_technical": false}',), ("not json",)], "reply string")
    got = [r[0] for r in replies.select(L.parsed(F.col("reply"), L.TERM_JUDGEMENT)["is_technical"]).collect()]
    assert got == [True, False, None]
    terms = spark.createDataFrame([("pump", "moves oil"), ("the", "an article"), ("x", None)], "term string, definition string")
    client = L.StubClient(lambda p: '```json\n{"is_technical": true}\n```' if "pump" in p else "?")
    assert [r["term"] for r in L.technical_only(terms, client).collect()] == ["pump"]
    pair = spark.createDataFrame([("a", "x", "b", "y", 0.8)], "term1 string, definition1 string, term2 string, definition2 string, similarity_score double")
    r = L.judged_synonyms(pair, L.StubClient(lambda p: '{"is_synonym": true}')).first()
    assert (r["relationship"], r["confidence"]) == ("不明", 0.0)


def test_retry_waits_for_rate_limits_only():
    waits, calls = [], []

    class Busy:
        def reply(self, prompts):
            calls.append(1)
            if len(calls) < 3:
                raise L.RateLimited
            return ["ok"]

    assert L.Retrying(Busy(), sleep=waits.append).reply(["p"]) == ["ok"] and waits == [10, 20]


def test_embedder_is_deterministic_and_unit():
    e = L.HashedEmbedder(16)
    x = e.embed(["pump", "pump", ""])
    assert (x[0] == x[1]).all() and abs(np.linalg.norm(x[0]) - 1) < 1e-6


def test_profiles_and_stream(spark, tmp_path):
    from termloom.plans.profiles import PROFILES, top_terms
    from termloom.streaming.terms import read_documents, write_terms

    text = "pump pumps pumping pump.\nThe pump moves oil. Oil pumps use oil.\nThe oil pump and the pumping unit"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, text.replace("pump", "valve"))], "doc_id long, text string")
    assert top_terms(docs, "v4", 3).count() == 2
    assert PROFILES.create("v3")(docs).count() > 0
    assert PROFILES.create("semrerank")(docs).count() > 0
    docs.write.parquet(str(tmp_path / "in"))
    q = write_terms(read_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == 2


def test_registry_refuses_unknown_names():
    import pytest

    from termloom.plans.profiles import PROFILES

    with pytest.raises(ValueError, match="unknown profile"):
        PROFILES.create("nothing")
