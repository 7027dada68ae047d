"""Work that is done once for a document or a block, not for each pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import retrieval as I

WORDS = lambda text: F.split(text, " ")


@pytest.mark.parametrize("dense", [0.0, 0.05, 2.0])
def test_search_scores_blocks_and_makes_no_row_of_a_product(spark, monkeypatch, dense):
    for name, value in (("QUERIES", 5), ("DOCS", 7), ("PRODUCTS", 11), ("DENSE", dense)):
        monkeypatch.setattr(I, name, value)
    draw = random.Random(3)
    texts = [" ".join(f"w{int(draw.paretovariate(0.6)) % 50}" for _ in range(draw.randint(0, 30))) for _ in range(80)]
    docs = spark.createDataFrame([(i, texts[i % 70] or None) for i in range(80)], "doc_id long, text string").repartition(3)
    index = I.Bm25Index(docs, WORDS)
    asked = docs.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "text")
    found = index.search(asked, 4)
    assert "token" not in found._jdf.queryExecution().executedPlan().toString()
    everything = [(q, d, 0.0) for q in range(0, 80, 5) for d in range(80)]
    scored = {(r["query_id"], r["doc_id"]): r["score"] for r in index.scores(asked).collect()}
    best: dict = {}
    for q, d, _ in everything:
        best.setdefault(q, []).append((-round(scored.get((q, d), 0.0), 9), d))
    expected = sorted((q, d, rank + 1) for q, all_ in best.items() for rank, (_, d) in enumerate(sorted(all_)[:4]))
    rows = found.collect()
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in rows) == expected
    assert all(r["score"] == pytest.approx(scored.get((r["query_id"], r["doc_id"]), 0.0)) for r in rows)


DOCS = [(1, "aXbXaaXX"), (2, "x" * 200 + "pump" + "y" * 49 + "pump"), (3, None), (4, "aaaa 𠮷a aa"), (5, "")]
TERMS = [(1, "X"), (1, "aX"), (1, "no"), (2, "pump"), (2, "pump"), (3, "X"), (4, "aa"), (4, "a"), (9, "X")]


def sources(spark):
    return spark.createDataFrame(TERMS, "doc_id long, term string"), spark.createDataFrame(DOCS, "doc_id long, text string")


def test_contexts_by_document(spark):
    terms, docs = sources(spark)
    plain = terms.distinct().join(docs.filter("text IS NOT NULL"), "doc_id").select("doc_id", "term", T.contexts(F.col("text"), F.col("term")).alias("contexts"))
    assert sorted(map(tuple, I.term_contexts(terms, docs).collect())) == sorted(map(tuple, plain.collect()))


def test_faster_patterns_match_the_same(spark):
    import re

    from termloom.functions import patterns as P
    from termloom.operators import candidates as C

    draw = random.Random(5)
    texts = ["".join(draw.choices("aZ9 0-~～ポン燃料", k=draw.randint(0, 40))) for _ in range(3000)] + ["", "ab12-c3d4 9x8y77z", "12ab12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ours = sorted(map(tuple, C.surfaces(docs, P.V4_PATTERNS).collect()))
    assert ours == sorted((i, m) for i, x in enumerate(texts) for p in P.V4_PATTERNS for m in re.findall(p, x))


def test_candidates_need_no_join(spark):
    from termloom.operators import candidates as C

    docs = spark.createDataFrame([(1, "pump pump ポンプ")], "doc_id long, text string")
    assert "Join" not in C.candidates_v4(docs)._jdf.queryExecution().executedPlan().toString()


def test_positions_by_document(spark):
    from termloom.operators import designed as N

    terms, docs = sources(spark)
    x = terms.distinct().join(docs.filter("text IS NOT NULL"), "doc_id").withColumn("at", N.positions(F.col("text"), F.col("term"))).filter(F.size("at") > 0)
    plain = x.select("doc_id", "term", F.size("at").cast("long"), N.distribution_score(F.col("at"), F.length("text")), N.position_score(F.col("at")[0], F.length("text")))
    ours = sorted(map(tuple, N.position_scores(terms, docs).collect()))
    assert ours == sorted(map(tuple, plain.collect()))


def test_profiles_shuffle_nothing_and_rank_each_row_by_itself(spark):
    from termloom.plans import profiles

    text = "ポンプの点検。ポンプと燃料ポンプの検査。Pump A1とPump A2を検査。検査装置と燃料ポンプ。\n# 装置 Turbo\n装置の検査装置"
    rows = [(1, text), (2, text), (2, text), (None, text), (3, None), (4, ""), (5, "。\n"), (6, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for extract, order in ((profiles.extract_semrerank, "rank"), (profiles.extract_v3, "pick")):
        out = extract(docs)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        found: dict = {}
        for r in out.collect():
            found.setdefault(r["doc_id"], []).append((r[order], r["term"], r["score"]))
        assert set(found) == {1, 2, None} and len(found[1]) > 3
        assert sorted(found[None]) == sorted(found[1]) and sorted(found[2]) == sorted(found[1] * 2)


@pytest.mark.parametrize("seed", range(3))
def test_many_graphs_are_iterated_as_each_alone(seed):
    import numpy as np

    from termloom.operators import by_document as D
    from termloom.operators import graphs as G

    draw = np.random.default_rng(seed)
    graphs = []
    for _ in range(60):
        n = int(draw.integers(1, 12))
        pairs = [(a, b, float(draw.random())) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.2]
        graphs.append((n, pairs, draw.random(n) * (draw.random(n) < 0.5)))
    for (n, pairs, personal), rank in zip(graphs, D._ranks(graphs, 0.85), strict=True):
        a, b, w = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int), np.array([p[2] for p in pairs])
        p = personal / personal.sum() if personal.sum() > 0 else np.full(n, 1 / n)
        alone = G.power_iteration(n, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), p, 0.85)
        assert rank == pytest.approx(alone, abs=1e-12)


def test_document_kernels_score_as_the_operators_do(spark, tmp_path):
    from pathlib import Path

    from termloom.operators import by_document as D
    from termloom.operators import candidates as C
    from termloom.operators import scores as S
    from termloom.plans import catalog

    rows = list(catalog.JAPANESE)
    if Path("/root/testdata/sf0.001/documents.parquet").exists():
        rows += [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    matches = {r[0]: r[1] for r in docs.select("doc_id", C.all_matches(F.col("text"), C.P.SIMPLE_PATTERNS)).collect()}
    cand = C.candidates_semrerank(docs)
    stats = S.tfidf_semrerank(S.text_statistics(cand, docs, T.sentences_all)).select("doc_id", "term", "tfidf")
    want = {(r["doc_id"], r["term"]): (r["freq"], r["base"]) for r in S.base_semrerank(S.cvalue(S.nesting(cand)).join(stats, ["doc_id", "term"])).collect()}
    got = {}
    for i, text in rows:
        made = D._semrerank_base(text, matches[i], 2, 10, 2) or ([], [], [], [])
        got.update({(i, t): (n, pytest.approx(b, abs=1e-12)) for t, n, b in zip(*made[:3], strict=True)})
    assert want == got and want
    cand = C.candidates_v3(docs)
    stats = S.tfidf_v3(S.text_statistics(cand, docs)).select("doc_id", "term", "tfidf")
    base = S.base_v3(S.cvalue(S.nesting(cand)).join(stats, ["doc_id", "term"])).selectExpr("doc_id", "term", "freq", "base AS score")
    want = {(r["doc_id"], r["term"]): r["score"] for r in C.prefiltered(C.damped_stopwords(base)).collect()}
    got = {}
    for i, text in rows:
        made = D._v3_nodes(text, matches[i], 2, 15, 10**9) or ([], [], [])
        got.update({(i, t): pytest.approx(b, abs=1e-12) for t, b in zip(*made[:2], strict=True)})
    assert want == got and want
