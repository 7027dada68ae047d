"""Hand-checked fixtures of the scoring formulas."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import predicates as is_
from termloom.functions import text as T
from termloom.functions.vectors import cosine
from termloom.operators import candidates as C
from termloom.operators import graphs as G
from termloom.operators import ranking as R
from termloom.operators import retrieval as I
from termloom.operators import scores as S

LATIN = "pump pumps pumping pump.\nThe pump moves oil. Oil pumps use oil.\nThe oil pump and the pumping unit"
JAPANESE = "水素燃料タンクの検査。水素燃料の貯蔵タンクは高圧。\n高圧タンクの検査と水素燃料の検査。HX20型とHX20。"
# term: (freq, text count, df, longer, their freq, cvalue v4, cvalue, tfidf v4, base)
LATIN_ROWS = {
    "The": (2, 2, 2, 0, 0, 2.772589, 3.169925, 0.032849, 0.854771),
    "oil": (3, 3, 2, 0, 0, 4.158883, 4.754888, 0.045989, 1.279857),
    "pump": (4, 8, 3, 2, 4, 4.828314, 4.0, 0.086735, 1.509208),
    "pumping": (2, 2, 2, 0, 0, 4.158883, 5.61471, 0.032849, 1.270659),
    "pumps": (2, 2, 2, 0, 0, 3.583519, 4.643856, 0.032849, 1.09805),
}
JAPANESE_ROWS = {
    "HX": (2, 2, 1, 1, 2, 0.0, 0.0, 0.087104, 0.060973),
    "HX20": (2, 2, 1, 0, 0, 3.218876, 4.0, 0.087104, 1.026636),
    "タンク": (3, 3, 3, 0, 0, 4.158883, 4.754888, 0.077836, 1.30215),
    "検査": (3, 3, 2, 0, 0, 3.295837, 3.0, 0.096143, 1.056051),
    "水素燃料": (3, 3, 3, 0, 0, 4.828314, 6.0, 0.077836, 1.50298),
    "高圧": (2, 2, 2, 0, 0, 2.197225, 2.0, 0.068674, 0.707239),
}


@pytest.mark.parametrize("text,want", [(LATIN, LATIN_ROWS), (JAPANESE, JAPANESE_ROWS)])
def test_scores(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cand = C.candidates_v4(docs, headings=False)
    x = S.nesting(S.tfidf_v4(S.text_statistics(cand, docs)))
    x = S.cvalue(x).withColumnRenamed("cvalue", "published")
    got = {r["term"]: r for r in S.base_v4(S.cvalue_v4(x)).collect()}
    assert set(got) == set(want)
    for term, (freq, found, df, n, f, v4, published, tfidf, base) in want.items():
        r = got[term]
        assert (r["freq"], r["n_found"], r["df"], r["n_longer"], r["f_longer"]) == (freq, found, df, n, f)
        assert [r["cvalue"], r["published"], r["tfidf"], r["base"]] == pytest.approx([v4, published, tfidf, base], abs=2e-6)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("term,model,garbage", [("6DE-18", True, False), ("L28ADF", True, False), ("HX20", True, False), ("pump", False, False), ("ス", False, True), ("この装置", False, True), ("当該船", False, True), ("タンク", False, False)])
def test_predicates(spark, term, model, garbage):
    assert one(spark, is_.is_model_number(F.lit(term))) is model
    assert one(spark, is_.is_garbage(F.lit(term))) is garbage


@pytest.mark.parametrize("a,b,want", [("night", "nacht", 1 / 7), ("a", "a", 1.0), ("a", "b", 0.0)])
def test_jaccard(spark, a, b, want):
    assert one(spark, T.jaccard(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize("term,factor", [("アンモニア", 1.0), ("アンモニア燃料", 1.3), ("6L28ADF", 1.0)])
def test_complexity(spark, term, factor):
    x = spark.createDataFrame([(1, term, 1.0)], "doc_id long, term string, base double")
    assert S.complexity_bonus(x).first()["base"] == pytest.approx(factor)


def test_heading_lines(spark):
    text = "第1章 概要\n【重要】次\nIMPORTANT NOTICE\n第1章概要\n　1.　はじめに検査"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r["term"] for r in C.heading_terms_v4(docs).collect()} == {"概要", "重要", "IMPORTANT", "NOTICE", "検査"}


def scored(spark, values):
    return spark.createDataFrame([(1, f"t{i}", float(v)) for i, v in enumerate(values)], "doc_id long, term string, score double")


def test_elbows(spark):
    x = scored(spark, [10, 9, 8.5, 4, 3.8, 3.7, 1])
    assert R.elbow_absolute(x).first()["elbow"] == 4
    assert R.validation_count(x).first()["count"] == 7
    assert R.elbow_absolute(scored(spark, [2, 1])).first()["elbow"] == 2


def test_normalisation(spark):
    f = lambda v, g: sorted(r["x"] for r in scored(spark, v).select(g(F.col("score")).alias("x")).collect())
    assert f([7], S.min_max) == [1.0]
    assert f([7, 7], S.min_max) == [0.5, 0.5]
    assert f([1, 3], S.min_max) == [0.0, 1.0]
    assert f([1, 3], S.to_unit) == [0.01, 1.0]


@pytest.mark.parametrize("n,want", [(10, 15), (100, 25), (1000, 50)])
def test_budget(spark, n, want):
    assert one(spark, S.definition_budget(F.lit(n))) == want


def test_substring_duplicates(spark):
    x = spark.createDataFrame([(1, "ab", 0.05), (1, "abc", 0.2), (1, "abcd", 1.0)], "doc_id long, term string, score double")
    assert [r["term"] for r in R.drop_substrings(x, 0.3).collect()] == ["abcd"]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "abca"), (2, "bcd"), (3, "aa"), (4, "xyz")], "doc_id long, text string")
    index = I.Bm25Index(docs)
    assert index.average == 3.0
    hits = index.search(spark.createDataFrame([(9, "ab")], "query_id long, text string"), 4).orderBy("doc_id").collect()
    assert [r["score"] for r in hits] == pytest.approx([1.49712, 0.693147, 1.109035, 0.0], abs=1e-5)
    assert not index.search(spark.createDataFrame([(9, "")], "query_id long, text string"), 2).filter("score > 0").count()


def test_rank_fusion(spark):
    lists = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 2, 1), (0, 1, 2)], "query_id int, doc_id int, rank int")
    got = {r["doc_id"]: r["rrf_score"] for r in I.reciprocal_ranks(lists).collect()}
    assert got == pytest.approx({1: 0.03252247, 2: 0.03252247, 3: 0.01587302}, abs=1e-8)


def test_pagerank(spark):
    nodes = spark.createDataFrame([(1, f"n{i}", float(i == 0)) for i in range(4)], "doc_id long, node string, personal double")
    edges = spark.createDataFrame([(1, "n0", "n1", 0.9), (1, "n1", "n2", 0.6)], "doc_id long, a string, b string, weight double")
    want = [0.384324, 0.459459, 0.156216, 0.0]
    got = [r["rank"] for r in G.pagerank(nodes, edges, rounds=500, tolerance=1e-12).orderBy("node").collect()]
    assert got == pytest.approx(want, abs=1e-5)
    flat = [r["rank"] for r in G.pagerank_distributed(nodes.drop("doc_id"), edges.drop("doc_id"), rounds=60).orderBy("node").collect()]
    assert flat == pytest.approx(want, abs=1e-4)
    assert G.power_iteration(1, np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.ones(1)) == pytest.approx([1.0])


def test_text_edges(spark):
    assert one(spark, T.count_of(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(spark, T.trimmed(F.lit("　 x "))) == "x"
    assert one(spark, F.length(F.lit("𠮷"))) == 1
    assert one(spark, T.sentences(F.lit(""))) == [""]
    assert one(spark, T.sentences(F.lit("a\n \nb。"))) == ["a", "b"]
    assert one(spark, T.contexts(F.lit("xx ab yy"), F.lit("ab"), 1)) == [" ab "]
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, T.nfkc(F.lit("ＡＢ"))) == "AB"
