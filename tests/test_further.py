"""Chains, hierarchies, reports and the smaller operators, each on cases worked out by hand."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions.vectors import on_circle
from termloom.operators import clustering as K
from termloom.operators import designed as N
from termloom.operators import generation as L
from termloom.operators import ranking as R
from termloom.operators import retrieval as I
from termloom.plans import chains, evaluation, hierarchy
from termloom.sources import loaders, sinks

DOCS = [(1, "ポンプは水を送る。弁は流れを止める。"), (2, "弁の検査は毎月行う。"), (3, "pump pressure valve pump"), (4, "valve test")]
ECHO = L.StubClient(lambda p: p.split("Context:\n", 1)[-1].strip())


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def words(text):
    return F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))


def terms(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, term string")


def test_chains(spark):
    d = docs(spark).filter("doc_id > 2")
    index, vectors = I.Bm25Index(d, words), L.embed(d).select(F.col("doc_id").alias("id"), "embedding")
    out = chains.hybrid_definition(index, ECHO, k=1)(terms(spark, (1, "pump"), (2, "test"))).collect()
    assert {r["query_id"]: r["definition"] for r in out} == {1: "[bm25] pump pressure valve pump", 2: "[bm25] valve test"}
    both = chains.hybrid_definition(index, ECHO, vectors, k=2)(terms(spark, (1, "pump"))).first()["definition"]
    assert both.split("\n")[0] == "[vector] pump pressure valve pump" and "valve test" in both
    near = chains.vector_definition(vectors, d, ECHO, k=1)(terms(spark, (1, "valve test"))).first()["definition"]
    assert near == "valve test"


def test_context_of_a_term(spark):
    d = docs(spark).filter("doc_id > 2")
    index = I.Bm25Index(d, words)
    asked = terms(spark, (1, "pump  test"), (2, "unknown"))
    got = {r["query_id"]: r["context"].split("\n") for r in hierarchy.term_contexts(asked, index).collect()}
    assert sorted(got[1]) == ["pump pressure valve pump", "valve test"] and got[2] == [DOCS[2][1], DOCS[3][1]]
    vectors = L.embed(d).select(F.col("doc_id").alias("id"), "embedding")
    assert hierarchy.term_contexts(terms(spark, (1, "valve test")), index, vectors, d, k=1).first()["context"] == "valve test"
    assert hierarchy.term_contexts(asked).filter("context = ''").count() == 2
    assert index.cleared().search(asked.select("query_id", F.col("term").alias("text"))).count() == 0 and index.cleared().size == 0


def test_hierarchy_and_its_definitions(spark):
    near = {"エンジン": "燃料を燃やす機関である", "燃料エンジン": "燃料を燃やす機関であるの", "アンモニア燃料エンジン": "燃料を燃やす機関であるのだ", "弁": "流れを止める部品", "逆止弁": "流れを止める部品の"}
    rows = [(1, t, x) for t, x in near.items()] + [(2, "一語", "ただ一つの定義"), (1, "空", "")]
    clusters, inside = hierarchy.term_hierarchy(spark.createDataFrame(rows, "doc_id long, term string, definition string"))
    names = {}
    for r in inside.collect():
        assert r["doc_id"] == 1
        names.setdefault(r["cluster_id"], set()).add(r["term"])
    assert {"エンジン", "燃料エンジン", "アンモニア燃料エンジン"} in names.values() and {"弁", "逆止弁"} <= set().union(*names.values())
    nodes = {r["cluster_id"]: r for r in clusters.collect()}
    assert all(nodes[c]["representative"] == min(t, key=lambda x: (len(x), x)) for c, t in names.items())
    assert all(n["parent_id"] is None or n["parent_id"] in nodes for n in nodes.values())
    client = L.StubClient(lambda p: json.dumps({"category": "機関" if "エンジン" in p else "部品", "confidence": 0.5, "reason": "r"}))
    named, _ = hierarchy.term_hierarchy(spark.createDataFrame(rows, "doc_id long, term string, definition string"), client=client)
    leaf = next(c for c, t in names.items() if "エンジン" in t)
    assert {r["cluster_id"]: r["category"] for r in named.collect()}[leaf] == "機関"
    lines = {r["term"]: r["siblings"] for r in hierarchy.hierarchy_lines(named, inside, most=1).collect()}
    assert lines["エンジン"] == "【所属カテゴリ】機関\n【関連用語（同カテゴリ）】アンモニア燃料エンジン など（他1件）"
    d = docs(spark).filter("doc_id > 2")
    out = hierarchy.hierarchy_definitions(spark.createDataFrame([(1, "エンジン"), (2, "一語")], "doc_id long, term string"), named, inside, L.StubClient(lambda p: p), index=I.Bm25Index(d, words)).collect()
    by = {r["term"]: r["definition"] for r in out}
    assert "【所属カテゴリ】機関" in by["エンジン"] and "階層情報なし" in by["一語"] and "pump" in by["一語"]


def test_parents_by_descent(spark):
    # 10 -> 11, 12; 11 -> clusters 0 and 1; 12 -> cluster 2 and a point
    tree = spark.createDataFrame([(10, 11, None), (10, 12, None), (11, 13, 0), (11, 14, 1), (12, 15, 2), (12, 3, None), (13, 4, None)], "parent int, child int, child_label int")
    reps = spark.createDataFrame([(0, "a", 2), (1, "bb", 2), (2, "c", 2)], "cluster_id int, representative string, size long")
    out = {r["parent"]: (r["representative"], r["children"], r["level"]) for r in K.parents_by_descent(tree, reps).collect()}
    assert out == {10: ("親:a", [0, 1, 2], 1), 11: ("親:a", [0, 1], 1)}
    assert {r["parent"]: r["children"] for r in K.parents_from_tree(tree, reps).collect()} == {11: [0, 1]}


def test_subsumption_by_document(spark):
    inside = spark.createDataFrame([(1, 0, "valve"), (1, 1, "check valve"), (2, 0, "check valve"), (2, 1, "pump")], "doc_id long, cluster_id long, term string")
    pairs = K.subsumption_pairs(inside, ("doc_id",))
    assert [(r["doc_id"], r["parent_cluster"], r["child_cluster"], r["gap"]) for r in pairs.collect()] == [(1, 0, 1, 6)]
    clusters = inside.select("doc_id", "cluster_id", F.lit(0).alias("level"))
    out = {(r["doc_id"], r["cluster_id"]): (r["parent_id"], r["level"]) for r in K.attach_by_subsumption(clusters, pairs, ("doc_id",)).collect()}
    assert out == {(1, 0): (None, 0), (1, 1): (0, 1), (2, 0): (None, 0), (2, 1): (None, 0)}


def test_manual_seeds_win(spark):
    scored = spark.createDataFrame([(1, "a", 5.0), (1, "b", 9.0), (1, "c", 1.0)], "doc_id long, term string, freq double")
    manual = spark.createDataFrame([(1, "c"), (1, "a"), (1, "new"), (1, "a")], "doc_id long, term string")
    assert [(r["term"], r["rank"]) for r in R.seeds_semrerank(scored, manual=manual).orderBy("rank").collect()] == [("a", 1), ("c", 2), ("new", 3)]


def plain_mmr(rows, k, weight):
    grams = {t: {t[i : i + 2] for i in range(len(t) - 1)} for t, _ in rows}

    def like(a, b):
        if not grams[a] or not grams[b]:
            return float(a == b)
        return len(grams[a] & grams[b]) / len(grams[a] | grams[b])

    left = sorted(rows, key=lambda r: (-r[1], r[0]))
    out = [left.pop(0)]
    while left and len(out) < k:
        best = max(left, key=lambda r: weight * r[1] - (1 - weight) * max(like(r[0], o[0]) for o in out))
        left.remove(best)
        out.append(best)
    return [t for t, _ in out]


def test_mmr_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for doc in range(6):
        mine = [("".join(rng.choice(list("abc"), rng.integers(1, 6))) + str(i), float(rng.integers(1, 400)) / 100) for i in range(30)]
        rows += [(doc, t, s) for t, s in mine]
        want[doc] = plain_mmr(mine, 8, 0.7)
    out = R.mmr(spark.createDataFrame(rows, "doc_id long, term string, score double"), 8).collect()
    for doc, picks in want.items():
        assert [r["term"] for r in sorted((r for r in out if r["doc_id"] == doc), key=lambda r: r["pick"])] == picks
    many = spark.createDataFrame([(1, f"{i:03d}", float(i)) for i in range(400)], "doc_id long, term string, score double")
    assert R.mmr(many, 400).count() == 400 and R.mmr(many, 400, most=50).count() == 50


def plain_mutual_tree(x, min_samples):
    """Kruskal over all pairs."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(min_samples, len(x) - 1)]
    pairs = sorted((max(d[i, j], core[i], core[j]), i, j) for i, j in itertools.combinations(range(len(x)), 2))
    up, out = list(range(len(x))), []

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for w, i, j in pairs:
        if top(i) != top(j):
            up[top(i)] = top(j)
            out.append(w)
    return out


def test_density_clusters_by_brute_force():
    """The spanning tree's weights by another algorithm; separate groups are found whole, and
    every cut of the condensed tree is a component of the graph at that distance."""
    rng = np.random.default_rng(5)
    for k in range(10):
        x = rng.normal(size=(25, 3))
        assert K.mutual_reachability_tree(x, 1 + k % 3)[:, 2] == pytest.approx(plain_mutual_tree(x, 1 + k % 3))
        groups = np.repeat(np.arange(4), 6)
        far = rng.normal(size=(24, 2)) * 0.05 + np.array([(0, 0), (9, 0), (0, 9), (9, 9)])[groups]
        labels, tree, _ = K.hdbscan(far, 3)
        assert len(set(labels[groups == 0])) == 1 and len({int(np.bincount(labels[groups == g][labels[groups == g] >= 0]).argmax()) for g in range(4)}) == 4
        size = {}
        for parent, child, _, n in tree:
            size[child] = n
            assert n == 1 or n >= 3
        assert sum(n for p, c, _, n in tree if c < 24) == 24


def test_small_operators(spark):
    x = spark.createDataFrame([(1, "b", 2.0, 1), (1, "a", 2.0, 0), (1, "a", 9.0, 2), (1, "c", 0.5, 3)], "doc_id long, term string, score double, ord int")
    assert sorted((r["term"], r["score"]) for r in R.first_per_term(x).collect()) == [("a", 2.0), ("b", 2.0), ("c", 0.5)]
    assert R.at_least(x, 2.0).count() == 3
    one = spark.range(1)
    got = one.select(N.keyword_score(F.lit(9)).alias("k"), N.total_score(*[F.lit(float(v)) for v in (1, 2, 3, 4, 5)]).alias("t"), N.blended(*[F.lit(float(v)) for v in (1, 2, 3)]).alias("b"), N.expanded_query(F.lit("q"), F.array(*[F.lit(c) for c in "abcdefg"])).alias("e"), L.with_context(F.lit("t"), F.lit("x" * 60)).alias("w")).first()
    assert got["k"] == 10 and got["t"] == pytest.approx(1 + 0.6 + 0.6 + 1.6 + 5) and got["b"] == pytest.approx(0.2 + 0.6 + 1.5) and got["e"] == "q a b c d e" and got["w"] == "t [SEP] " + "x" * 50
    assert one.select(N.keyword_score(F.lit(2)).alias("k")).first()["k"] == 3.0
    parts = spark.createDataFrame([(1, "valve", 2.0), (1, "check valve", 3.0), (1, "valves", 1.0), (1, "pump", 0.1)], "doc_id long, term string, score double")
    assert sorted(r["term"] for r in N.without_parts(parts, 0.5).collect()) == ["check valve", "valves"]
    q = spark.createDataFrame([("一。二。三。四",), ("短い。文",), ("あ" * 1200,)], "t string").select(I.query_of(F.col("t")).alias("q")).collect()
    assert [r["q"] for r in q] == ["一。二。四", "短い。文", "あ" * 1000]
    places = spark.createDataFrame([(i,) for i in range(4)], "i int").select(*(c.alias(n) for c, n in zip(on_circle(F.col("i"), F.lit(4)), "xy", strict=True))).collect()
    assert [(round(r["x"]), round(r["y"])) for r in places] == [(1, 0), (0, 1), (-1, 0), (0, -1)]
    order = spark.createDataFrame([(1, None, "b"), (2, "a", "z"), (0, "b", "y")], "cluster_id int, category string, representative string")
    assert [r["cluster_id"] for r in K.display_order(order).collect()] == [2, 0, 1]
    v = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "id int, embedding array<double>")
    flat = [r["embedding"][0] for r in K.reduced(v, 1).orderBy("id").collect()]
    assert np.diff(flat) == pytest.approx([np.diff(flat)[0]] * 4) and abs(flat[4]) == pytest.approx(4 * 5**0.5)


def test_model_steps(spark):
    inside = spark.createDataFrame([(1, "弁", "止める"), (1, "逆止弁", None), (2, "x", "y")], "cluster_id long, term string, definition string")
    client = L.StubClient(lambda p: '```json\n{"category": "部品", "confidence": 0.9, "reason": "r"}\n```' if "弁" in p else "?")
    assert {r["cluster_id"]: (r["category"], r["confidence"]) for r in L.cluster_categories(inside, client).collect()} == {1: ("部品", 0.9), 2: ("クラスタ2", 0.0)}
    scored = spark.createDataFrame([(1, "a", 9.0), (1, "b", 8.0), (2, "c", 9.0), (2, "d", 1.0), (3, "e", 5.0), (3, "f", 4.9)], "cluster_id long, term string, score double")
    pick = L.StubClient(lambda p: '{"keep_terms": ["b"], "reason": "r"}' if "a\nb" in p else "nothing")
    assert sorted(r["term"] for r in L.chosen_in_clusters(R.keep_top_in_cluster(scored), pick).collect()) == ["b", "c", "e"]
    t = spark.createDataFrame([("弁", "f")], "term string, field string")
    assert L.similar_terms(t).first()["similar"] == "なし" and L.similar_terms(t, L.StubClient(lambda p: p[:4])).first()["similar"] == "List"
    assert "used in f" in L.define_alone(t, L.StubClient(lambda p: p)).first()["context_free_definition"]


def test_evaluating_a_file(spark, tmp_path):
    found = {"results": [{"terms": [{"term": "弁", "definition": "流れを止める部品", "metadata": {"field": "船"}}, {"term": "泵", "definition": "水を送る", "metadata": {}}]}, {"terms": [{"term": "空", "definition": "", "metadata": {}}, {"term": "計", "definition": "計る道具", "metadata": {}}]}]}
    (tmp_path / "t.json").write_text(json.dumps(found), encoding="utf-8")
    client = L.StubClient(lambda p: "流れを止める部品" if "弁" in p else "わかりません" if "泵" in p else "全く別のもの zzz")
    summary, judged = evaluation.evaluate_file(spark, str(tmp_path / "t.json"), client)
    s = summary.first()
    assert (s["total"], s["unknown"], s["known"], s["explicitly_unknown"], s["similarity_unknown"], s["errors"]) == (4, 2, 1, 1, 1, 1)
    evaluation.main([str(tmp_path / "t.json"), str(tmp_path / "report"), "-t", "0.7"], spark, client)
    back = spark.read.json(str(tmp_path / "report" / "terms"))
    assert {r["status"]: r["n"] for r in back.groupBy("status").agg(F.count("*").alias("n")).collect()} == {"unknown": 2, "known": 1, "error": 1}
    assert spark.read.json(str(tmp_path / "report" / "summary")).first()["total"] == 4


def test_sinks_and_fallbacks(spark, tmp_path):
    clusters = spark.createDataFrame([(1, None, "a", "c1", 0.5), (2, 1, "b", "c2", 0.1)], "cluster_id long, parent_id long, representative string, category string, confidence double")
    inside = spark.createDataFrame([(1, "y"), (1, "x")], "cluster_id long, term string")
    out = sinks.hierarchy_json(clusters, inside).collect()
    assert [(r["representative"], json.loads(r["json"])) for r in out] == [("a", {"category": "c1", "confidence": 0.5, "terms": ["x", "y"], "cluster_id": 1})]
    assert loaders.pdf_or_text("本文".encode() + b"\xff.") == "本文."
    spark.sql("CREATE TABLE IF NOT EXISTS gone_soon (a INT) USING parquet LOCATION '" + str(tmp_path / "gone") + "'")
    sinks.drop_tables(spark, "gone_soon", "never_there")
    assert not spark.catalog.tableExists("gone_soon")
    assert [r["t"] for r in spark.createDataFrame([("abcdef",), ("abc",)], "s string").select(T.shortened(F.col("s"), 3).alias("t")).collect()] == ["abc...", "abc"]


def test_relations_and_duplicates(spark):
    pairs = spark.createDataFrame([("弁", "逆止弁", True, False), ("x", "y", False, True), ("b", "a", None, None)], "a string, b string, same_domain boolean, same_stem boolean")
    together = spark.createDataFrame([("a", "b", 20), ("弁", "逆止弁", 1)], "a string, b string, n long")
    got = {r["a"]: r["relation"] for r in N.relation_score(pairs, together).collect()}
    assert got == pytest.approx({"弁": 3 + 5 * 0.5 + 0.5 + 5, "x": 3.0, "b": 4.0})
    rows = [(1, "check valve", 4.0, 0), (1, "check valves", 2.0, 1), (1, "pump", 1.0, 2), (1, "check-valves", 1.0, 3), (2, "pump", 5.0, 0)]
    out = {(r["doc_id"], r["term"]): (r["score"], r["merged"]) for r in N.merged_duplicates(spark.createDataFrame(rows, "doc_id long, term string, score double, ord int")).collect()}
    assert out == {(1, "check valve"): (2.0, ["check valves", "check-valves"]), (1, "pump"): (1.0, []), (2, "pump"): (5.0, [])}


def test_parts_of_speech_by_domain(spark):
    rows = [("名詞", "一般", "圧力", "圧力"), ("動詞", "自立", "測る", "測る"), ("名詞", "接尾", "薬", "薬"), ("名詞", "接尾", "法", "法"), ("名詞", "サ変接続", "検査", "検査"), ("名詞", "固有名詞", "DNA", "dna"), ("名詞", "一般", "こと", "こと"), ("名詞", "一般", "a", "a")]
    t = spark.createDataFrame(rows, "pos string, kind string, surface string, norm string")
    cols = [F.col(c) for c in ("pos", "kind", "surface", "norm")]
    kept = lambda d: [r["surface"] for r in t.filter(N.noun_in_domain(*cols, d, ("こと",))).collect()]
    assert kept("general") == ["圧力", "検査", "DNA"] and kept("pharma") == ["圧力", "薬", "検査", "DNA"] and kept("legal") == ["圧力", "法", "検査", "DNA"]
    bonus = lambda d: [r["b"] for r in t.select(N.noun_bonus(cols[1], cols[2], d).alias("b")).collect()]
    assert bonus("general") == [0, 0, 0, 0, 2.0, 1.5, 0, 0] and bonus("pharma")[4] == 3.0 and bonus("it")[5] == 2.0


def test_definition_checks(spark):
    rows = [("弁", "短い", None), ("弁", "弁は" + "長い" * 50, "部品"), ("ポンプ", "水を送るためのシステムであり広く用いられている", None), ("ポンプ", None, "部品")]
    t = spark.createDataFrame(rows, "h string, d string, c string")
    got = [r["x"] for r in t.select(N.checked_definition(F.col("d"), F.col("h"), F.col("c")).alias("x")).collect()]
    assert got[0] == "それに関する専門用語" and got[1] == ("それは" + "長い" * 50)[: 77 + 1] + "..." and got[2] == "水を送るための仕組みであり広く用いられている" and got[3] == "それに関する部品用語"
    cuts = spark.createDataFrame([("短い定義。",), ("一文目。" + "二文目" * 20,), ("甲" * 30 + "、" + "乙" * 10 + "、" + "丙" * 30,), ("甲" * 60,)], "d string")
    assert [r["x"] for r in cuts.select(N.cut_definition(F.col("d")).alias("x")).collect()] == ["短い定義。", "一文目。", "甲" * 30 + "、" + "乙" * 10 + "等", "甲" * 60 + "等"]
    plain = spark.createDataFrame([("品質管理は製造の品質を管理する", ["品質", "管理"])], "d string, p array<string>")
    assert plain.select(N.without_circularity(F.col("d"), F.col("p")).alias("x")).first()["x"] == "製品の良し悪し監視と改善は製造の製品の良し悪しを監視と改善する"
