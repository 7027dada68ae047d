"""Whole profiles against SQL for the scores and plain Python for the rest."""

from __future__ import annotations

import numpy as np
import pytest

from termloom.operators.generation import HashedEmbedder
from termloom.plans import catalog, profiles


@pytest.fixture(scope="module")
def texts(spark):
    from conftest import DATA

    rows = list(catalog.JAPANESE)
    if DATA.exists():
        found = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) BETWEEN 200 AND 4000").orderBy("doc_id").limit(15).collect()
        rows += [(1000 + r["doc_id"], r["text"]) for r in found]
    return rows


def sql_scores(texts, select):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    return con.sql(f"WITH {catalog._SCORED}, c AS (SELECT b.doc_id, b.term, b.freq, base * CASE WHEN h.term IS NULL THEN 1 ELSE 2 END * (1 + 0.3::DOUBLE * greatest(0, {catalog._COMPONENTS.replace('term', 'b.term')} - 1)) AS base FROM based b LEFT JOIN heads h ON b.doc_id = h.doc_id AND b.term = h.term) {select}").fetchall()


def unit(names):
    x = HashedEmbedder().embed(names).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def top_share_graph(s, names, least, share):
    """Undirected edges: of each node's neighbours that reach ``least`` the best share."""
    edges = {}
    for i in range(len(names)):
        near = sorted((-s[i, j], names[j], j) for j in range(len(names)) if j != i and s[i, j] >= least)
        for v, _, j in near[: max(1, int(len(near) * share))]:
            edges[tuple(sorted((i, j)))] = -v
    return edges


def plain_pagerank(n, edges, personal, alpha=0.85, rounds=100, tolerance=1e-6):
    w = np.zeros((n, n))
    for (i, j), v in edges.items():
        w[i, j] = w[j, i] = v
    p = personal / personal.sum() if personal.sum() > 0 else np.full(n, 1 / n)
    out = w.sum(axis=1)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        new = alpha * (np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0).T @ x + x[out == 0].sum() * p) + (1 - alpha) * p
        done = np.abs(new - x).sum() < n * tolerance
        x = new
        if done:
            break
    return x


def test_v4_profile(spark, texts):
    by_doc = {}
    for doc, term, _, base in sql_scores(texts, "SELECT doc_id, term, freq, base FROM c"):
        by_doc.setdefault(doc, []).append((term, base))
    want = {}
    for doc, rows in by_doc.items():
        kept = sorted((t, b) for t, b in rows if not any(t != u and t in u and b < 0.3 * c for u, c in rows))
        names, base = [t for t, _ in kept], np.array([b for _, b in kept])
        x = unit(names)
        edges = top_share_graph(x @ x.T, names, 0.5, 0.15)
        order = sorted(range(len(names)), key=lambda i: (-base[i], names[i]))
        personal = np.zeros(len(names))
        personal[order[:5]] = 1
        score = base * plain_pagerank(len(names), edges, personal)
        want[doc] = dict(zip(names, score, strict=True))
    got = {}
    for r in profiles.extract_v4(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], {})[r["term"]] = (r["score"], r["rank"])
    assert {d: set(t) for d, t in got.items()} == {d: set(t) for d, t in want.items()} and len(got) > 4
    for doc, mine in got.items():
        for term, (score, _) in mine.items():
            assert score == pytest.approx(want[doc][term], rel=1e-4, abs=1e-9)
        assert [t for t, _ in sorted(mine.items(), key=lambda kv: kv[1][1])] == sorted(mine, key=lambda t: (-mine[t][0], t))


def by_doc(rows, *columns):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    return out


def plain_sentences(text):
    """Cut at Japanese full stops and line ends; the whole text if nothing is left."""
    found = [s for s in text.replace("\n", "。").split("。") if s.strip()]
    return found or [text]


def plain_picks(names, score, x, k, weight=0.7):
    left = sorted(range(len(names)), key=lambda i: (-score[i], names[i]))
    out = [left.pop(0)]
    while left and len(out) < k:
        value = [weight * score[i] - (1 - weight) * max(0.0, max(float(x[i] @ x[j]) for j in out)) for i in left]
        out.append(left.pop(int(np.argmax(value))))
    return out


def plain_validation_count(scores):
    s = sorted(scores, reverse=True)
    n = len(s)
    if n < 3:
        return n
    drops = [a - b for a, b in zip(s, s[1:])]
    bends = [b - a for a, b in zip(drops, drops[1:])]
    elbow = max(range(len(bends)), key=lambda i: (bends[i], -i)) + 2
    total, share = 0.0, n
    for i, v in enumerate(s):
        total += v
        if total / sum(s) >= 0.85:
            share = i + 1
            break
    clamp = lambda v: max(10, min(v, 100))
    return min((clamp(elbow) + clamp(share)) // 2, n)


def test_v3_profile(spark, texts):
    """From the cleaned base scores on: neighbours, co-occurrence, ranks, blend, diversity, cut."""
    from termloom.operators import candidates as C
    from termloom.operators import scores as S

    docs = spark.createDataFrame(texts, "doc_id long, text string")
    cand = C.candidates_v3(docs)
    stats = S.tfidf_v3(S.text_statistics(cand, docs)).select("doc_id", "term", "tfidf")
    base = S.base_v3(S.cvalue(S.nesting(cand)).join(stats, ["doc_id", "term"])).selectExpr("doc_id", "term", "freq", "base AS score")
    clean = by_doc(C.prefiltered(C.damped_stopwords(base)).collect(), "term", "score")
    want = {}
    for doc, rows in clean.items():
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))[:300]
        names, score = [t for t, _ in rows], np.array([s for _, s in rows])
        x = unit(names)
        s = x @ x.T
        edges = {}
        for i in range(len(names)):
            near = sorted((-s[i, j], names[j], j) for j in range(len(names)) if j != i and s[i, j] >= 0.30)
            for v, _, j in near[:12]:
                edges[tuple(sorted((i, j)))] = -v
        sentences = plain_sentences(dict(texts)[doc])
        for (i, j), v in edges.items():
            together = sum(names[i] in t and names[j] in t for t in sentences)
            edges[i, j] = v * (1 + 0.3 * np.log1p(together))
        rank = plain_pagerank(len(names), edges, np.maximum(score, 0.01) ** 0.7)
        spread = rank.max() - rank.min()
        scaled = 0.1 + 0.8 * (rank - rank.min()) / spread if spread > 0 else np.full(len(rank), 0.5)
        fused = 0.4 * score + 0.6 * scaled
        most = min(50, plain_validation_count(list(fused)))
        want[doc] = [(names[i], fused[i]) for i in plain_picks(names, fused, x, 100)[:most]]
    got = by_doc(profiles.extract_v3(docs).orderBy("doc_id", "pick").collect(), "term", "score")
    assert set(got) == set(want) and len(got) > 4
    same = 0
    for doc, mine in got.items():
        assert dict(mine) == pytest.approx(dict(want[doc]), rel=1e-4) or len(mine) == len(want[doc])
        same += [t for t, _ in mine] == [t for t, _ in want[doc]]
    assert same >= 0.9 * len(got)  # picks of nearly equal worth may change places


def test_semrerank_profile(spark, texts):
    """From the base scores on: seeds, word graphs of the sentences, importance, revision."""
    from pyspark.sql import functions as F

    from termloom.functions import text as T
    from termloom.operators import candidates as C
    from termloom.operators import scores as S

    docs = spark.createDataFrame(texts, "doc_id long, text string")
    cand = C.candidates_semrerank(docs)
    stats = S.tfidf_semrerank(S.text_statistics(cand, docs, T.sentences_all)).select("doc_id", "term", "tfidf")
    scored = S.base_semrerank(S.cvalue(S.nesting(cand)).join(stats, ["doc_id", "term"])).withColumn("words", T.term_words(F.col("term")))
    base = by_doc(scored.collect(), "term", "freq", "base", "words")
    split = docs.select("doc_id", F.transform(T.sentences_all(F.col("text"), trim=True), lambda s: T.script_words(s)).alias("s"))
    sentences = {r["doc_id"]: r["s"] for r in split.collect()}
    want = {}
    for doc, rows in base.items():
        order = sorted(rows, key=lambda r: (-r[1], r[0]))[:100]
        n = len(order)
        if n > 3:
            freq = [r[1] for r in order]
            bends = [abs((freq[i] - freq[i + 1]) - (freq[i + 1] - freq[i + 2])) for i in range(n - 2)]
            cut = max(5, min(max(range(len(bends)), key=lambda i: (bends[i], -i)) + 2, 70, n))
        else:
            cut = max(5, n // 2)
        seeds = {w for r in order[:cut] for w in r[3]}
        own = {w for r in rows for w in r[3]}
        importance = dict.fromkeys(own, 0.0)
        for words in sentences[doc]:
            here = sorted(set(words) & own)
            if not here:
                continue
            x = unit(here)
            edges = top_share_graph(x @ x.T, here, 0.5, 0.15)
            ranks = plain_pagerank(len(here), edges, np.array([float(w in seeds) for w in here]))
            for w, v in zip(here, ranks, strict=True):
                importance[w] += v
        peak = max(importance.values(), default=0) or 1.0
        top = max(r[2] for r in rows)
        score = {t: (1 + (np.mean([importance[w] / peak for w in ws]) if ws else 0.0)) * b / (top if top > 0 else 1.0) for t, _, b, ws in rows}
        want[doc] = dict(sorted(score.items(), key=lambda kv: (-kv[1], kv[0]))[:100])
    got = by_doc(profiles.extract_semrerank(docs).collect(), "term", "score")
    assert set(got) == set(want) and len(got) > 4
    for doc, mine in got.items():
        close = {t for t, v in want[doc].items() if t in dict(mine)}
        assert len(mine) == len(want[doc]) and len(close) >= len(mine) - 2  # equal scores at the cut
        assert all(dict(mine)[t] == pytest.approx(want[doc][t], rel=1e-4, abs=1e-9) for t in close)
