"""Fitted models against plain versions of their formulas."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import decontaminate, language_id, quality
from termloom.llm.common import crc_fold


def plain_risk(w, p, u, prior):
    out = lambda x: np.array([sum(np.tanh(sum(a * b for a, b in zip(row, w[0][:, k])) + w[1][k]) * w[2][k] for k in range(len(w[2]))) + w[3] for row in x])
    loss = lambda z: 1 / (1 + np.exp(z))
    positive, inner = prior * loss(out(p)).mean(), loss(-out(u)).mean() - prior * loss(-out(p)).mean()
    return positive, inner


@pytest.mark.parametrize("prior", [0.3, 0.99])
def test_positive_unlabelled_risk_and_gradient(prior):
    """The risk by its formula, and its gradient by differences: of the whole risk where the
    inner term is not negative, of the term alone, reversed, where it is."""
    signs = set()
    for seed in range(12):
        rng = np.random.default_rng(seed)
        w = [rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3) * 2, rng.normal(size=())]
        p, u = rng.normal(size=(4, 5)), rng.normal(size=(7, 5))
        total, inner, down = quality.risk(w, p, u, prior)
        plain_positive, plain_inner = plain_risk(w, p, u, prior)
        assert inner == pytest.approx(plain_inner) and total == pytest.approx(plain_positive + max(0, plain_inner))
        signs.add(inner >= 0)
        target = (lambda v: sum(plain_risk(v, p, u, prior))) if inner >= 0 else (lambda v: -plain_risk(v, p, u, prior)[1])  # noqa: B023
        for i in range(4):
            for at in np.ndindex(w[i].shape):
                lo, hi = ([x.copy() for x in w] for _ in range(2))
                lo[i][at] -= 1e-5
                hi[i][at] += 1e-5
                assert down[i][at] == pytest.approx((target(hi) - target(lo)) / 2e-5, abs=1e-6)
    assert True in signs


@pytest.mark.parametrize("share", [0.25, 0.6, 0.9])
def test_class_prior_of_a_known_mixture(share):
    rng = np.random.default_rng(1)
    draw = lambda n, shift: rng.normal(size=(n, 6)) + shift
    unlabelled = np.concatenate([draw(int(3000 * share), 1.5), draw(3000 - int(3000 * share), -1.5)])
    assert quality.class_prior(draw(1500, 1.5), unlabelled) == pytest.approx(share, abs=0.06)


def test_quality_query_against_its_formula(spark):
    """The query's scores are those of the model at the features of each whole text, and
    labels of held-out rows do not change them."""
    from conftest import DATA

    if not DATA.exists():
        pytest.skip("the driver's tables are not here")
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, usable=crc_fold(F.col("doc_id")) != 1)
    out = {r["doc_id"]: r for r in quality.op7_quality(spark, str(DATA)).collect()}
    for r in docs.collect():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        want = float(model.score(quality.features(raw, np.array([0, len(raw)])))[0])
        assert out[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-9) and out[r["doc_id"]]["predicted"] == int(want >= 0.5)
    turned = labels.withColumn("quality", F.when(crc_fold(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, turned, usable=crc_fold(F.col("doc_id")) != 1)
    assert all((a == b).all() for a, b in zip(model.weights, again.weights, strict=True))


def plain_kneser_ney(texts, letters, order=5):
    """Interpolated Kneser-Ney by its formula, over tuples of identifiers."""
    vocabulary = len(letters) + 2
    code = {c: i + 2 for i, c in enumerate(letters)}
    counts = [{} for _ in range(order + 1)]
    for text in texts:
        ids = [0] * (order - 1) + [0 if c == " " else code.get(c, 1) for c in text]
        for i in range(order - 1, len(ids)):
            gram = tuple(ids[i - order + 1 : i + 1])
            counts[order][gram] = counts[order].get(gram, 0) + 1
    for k in range(order - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] = counts[k].get(gram[1:], 0) + 1
    discount = []
    for k in range(order + 1):
        n1, n2 = (sum(v == x for v in counts[k].values()) for x in (1, 2))
        discount.append(min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2))))

    def p(history, c):
        k = len(history) + 1
        lower = p(history[1:], c) if history else 1 / vocabulary
        after = [v for g, v in counts[k].items() if g[:-1] == history]
        if not after:
            return lower
        own = counts[k].get((*history, c), 0)
        return max(0, own - discount[k]) / sum(after) + discount[k] * len(after) / sum(after) * lower

    return code, p


def test_scores_are_plain_kneser_ney(spark):
    """Cross-entropies of the fitted models against the formula, for whole texts."""
    corpus = {"a": ["abba cab", "bacca abac"], "b": ["dede fed", "feed deaf bead"]}
    letters = sorted(set("".join(sum(corpus.values(), []))) - {" "})
    shell = language_id.Model([], np.array([ord(c) for c in letters], np.uint32), [], [], np.zeros(0))
    grams = {}
    for name, texts in corpus.items():
        keys = [language_id.histories(shell.identifiers(np.array([ord(c) for c in t], np.uint32)), np.array([0, len(t)])) for t in texts]
        grams[name] = np.unique(np.concatenate(keys), return_counts=True)
    model = language_id.estimate(grams, shell.letters)
    for text in ("abba", "deaf cab", "xyz bead", "a"):
        raw = np.frombuffer(text.encode(), np.uint8)
        got, n, _ = model.entropies(raw, np.array([0, len(raw)]))
        for j, name in enumerate(model.languages):
            code, p = plain_kneser_ney(corpus[name], letters)
            ids = [0] * 4 + [0 if c == " " else code.get(c, 1) for c in text]
            want = -sum(np.log(p(tuple(ids[i - 4 : i]), ids[i])) for i in range(4, len(ids))) / len(text)
            assert n[0] == len(text) and got[0, j] == pytest.approx(want, rel=1e-5)


def test_long_texts_in_pieces():
    """Grams do not depend on where a long text is cut."""
    rng = np.random.default_rng(3)
    alphabet = ["a", "B", " ", ", ", "\n", "é", "ß", "日", "\U00020bb7", "7"]
    for k in range(60):
        text = "".join(rng.choice(alphabet, rng.integers(0, 90)))
        raw = np.frombuffer(text.encode(), np.uint8)
        whole = language_id.folded(raw, np.array([0, len(raw)]))[0].tolist()
        for size in (1, 2, 7, 30):
            got = [c for *_, chars, _, known in language_id.pieces(raw, np.array([0, len(raw)]), size) for c in chars[known:].tolist()]
            assert got == whole
            for *_, chars, _, known in language_id.pieces(raw, np.array([0, len(raw)]), size):
                assert known <= 4


def test_a_language_of_few_rows_is_learned(spark):
    """Whatever the ids of its rows are, also if all of them would only calibrate."""
    other = [(1000 + i, f"the quick brown fox number {i} jumps over the lazy dog", "en") for i in range(40)]
    for few in ([(3, "zażółć gęślą jaźń", "pl")], [(10, "zażółć gęślą jaźń", "pl"), (3, "gęślą zażółć", "pl")]):
        docs = spark.createDataFrame(other + few, "doc_id long, text string, lang string")
        model = language_id.fit(docs)
        assert model.languages == ["en", "pl"]
        got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
        assert got[3] == "pl" and got[1000] == "en"
    alone = spark.createDataFrame([(3, "zażółć gęślą jaźń", "pl")], "doc_id long, text string, lang string")
    assert language_id.identify(alone, language_id.fit(alone)).first()["lang_pred"] == "pl"


def test_latent_basis_is_that_of_the_exact_decomposition(spark):
    """The sketch's space against the singular vectors of all TF-IDF passages, and the cosines
    in it against theirs."""
    rng = np.random.default_rng(7)
    topics = [[f"t{k}w{i}" for i in range(25)] for k in range(6)]
    texts = [" ".join(str(rng.choice(topics[k % 6] if rng.random() < 0.9 else topics[(k + 1) % 6])) for _ in range(int(rng.integers(10, 150)))) for k in range(150)]
    words = decontaminate.make_words([decontaminate._of(" ".join(sum(topics, [])))])
    shared = spark.sparkContext.broadcast(words)
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").selectExpr("uid", "uid AS id", "text")
    encoded = decontaminate._encode(df, shared, "long")
    counts, passages = decontaminate.document_frequencies(encoded, shared)
    rows = []
    for text in texts:
        ids = words.lookup(decontaminate._of(text))
        for a in range(0, len(ids), decontaminate.PASSAGE):
            row = np.zeros(words.size)
            row[np.unique(ids[a : a + decontaminate.PASSAGE]) - 1] = 1
            rows.append(row)
    x = np.array(rows)
    assert passages == len(x) and (counts == x.sum(axis=0)).all()
    weights = np.concatenate(([0.0], np.log((passages + 1) / (counts + 0.5))))
    x = x * weights[1:]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, values, vectors = np.linalg.svd(x, full_matrices=False)
    for rank in (6, 40, words.size):
        basis = decontaminate.latent_basis(encoded, shared, weights, rank=rank)
        assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-6)
        kept, best = ((x @ basis) ** 2).sum(), (values[:rank] ** 2).sum()
        assert kept >= 0.93 * best  # one pass, without power iterations
        if rank == 6:  # a clear gap follows: the same six directions
            assert np.linalg.svd(vectors[:6] @ basis)[1].min() > 0.95
        if rank == words.size:
            y = x @ basis
            assert np.allclose(y @ y.T, x @ x.T, atol=1e-3)
