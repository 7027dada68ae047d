"""The candidate step of decontamination against the check run on every passage."""

from __future__ import annotations

import numpy as np

from termloom.llm import decontaminate as d


def accepted(texts: list[list[str]], items: list[list[str]]) -> dict[int, set[int]]:
    """Plain version: the check at every passage of every text."""
    ids = {w: i + 1 for i, w in enumerate(sorted({w for x in items for w in x}))}
    coded = [np.array([ids[w] for w in x]) for x in items]
    out: dict[int, set[int]] = {}
    for n, words in enumerate(texts):
        row = np.array([ids.get(w, 0) for w in words])
        for k, item in enumerate(coded):
            for here in range(0, len(row), d.STRIDE):
                near = row[max(0, here - len(item)) : here + d.PASSAGE + len(item)]
                if d.verdict(d.Pattern(item), d.Pattern(item[-d.ANSWER_WORDS :]), near, d.SURE, d.LIKELY) is not None:
                    out.setdefault(n, set()).add(k)
    return out


def test_no_accepted_text_is_lost(spark):
    """Exact copies and copies of which 10 to 40 % of the words, the rarer ones first, are
    replaced, within texts full of other benchmark words."""
    rng = np.random.default_rng(9)
    common, rare = [f"c{i}" for i in range(300)], [f"r{i}" for i in range(3000)]
    prose = lambda n: [str(rng.choice(common if rng.random() < 0.7 else rare)) for _ in range(n)]
    items = [prose(int(rng.integers(15, 60))) for _ in range(60)]
    pool = [w for x in items for w in x]
    texts = []
    for n in range(400):
        host = [str(w) for w in rng.choice(pool, int(rng.integers(40, 160)))]
        part = list(items[n % 60])
        share = n % 5 / 10
        body = sorted(range(len(part) - 5), key=lambda i: (part[i][0] != "r", i))
        for i in body[: int(share * len(part))]:
            part[i] = str(rng.choice(pool)) if i % 2 else f"new{i}"
        at = int(rng.integers(0, 40))
        texts.append(host[:at] + part + host[at:])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: set(r["item_ids"]) for r in d.contamination(df, bench).collect() if r["item_ids"]}
    want = accepted(texts, items)
    assert len(want) > 350 and got == want


def found(out):
    return sorted((r["doc_id"], tuple(r["item_ids"]), round(r["coverage"], 9)) for r in out.collect() if r["contaminated"])


def test_blocks_of_items_do_not_matter(spark):
    """The same rows for blocks of 1, 7 and 2,000 items, with null and shared ids."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(int(rng.integers(3, 40))) for _ in range(15)] + ["one two three four"]
    rows = [(i % 7 if i % 5 else None, f"{prose(30)} {items[i % 16] if i % 3 == 0 else ''} {prose(20)}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    key = df.selectExpr("struct(doc_id, n) AS key", "text")
    out = [d.contamination(key, bench, "key", block_items=n, block_words=w).selectExpr("key.n AS doc_id", "contaminated", "item_ids", "coverage") for n, w in ((1, 50_000), (7, 50_000), (2000, 50_000), (2000, 60))]
    assert all(x.count() == 60 for x in out)
    first = found(out[0])
    assert {i for i, _, _ in first} >= {i for i in range(0, 60, 3)} and all(found(x) == first for x in out[1:])
    by_id = d.contamination(df, bench, block_items=7).collect()
    assert len(by_id) == 60 and sum(r["contaminated"] for r in by_id) == len(first)


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "alpha beta gamma delta"), (2, "omega"), (3, "日本語の試験問題です。答えは四十二。"), (4, "..."), (5, None), (6, "ข้อสอบภาษาไทย")]
    docs = [(1, "x Alpha, beta gamma; delta y"), (2, "alpha beta delta gamma"), (3, "the omega point"), (4, "omegas"), (5, "前置き、日本語の試験問題です。答えは四十二。終わり"), (6, "日本語の別の文章"), (7, "... ..."), (8, "นี่คือข้อสอบภาษาไทยจริง"), (9, "alpha beta gamma"), (10, "delta")]
    out = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(i, k) for i, k, _ in found(out)] == [(1, (1,)), (3, (2,)), (5, (3,)), (8, (6,))]


def test_many_words_share_features(spark, monkeypatch):
    """A benchmark of more words than features: the same rows."""
    rng = np.random.default_rng(6)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    items = [prose(25) for _ in range(30)]
    df = spark.createDataFrame([(i, f"{prose(40)} {items[i % 30] if i % 2 else prose(25)}") for i in range(80)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert d.make_words([np.arange(1, 1000, dtype=np.uint64)]).features.max() == 999
    wide = found(d.contamination(df, bench))
    monkeypatch.setattr(d, "FEATURES", 64)
    assert d.make_words([np.arange(1, 1000, dtype=np.uint64)]).features.max() <= 64 and found(d.contamination(df, bench)) == wide and {i for i, _, _ in wide} == set(range(1, 80, 2))


def test_paraphrases_in_documents(spark):
    """Items of the benchmark with every fifth to tenth word replaced, put into documents: nine
    of ten are found at least, and no other document but those that hold an item already."""
    import pytest
    from conftest import DATA

    if not DATA.exists():
        pytest.skip("the driver's tables are not here")
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [r["text"].split() for r in bench.orderBy("item_id").collect()]
    rng = np.random.default_rng(8)
    pool = [w for x in items for w in x]
    planted, rows = set(), []
    for n, (i, text) in enumerate(docs):
        if n % 2 == 0:
            part = list(items[n % len(items)])
            for k in range(n % 5, len(part), 5 + n % 6):
                part[k] = str(rng.choice(pool))
            words = text.split()
            at = int(rng.integers(0, len(words) + 1))
            text = " ".join([*words[:at], *part, *words[at:]])
            planted.add(i)
        rows.append((i, text))
    before = {i for i, _, _ in found(d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench))}
    after = {i for i, _, _ in found(d.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench))}
    assert len(after & planted) >= 0.9 * len(planted) and after - planted <= before
