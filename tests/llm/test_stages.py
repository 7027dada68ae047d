"""Every stage of the pipeline on odd rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

LONG = " ".join(f"word{i % 997} of the long text" for i in range(4000))
ROWS = [
    (1, "the cat sat on the mat and the dog ran off", "en", "b"), (1, "the cat sat on the mat and the dog ran off", "en", "b"), (2, None, "en", None), (3, "", None, "a"),
    (None, "le chat est sur la table de la cuisine", "fr", "b"), (None, "un chien dort devant la porte", "fr", None), (4, LONG, "en", "a"), (5, LONG, "en", None), (6, " \n\t ", None, ""),
    (7, "日本語 \U00020bb7 ☃", None, "a"), (8, "x", "fr", "b"), (8, "another text of the same id", "en", "b"),
]
CLASHING = "score double, bucket int, spans string, size long, sid int, fp long, rank int, key string, uid long, row long, head string, doc long, n long, kept_text string, changed boolean, rejected boolean"


@pytest.fixture
def bench(spark, tmp_path):
    spark.createDataFrame([(1, "le chat est sur la table de la cuisine", 1), (None, "x", 1), (3, None, 1)], "item_id long, text string, doc_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def odd(spark):
    docs = spark.createDataFrame([(*r, None) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in CLASHING.split(", ")])


EXPECTED = {
    # texts without a letter go, what the two languages' models know stays
    "language_id": lambda ids: ids.count(1) == 2 and ids.count(None) == 2 and not {2, 3, 6} & set(ids),
    # one row for each text; texts without a word share the fingerprint zero, so id 2 stays
    "simhash_near_dedup": lambda ids: sorted(ids, key=str) == sorted([1, 2, None, None, 4, 7, 8, 8], key=str),
    # the copy of the long text loses every word and goes
    "substring_dedup": lambda ids: len(ids) == 11 and 5 not in ids,
    "decontamination": lambda ids: len(ids) == 11 and ids.count(None) == 1,
    "source_mixing": lambda ids: len(ids) == 12,
}


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_odd_rows(spark, bench, name, stage):
    out = stage(spark, odd(spark), bench)
    rows = out.collect()
    assert EXPECTED[name]([r["doc_id"] for r in rows])
    if name == "source_mixing":
        assert sum(r["size"] for r in rows) == sum(len((t or "").split()) for _, t, _, _ in ROWS)
    else:
        assert tuple(out.columns) == pipeline.COLUMNS
        given = {(i, t) for i, t, _, _ in ROWS}
        assert name == "substring_dedup" or all((r["doc_id"], r["text"]) in given for r in rows)


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_empty_tables(spark, bench, name, stage):
    assert stage(spark, odd(spark).limit(0), bench).collect() == []


def test_empty_benchmark(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert dict(pipeline.STAGES)["decontamination"](spark, odd(spark), str(tmp_path)).count() == len(ROWS)


def test_run_removes_what_it_staged(spark, bench):
    from termloom import session

    odd(spark).select(*pipeline.COLUMNS).write.parquet(f"{bench}/documents.parquet")
    before = len(session._STAGED)
    out = pipeline.run(spark, bench)
    assert out.select(F.sum("taken")).first()[0] > 0
    left = session._STAGED[before:]
    assert sum("decontamination" in p for p in left) == 1 and not any(k in p for p in left for k in ("language_id", "near_dedup", "edges", "identifiers"))
