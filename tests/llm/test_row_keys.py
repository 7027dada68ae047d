"""Stages of the pipeline over several texts without an id or with the same id."""

from __future__ import annotations

import numpy as np

import corpus_pipeline as pipeline
from termloom.llm import substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)


def words(seed, n):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 1 << 40, n)]


def rows(out):
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_near_duplicates_of_shared_ids(spark):
    a, b, c, d, e = (" ".join(words(k, 40)) for k in range(5))
    docs = table(spark, [(None, a), (None, b), (None, b), (None, c), (1, c), (7, d), (7, e)])
    want = [(None, a), (None, b), (1, c), (7, d), (7, e)]
    assert rows(pipeline.near_duplicate_stage(spark, docs, "")) == sorted(want, key=repr)


def test_substrings_of_shared_ids(spark):
    x, y, z, p = words(1, 30), words(2, 30), words(3, 30), words(4, 25)
    first, same_id, other, unnamed, second = (" ".join(t) for t in ([*x, *p], y, [*z, *p], words(5, 30), [*words(6, 30), *p]))
    docs = table(spark, [(1, first), (3, same_id), (3, other), (None, unnamed), (None, second), (None, second)])
    want = [(1, first), (3, same_id), (3, " ".join(z)), (None, unnamed), *[(None, " ".join(words(6, 30)))] * 2]
    assert rows(pipeline.substring_stage(spark, docs, "")) == sorted(want, key=repr)


def test_decontamination_of_shared_ids(spark, tmp_path):
    item = " ".join(words(1, 30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c = (" ".join(words(k, 40)) for k in (2, 3, 4))
    docs = table(spark, [(None, a), (None, f"{b} {item}"), (5, c), (5, f"{item} {c}")])
    assert rows(pipeline.decontamination_stage(spark, docs, str(tmp_path))) == sorted([(None, a), (5, c)], key=repr)


def test_operator_keeps_texts_without_an_id_apart(spark):
    """A clean text beside a copy, both without an id, and two texts of one id."""
    x, clean, p = words(1, 60), words(2, 60), words(3, 30)
    docs = table(spark, [(1, " ".join(x)), (None, " ".join(clean)), (None, " ".join(x)), (None, " ".join(x)), (4, " ".join(p)), (4, " ".join([*words(5, 9), *p]))])
    out = substring_dedup.dedup_substrings(docs, carry=("text", "source")).collect()
    got = sorted((r["doc_id"] is None, r["text"] == " ".join(clean), r["n_removed"]) for r in out if r["doc_id"] != 4)
    assert got == [(False, False, 0), (True, False, 60), (True, False, 60), (True, True, 0)]
    assert sum(r["n_removed"] for r in out if r["doc_id"] == 4) == 30 and {r["source"] for r in out} == {"a"}
