"""Scores to the last digit, on which ranks of alike terms depend."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from termloom.operators import ranking as R
from termloom.operators import scores as S

TABLES = Path("/root/testdata")


def same_for(spark, tmp_path, name: str, size: str, ids: list[int]) -> None:
    """A query and its SQL over a few documents, to the last digit."""
    import duckdb

    if not (TABLES / size / "documents.parquet").exists():
        pytest.skip("the driver's tables are not here")
    docs = spark.read.parquet(f"{TABLES}/{size}/documents.parquet").filter(f"doc_id IN ({', '.join(map(str, ids))})")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    theirs = sorted(map(tuple, rel.fetchall()))
    assert theirs and sorted(tuple(r[c] for c in rel.columns) for r in entry.queries()[name](spark, str(tmp_path)).collect()) == theirs


def test_scores_use_the_c_library_logarithm(spark):
    rows = [(1, f"t{n}-{df}", 3, 3, 100, n, df, 0, 0) for n in range(1, 60) for df in range(1, n + 1)]
    stats = spark.createDataFrame(rows, "doc_id long, term string, freq long, n_found long, n_chars long, n_sentences long, df long, n_longer long, f_longer long")
    tfidf = {r["term"]: r["tfidf"] for r in S.tfidf_v4(stats).collect()}
    cvalue = {r["term"]: r["cvalue"] for r in S.cvalue_v4(stats).collect()}
    for _, term, _, found, chars, n, df, _, _ in rows:
        assert tfidf[term] == (found + 0.5) / (chars + 1) * max(0.1, math.log((n + 1) / (df + 1)) + 1)
        assert cvalue[term] == math.log(len(term) + 1) * 3


def test_alike_terms_are_ranked_as_in_sql(spark, tmp_path):
    same_for(spark, tmp_path, "display_table", "sf0.1", [2847, 6306, 7064])


def test_elbow_of_alike_bends(spark, tmp_path):
    same_for(spark, tmp_path, "elbow_absolute", "check_s", [9612])


def test_validation_count_of_alike_bends(spark, tmp_path):
    same_for(spark, tmp_path, "validation_count", "sf0.1", [9800])


def test_percentile_to_the_last_digit(spark):
    import random

    import duckdb

    draw = random.Random(7)
    rows = [(k, f"t{i}", x) for k in range(400) for i, x in enumerate(draw.choices([draw.random() for _ in range(8)], k=draw.randint(1, 40)))]
    rows += [(-1, "a", 0.22333341522473138), (-1, "b", 0.22333341522473138), (-2, "only", 1.5)]
    ours = R.above_percentile(spark.createDataFrame(rows, "doc_id long, term string, score double"), 20)
    con = duckdb.connect()
    con.sql("CREATE TABLE x (doc_id BIGINT, term VARCHAR, score DOUBLE)")
    con.executemany("INSERT INTO x VALUES (?, ?, ?)", rows)
    theirs = con.sql("SELECT doc_id, term, score FROM (SELECT *, quantile_cont(score, 0.2) OVER (PARTITION BY doc_id) AS q FROM x) WHERE score >= q")
    assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())


def test_percentile_keeps_the_terms_that_sql_keeps(spark, tmp_path):
    same_for(spark, tmp_path, "percentile_filter", "check_s", [1, 2, 3, 9896, 27363, 35944])
