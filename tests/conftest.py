from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "1")
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(x):
    """A value that compares alike from either engine."""
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return x


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[n]) for n in names]) for r in df.collect())


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compare a registered query with its SQL over the smallest tables."""
    import duckdb

    import __spark_entry__ as entry

    if not DATA.exists():
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def check(name: str) -> None:
        names, ours = rows_of(entry.queries()[name](spark, str(DATA)))
        rel = con.sql(entry.oracle_sql()[name])
        cols = list(rel.columns)
        assert names == sorted(cols)
        order = [cols.index(n) for n in names]
        theirs = sorted(repr([plain(r[i]) for i in order]) for r in rel.fetchall())
        assert ours == theirs

    return check
