"""Every query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from termloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(same_as_sql, name):
    same_as_sql(name)


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_imports_without_the_removable_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "termloom", tmp_path / "termloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'top_terms' in e.queries() and not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_plans_stay_native_and_prune(spark):
    from termloom.operators.candidates import candidates_v4
    from termloom.operators.scores import nesting

    docs = spark.createDataFrame([(1, "pump pumps pump", "en")], "doc_id long, text string, lang string")
    plan = nesting(candidates_v4(docs.select("doc_id", "text")))._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInArrow"):
        assert bad not in plan
