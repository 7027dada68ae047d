"""The shared folder and what is staged there."""

from __future__ import annotations

import re
from pathlib import Path
from types import SimpleNamespace

import pytest

from termloom import session


def test_staged_tables_are_removed(spark):
    from termloom.sources.sinks import exists

    mark = session.staged_so_far()
    a, b, c = (session.staged(spark.range(n), "kept") for n in (1, 2, 3))
    paths = session._STAGED[mark:]
    assert len(paths) == 3 and all(exists(spark, p) for p in paths)
    session.release(spark, mark, keep=1)
    assert [exists(spark, p) for p in paths] == [False, False, True] and c.count() == 3
    session.release(spark, mark)
    assert session.staged_so_far() == mark and not exists(spark, paths[2])


def test_a_cluster_needs_a_shared_folder():
    none = SimpleNamespace(getOrElse=lambda x: None)
    context = lambda master, conf: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))))
    assert session.shared_dir(context("local[2]", {})) == session.FALLBACK_SHARED_DIR
    assert session.shared_dir(context("yarn", {"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    with pytest.raises(RuntimeError):
        session.shared_dir(context("spark://host:7077", {}))


def test_rows_of_one_split_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert one.rdd.getNumPartitions() == 1
    many = session.spread(one)
    assert many.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.count() == 1000
    assert session.spread(spark.range(0, 10, 1, 64)).rdd.getNumPartitions() == 64


def test_tidy_gives_native_memory_back(spark):
    jvm = spark._jvm
    java = jvm.java.lang.ProcessHandle.current().pid()
    resident = lambda: int(re.search(r"Anonymous:\s+(\d+)", Path(f"/proc/{java}/smaps_rollup").read_text())[1]) / 1024
    if not session.trim_native(spark):
        pytest.skip("this JVM has no command for it")
    made = [jvm.java.util.zip.Deflater() for _ in range(1000)]  # each holds some 200 KB outside the heap
    for x in made:
        x.setInput(bytearray(b"some text"))
        x.finish()
        x.deflate(bytearray(64))
    for x in made[:-1]:  # the last one keeps what lies below it from being given back by itself
        x.end()
    for _ in range(2):
        jvm.System.gc()
    before = resident()
    session.tidy(spark)
    after = resident()
    made[-1].end()
    assert after < before - 50
