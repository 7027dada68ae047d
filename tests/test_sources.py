"""Files in, files out."""

from __future__ import annotations

import io
import json
import zipfile

import pytest

from termloom.sources import loaders, sinks

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx() -> bytes:
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:p><w:r><w:t>first</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell('a')}{cell(' ')}{cell('b')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_load_directory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hé", encoding="utf-8")
    (tmp_path / "b.CSV").write_text('x,y\n"1,5",2\n', encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"k": [1, 2]}), encoding="utf-8")
    (tmp_path / "d.docx").write_bytes(docx())
    (tmp_path / "e.bin").write_bytes(b"x")
    (tmp_path / "f.json").write_text("{", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/g.md").write_text("deep", encoding="utf-8")
    load = loaders.Loader()
    name = lambda p: p.rsplit("/", 1)[1]
    got = {name(r["path"]): r["text"] for r in load.directory(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "hé", "b.CSV": "x y\n1,5 2", "c.json": "k: [1, 2]", "d.docx": "first\na | b"}
    assert "g.md" in {name(r["path"]) for r in load.directory(spark, str(tmp_path), "*.md", recursive=True).collect()}
    bad = load.read(spark, str(tmp_path)).filter("error IS NOT NULL").collect()
    assert [name(r["path"]) for r in bad] == ["f.json"]
    assert load.load(spark, str(tmp_path / "a.txt")) == "hé"
    with pytest.raises(FileNotFoundError):
        load.load(spark, str(tmp_path / "none.txt"))
    with pytest.raises(ValueError):
        load.load(spark, str(tmp_path / "e.bin"))


def test_dictionary_table_and_exports(spark, tmp_path):
    schema = "term string, definition string, synonyms array<string>, score double, frequency int, ord int"
    path = str(tmp_path / "dictionary")
    sinks.save_new_terms(spark.createDataFrame([("a", "x", ["b"], 1.0, 2, 0)], schema), path)
    out = sinks.save_new_terms(spark.createDataFrame([("a", "new", [], 9.0, 9, 0), ("c", "y", [], 1.0, 1, 1)], schema), path)
    assert {r["term"]: (r["definition"], r["synonyms"]) for r in out.collect()} == {"a": ("x", '["b"]'), "c": ("y", "[]")}
    sinks.export_csv(out, str(tmp_path / "t.csv"))
    assert (tmp_path / "t.csv").read_bytes().startswith(b"\xef\xbb\xbf" + "専門用語,スコア".encode())
    assert sinks.load_json(spark, str(tmp_path / "none"), "term string").count() == 0


def test_embedding_cache_keeps_rows(spark, tmp_path):
    from termloom.operators.generation import embed

    calls = []

    def counted(df):
        calls.append(df.count())
        return embed(df)

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    sinks.cached_embeddings(texts("a", "b"), str(tmp_path / "cache"), counted)
    assert sinks.cached_embeddings(texts("b", "c"), str(tmp_path / "cache"), counted).count() == 2
    assert calls == [2, 1]


def test_results_flatten(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"terms": [{"term": "a", "definition": "d", "metadata": {"field": "f"}}]}]}))
    assert [tuple(r) for r in loaders.flatten_results(spark, str(tmp_path / "r.json")).collect()] == [("a", "d", "f")]


def test_command_line(spark, tmp_path):
    from termloom.plans.cli import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("pump pumps pump pumps.\noil pump oil")
    main(["batch", str(tmp_path / "in"), str(tmp_path / "out"), "--profile", "c_value"], spark)
    assert spark.read.json(str(tmp_path / "out")).filter("source_file = 'a.txt'").count() > 0
