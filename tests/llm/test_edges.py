"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import chat_format, decontaminate, language_id, media, mixing, quality, simhash, substring_dedup, token_counts, warc

LONG = " ".join(f"word{i % 997} of the long text" for i in range(9000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, spans string, size long, sid int, fp long, rank int, images string, predicted string, lang_pred string, h long, label string"


def table(spark, rows):
    pad = [None] * 10
    return spark.createDataFrame([(i, t, lang, src, None, 9.0, 1, *pad) for i, t, lang, src in rows], SCHEMA)


def odd(spark):
    return table(spark, [
        (1, "the cat sat on the mat and the dog", "en", "b"), (1, "the cat sat on the mat and the dog", "en", "b"), (2, None, "en", None), (3, "", None, "a"),
        (None, "le chat est sur la table", "fr", "b"), (4, LONG, "en", "a"), (5, LONG, "en", None), (6, " \n\t ", None, ""), (7, "日本語 \U00020bb7 ☃", None, "a"), (8, "x", "fr", "b"),
    ])


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def run(name, spark, docs, model_path):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (8, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "cat sat on the mat and the dog", "x"), (2, None, "x"), (3, "", "x"), (None, "a b c d e f", "x")], "item_id long, text string, score string")
    return {
        "op1": lambda: language_id.identify(docs, language_id.fit(docs)),
        "op2": lambda: substring_dedup.dedup_substrings(docs),
        "op3": lambda: token_counts.count_tokens(docs, model_path),
        "op4": lambda: mixing.mixed_documents(docs),
        "op6": lambda: decontaminate.contamination(docs, bench),
        "op7": lambda: quality.classify(docs, quality.fit(docs, labels)),
        "op9": lambda: media.media_features(media.to_images(docs)),
        "op10": lambda: simhash.near_duplicates(docs),
    }[name]()


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op7", "op9", "op10"])
def test_odd_rows(spark, model_path, name):
    docs = odd(spark)
    out = run(name, spark, docs, model_path).collect()
    assert len(out) == 10
    by = {r["doc_id"]: r for r in out}
    if name == "op1":
        assert by[2]["lang_pred"] == by[6]["lang_pred"] == "und" and by[1]["lang_pred"] == "en" and by[2]["rejected"]
    if name == "op2":
        assert by[4]["n_removed"] > by[1]["n_removed"] == 0 and by[5]["n_removed"] == by[5]["n_words"] == by[4]["n_words"] and by[2]["n_words"] == 0
        assert by[5]["kept_text"] == ""
    if name == "op3":
        assert by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[4]["over_limit"]
    if name == "op4":
        ones = [r for r in out if r["doc_id"] == 1]
        assert len(ones) == 2 and all(r["size"] == 9 and 0 <= r["taken"] <= 27 for r in ones) and by[None]["size"] == 6
    if name == "op6":
        assert [i for i, r in by.items() if r["contaminated"]] == [1] and by[1]["item_ids"] == [1]
    if name == "op7":
        assert all(0 <= r["score"] <= 1 for r in out)
    if name == "op9":
        assert by[2]["payload_bytes"] == 576 and by[2]["media_sha256"] == by[3]["media_sha256"] and by[4]["feature"] == by[5]["feature"]
    if name == "op10":
        assert by[2]["component_id"] == by[3]["component_id"] == by[6]["component_id"] == 2 and by[2]["fingerprint"] == "0" * 16 and by[None]["component_id"] is None and by[5]["component_id"] == 4


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op7", "op9", "op10"])
def test_empty_table(spark, model_path, name):
    assert run(name, spark, odd(spark).limit(0), model_path).collect() == []


def test_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a\\b <|im_end|> [INST]", 1), (1, 1, "assistant", "<|im_sep|>\n\\", 1), (1, 1, "assistant", "<|im_sep|>\n\\", 1), (2, None, None, None, 1), (None, 0, "user", "x", 1), (3, 0, "assistant", "first", 1)], "conv_id long, turn long, role string, text string, turns int")
    out = chat_format.format_conversations(rows).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()
    by = {r["conv_id"]: r for r in out}
    assert [(t["role"], t["text"]) for t in by[1]["back"]] == [("user", "a\\b <|im_end|> [INST]"), ("assistant", "<|im_sep|>\n\\"), ("assistant", "<|im_sep|>\n\\")]
    assert [(t["role"], t["text"]) for t in by[2]["back"]] == [("", "")]
    assert not by[1]["valid"] and not by[3]["valid"] and not by[None]["valid"]
    assert sum(s["loss"] for s in by[1]["segments"]) == 2
    good = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(good).first()["valid"]
    assert chat_format.format_conversations(rows.limit(0)).collect() == []


def test_archives(spark, tmp_path):
    page = "<p>" + "x" * 200
    rows = [(5, "u", page), (3, None, page), (3, None, page), (7, "a\r\nb%0D", None), (8, "u", "short"), (9, "u", "short"), (None, "u", page)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archives(pages, str(tmp_path / "w"))
    out = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"], r["payload_bytes"], r["url"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert out == [(0, "revisit", 3, 203, "u"), (3, "response", None, 203, None), (3, "response", None, 203, None), (5, "revisit", 3, 203, "u"), (7, "response", None, 0, "a\r\nb%0D"), (8, "response", None, 5, "u"), (9, "response", None, 5, "u")]
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).collect() == []


def test_images_that_cannot_be_read(spark):
    good = media.jpeg.store(media.padded(b"some text"))[0]
    rng = np.random.default_rng(2)
    bad = [b"", b"GIF89a", good[: len(good) // 2], good[:40]]
    for _ in range(40):
        x = bytearray(good)
        for at in rng.integers(0, len(x), 5).tolist():
            x[at] = int(rng.integers(0, 256))
        bad.append(bytes(x))
    rows = [(0, good), (1, None), *[(2 + i, x) for i, x in enumerate(bad)]]
    out = {r["id"]: r for r in media.rgb_tensors(spark.createDataFrame(rows, "id int, image binary")).collect()}
    assert len(out) == len(rows) and len(out[0]["rgb"]) == out[0]["height"] * out[0]["width"] * 3
    assert out[1]["rgb"] is out[1]["error"] is None and all(out[2 + i]["error"] for i in range(3))
    assert all((r["rgb"] is None) != (r["error"] is None) for i, r in out.items() if i != 1)
