"""Archives of other writers: their suffix, digests, record types and damage."""

from __future__ import annotations

import base64
import gzip
import hashlib

import numpy as np
import pytest

from termloom.llm import warc


def foreign(kind, block, n, *more, length=None):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{n}>", *more, f"Content-Length: {len(block) if length is None else length}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6)


def http(payload):
    return b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + payload


@pytest.fixture
def noise():
    rng = np.random.default_rng(3)
    return [rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes() for _ in range(9)]


def sha1(x):
    return "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()


@pytest.mark.parametrize("size", ["4096", "33000", "100m"])
def test_archives_of_other_writers(spark, tmp_path, noise, size):
    members = [
        foreign("warcinfo", b"software: other\r\n", 0, "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", 1, "WARC-Target-URI: http://a/%25"),
        *[foreign("response", http(x), 2 + i, "Content-Type: application/http; msgtype=response", sha1(x)) for i, x in enumerate(noise[:5])],
        foreign("response", http(noise[5]), 7, sha1(b"else")),
        foreign("resource", noise[6], 8, "WARC-Payload-Digest: md5:" + hashlib.md5(noise[6]).hexdigest(), "X-Folded: a\r\n b"),
        foreign("resource", b"abc", 9, length="many"),
        foreign("resource", b"abc", 10, length=99),
        gzip.compress(b"no header at all"),
    ]
    damaged = bytearray(members[3])
    damaged[500:540] = bytes(40)
    good = tmp_path / "in" / "good.warc.gz"
    good.parent.mkdir()
    good.write_bytes(b"".join(members))
    (good.parent / "bad.warc.gz").write_bytes(members[2] + bytes(damaged) + members[4] + members[5])
    (good.parent / "cut.gz").write_bytes(members[2] + members[6][:9000])
    (good.parent / "plain.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\n")
    (good.parent / "empty.warc.gz").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = lambda name: warc.read_archives(spark, f"{good.parent}/{name}")
        if size == "4096":
            assert read("good.warc.gz").rdd.getNumPartitions() > 20
        rows = {r["record_id"]: r for r in read("good.warc.gz").collect() if r["record_id"]}
        assert len(rows) == 11
        assert [rows[f"<urn:uuid:{n}>"]["record_type"] for n in (0, 1, 2, 8)] == ["warcinfo", "request", "response", "resource"]
        assert rows["<urn:uuid:0>"]["payload"] == b"software: other\r\n" and rows["<urn:uuid:1>"]["url"] == "http://a/%"
        for i, x in enumerate(noise[:5]):
            r = rows[f"<urn:uuid:{2 + i}>"]
            assert bytes(r["payload"]) == x and r["payload_digest"] == hashlib.sha256(x).hexdigest() and r["error"] is None
        assert rows["<urn:uuid:7>"]["error"] == "payload digest differs" and bytes(rows["<urn:uuid:8>"]["payload"]) == noise[6] and rows["<urn:uuid:8>"]["error"] is None
        assert rows["<urn:uuid:9>"]["error"] == "no Content-Length" and rows["<urn:uuid:10>"]["error"] == "the record ends early"
        bad = read("bad.warc.gz").collect()
        assert sorted(r["record_id"] for r in bad if r["error"] is None) == [f"<urn:uuid:{n}>" for n in (2, 4, 5)]
        assert sum(r["error"] is not None for r in bad) == 1
        cut = read("cut.gz").collect()
        assert sorted((r["record_id"], r["error"]) for r in cut) == [("<urn:uuid:2>", None), ("<urn:uuid:6>", "the archive ends inside a member")]
        assert "gzip" in read("plain.warc").first()["error"] and read("empty.warc.gz").collect() == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
