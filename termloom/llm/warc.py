"""WARC archives: one gzip member for each record, written and read through Spark alone.

Writing: text files take a record's member as one "line"; every member ends in a
zero byte (the high byte of a small length, or an empty member added after it), which
serves as the line's end, so the files are plain concatenated gzip members.

Reading is splittable, also for files named .gz: tasks scan byte ranges for the gzip magic (as the line
separator of Spark's text reader, over any file system that Spark reaches) and own
the members that start inside their range. A candidate is a member's start only if
its header decodes to a WARC header; what does not is the rest of the member before
it. A member cut by a chance magic at a range's end is put together again from the
fragments of its file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import small_batches
from termloom.operators.joins import join_spread
from termloom.session import fresh_path, staged

MAGIC = b"\x1f\x8b\x08"
#: Payloads shorter than this are never replaced by a revisit.
SHORTEST = 100
_EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
_DATE = "2026-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose Content-Length tells the payload's size."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that ends in a zero byte."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


_LABELS = {"sha256": hashlib.sha256, "sha1": hashlib.sha1, "md5": hashlib.md5}


def agrees(stated: str, payload: bytes) -> bool:
    """Whether a payload has the labelled digest a record states, in hexadecimal or base 32;
    a digest of an unknown kind is not doubted."""
    label, _, value = stated.partition(":")
    digest = _LABELS.get(label.strip().lower().replace("-", ""))
    if digest is None:
        return True
    raw = digest(payload).digest()
    return value.strip().lower() in (raw.hex(), base64.b32encode(raw).decode().lower())


def parse(data: bytes) -> dict:
    """The fields of a decoded record. Payload size and SHA-256 are those of the bytes read, or
    for a revisit those it states; ``error`` tells what is wrong with the record, if anything."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields, name = {}, ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:  # a folded line
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    ident = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s or "")) else None
    kind, url, stated = fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-payload-digest")
    out = {"page_id": ident(fields.get("warc-record-id")), "record_id": fields.get("warc-record-id"), "record_type": kind, "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "refers_to": ident(fields.get("warc-refers-to")), "stated_digest": stated}
    if not lines[0].startswith("WARC/") or kind is None:
        return out | {"error": "no WARC header"}
    size = fields.get("content-length", "")
    if not re.fullmatch(r"\d+", size):
        return out | {"error": "no Content-Length"}
    block = rest[: int(size)]
    short = "the record ends early" if len(block) < int(size) else None
    http = payload = None
    if block.startswith(b"HTTP/") or fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length: *(\d+)", http or b"")
        label, _, value = (stated or "").partition(":")
        return out | {"payload_bytes": int(length[1]) if length else None, "payload_digest": value if label == "sha256" else None, "error": short}
    payload = block if payload is None else payload
    coded = re.search(rb"(?im)^(transfer|content)-encoding:", http or b"")  # the digest may be of the decoded bytes
    wrong = "payload digest differs" if stated and not short and not coded and not agrees(stated, payload) else None
    return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload, "error": short or wrong}


def is_start(chunk: bytes) -> bool:
    """Whether a candidate's first bytes decode to the start of a WARC record, or to an
    empty member."""
    unpack = zlib.decompressobj(31)
    try:
        got = unpack.decompress(chunk[:4096], 16)
    except zlib.error:
        return False
    return got.startswith(b"WARC/") or (not got and unpack.eof)


class Assembler:
    """Puts the chunks of one byte range together to members."""

    def __init__(self) -> None:
        self.unpack, self.raw, self.got, self.lost = None, [], [], False

    def feed(self, chunk: bytes) -> Iterator[dict]:
        """Take one chunk; give the records that it completes. Where a member is damaged, an
        error is given for it and its chunks are searched for the start of the next one."""
        todo = deque([chunk])
        while todo:
            chunk = todo.popleft()
            if self.unpack is None:
                if self.lost and not is_start(chunk):
                    continue
                self.unpack, self.raw, self.got, self.lost = zlib.decompressobj(31), [], [], False
            self.raw.append(chunk)
            try:
                self.got.append(self.unpack.decompress(chunk))
            except zlib.error as e:
                yield parse(b"".join(self.got)) | {"error": f"damaged member: {e}"}
                todo.extendleft(reversed(self.raw[1:]))
                self.unpack, self.lost = None, True
                continue
            if self.unpack.eof:
                self.unpack = None
                if data := b"".join(self.got):
                    yield parse(data)

    def end(self) -> Iterator[dict]:
        """Nothing follows: a member that is still open is an error."""
        if self.open:
            yield parse(b"".join(self.got)) | {"error": "the archive ends inside a member"}

    @property
    def open(self) -> bool:
        return self.unpack is not None


_FIELDS = [
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ("record_id", pa.string()), ("stated_digest", pa.string()), ("error", pa.string()),
]
_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, stated_digest string, error string"
_FRAGMENT = [("file", pa.string()), ("at", pa.int64()), ("tail", pa.bool_()), ("bytes", pa.binary())]


def _table(rows: list[dict], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields], names=[n for n, _ in fields])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shortest: int = SHORTEST) -> None:
    """Write each row of ``pages`` as a record below ``path``.

    Null payload: empty. Among equal payloads of ``shortest`` bytes or more the
    smallest id is the response (a repeated row of that id too) and the others revisit
    it; a null id never gives the response if another id has the payload. Extra
    columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    table = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = table.filter(F.octet_length("payload") >= shortest)
    small = table.filter(F.octet_length("payload") < shortest).withColumn("first", F.lit(None).cast("long"))
    firsts = staged(large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "repeated-payloads")
    # a payload of very many pages is not brought together: its first page is sent to them
    full = join_spread(large, firsts, "digest", pages.count(), how="left").unionByName(small)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("id", "url", "payload", "digest", "first", "again")]
            yield pa.RecordBatch.from_arrays([pa.array([member(record(*r))[:-1] for r in zip(*cols, strict=True)], pa.binary())], names=["member"])

    members = full.select("id", "url", "payload", "digest", "first", revisit.alias("again")).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", "\0").text(path)


def _undecoded(spark: SparkSession) -> dict[str, str]:
    """Reader options under which no suffix has a codec, so that ``.gz`` files are read as the
    bytes they are and split: a pass-through codec for a suffix that stands right after
    ``.gz`` in the (reversed, sorted) table of suffixes hides the one that would decode them."""
    codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    return {"io.compression.codecs": codec.CLASSNAME, codec.OPT_EXTENSION: "!.gz"}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, whatever their suffix: ``page_id, url,
    record_type, refers_to, payload_bytes, payload_digest, payload, record_id, stated_digest,
    error``.

    Records of every type are given. ``page_id`` and ``refers_to`` are null where an
    identifier is not of this writer's form (``record_id`` has it as it is); the payload is
    what follows the HTTP header, or the whole block where there is none. What cannot be
    read gives a row with an ``error`` and ends nothing: a file that is no gzip, a damaged or
    cut member (reading goes on at the next one), a record without length, a payload that
    differs from its stated SHA-256, SHA-1 or MD5.
    """
    small_batches(spark)
    chunks = (
        spark.read.options(**_undecoded(spark)).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
        .select(F.col("value").cast("binary").alias("chunk"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, maker, headless = None, Assembler(), True

        def tail() -> list[dict]:
            return [{"file": where[0], "at": where[1], "tail": True, "bytes": b"".join(maker.raw)}] if where and maker.open else []

        for batch in batches:
            rows, loose = [], []
            for chunk, file, at in zip(*[batch.column(k).to_pylist() for k in ("chunk", "file", "at")], strict=True):
                if (file, at) != where:
                    loose += tail()
                    where, maker, headless = (file, at), Assembler(), True
                    if at == 0:
                        if chunk:
                            rows.append({"error": f"{file} does not start with a gzip member"})
                            maker.lost, headless = True, False
                        continue  # what stands before the first magic
                candidate = MAGIC + chunk
                if headless and not is_start(candidate):
                    loose.append({"file": file, "at": at, "tail": False, "bytes": candidate})
                    continue
                headless = False
                rows += maker.feed(candidate)
            yield _table([*rows, *loose], [*_FIELDS, *_FRAGMENT])
        if last := tail():
            yield _table(last, [*_FIELDS, *_FRAGMENT])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, rows, file = Assembler(), [], None
        for batch in batches:
            for x in batch.to_pylist():
                if x["file"] != file:
                    rows += maker.end()
                    maker, file = Assembler(), x["file"]
                if x["tail"] or maker.open:  # what looks like a start may lie inside an open member
                    rows += maker.feed(x["bytes"])
            if len(rows) >= 500:
                yield _table(rows, _FIELDS)
                rows = []
        rows += maker.end()
        yield _table(rows, _FIELDS)

    parts = chunks.mapInArrow(run, f"{_DDL}, file string, at long, tail boolean, bytes binary")
    whole = parts.filter("file is null").select(*[n for n, _ in _FIELDS])
    loose = parts.filter("file is not null").select("file", "at", "tail", "bytes").repartition(F.col("file")).sortWithinPartitions("file", "at", "tail")
    return whole.unionByName(loose.mapInArrow(stitch, _DDL))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {SHORTEST} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {SHORTEST} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
