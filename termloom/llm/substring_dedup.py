"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is every block of all documents. A block is the stretch of words around one
*anchor*: of the k-word grams inside a window of ``window`` words, the one with the least
hash. Equal windows choose equal anchors, so a factor of ``window`` words or more always
meets an indexed block. The index answers in two rounds:

1. Blocks go to their anchor's bucket. A block equal to an earlier one (by its anchor's
   hash and another of all its words) matches it as a whole; where an anchor has several
   different blocks, their windows are left open.
2. Open windows alone go to their own hash's bucket (two independent 64-bit hashes of all
   their words), where the earliest is their match.

Each document is then parsed greedily (``parse``): at the first place that has a match the
longest one is taken and extended as long as document and reference advance in step; that
is a factor. Windows that run over a factor's end are looked up as well, so that no
window is lost at a boundary. Words inside factors are what is removed.

A batch sends each anchor and each window at most once (its earliest), so a
passage that a third of all rows share sends one message for each batch, not one
for each row. Texts are shuffled once, by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import Sequence, as_int64, hash_words, small_batches, text_chunks, word_bounds
from termloom.operators.joins import join_spread
from termloom.session import shuffle_partitions, spread, staged

WINDOW, GRAM = 20, 8
#: Bytes of text for each bucket of the index, at most.
BUCKET_BYTES = 128 << 20
_LAST = int(np.iinfo(np.int64).max)
_SENT = pa.schema([("bucket", pa.int32()), ("sent", pa.binary()), ("known", pa.binary())])
_BLOCK = np.dtype([("anchor", "u8"), ("block", "u8"), ("doc", "i8"), ("start", "i4"), ("n", "i4"), ("many", "u1")])
_OPEN = np.dtype([("window", "u8"), ("twin", "u8"), ("doc", "i8"), ("start", "i4")])
_SPAN = np.dtype([("doc", "i8"), ("start", "i4"), ("n", "i4"), ("ref_doc", "i8"), ("ref_start", "i4"), ("settled", "u1")])
_SPAN_DDL = "doc long, start int, n int, ref_doc long, ref_start int, settled boolean"


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least value of every run of ``width`` values."""
    best = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = best[:-step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        have += step
    return best


def blocks_of(words: np.ndarray, twins: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Blocks of documents laid end to end (document d is words[first[d]:first[d+1]]):
    (document, start within it, number of windows, anchor hash, block hash). Anchors rest on
    the hashes ``words``, blocks on the others, ``twins``."""
    lengths = np.diff(first)
    counts = np.maximum(lengths - window + 1, 0)
    if not counts.sum():
        return (*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 2)
    grams = Sequence(words).hash(np.arange(len(words) - gram + 1), gram)
    at = leftmost_minimum(grams, window - gram + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    where = first[doc] + start
    anchor = at[where]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(doc)))
    return doc[head], start[head], n, grams[anchor[head]], Sequence(twins).hash(where[head], n + window - 1)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where sorted keys change."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _firsts(new: np.ndarray) -> np.ndarray:
    """For each row the index of its group's first row."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _spans(doc, start, n, ref_doc, ref_start, settled) -> np.ndarray:
    out = np.empty(len(doc), _SPAN)
    for name, value in zip(_SPAN.names, (doc, start, n, ref_doc, ref_start, settled), strict=True):
        out[name] = value
    return out


def settle_blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort blocks out by anchor: the spans they give, and for each anchor its
    earliest block (marked if the anchor has several kinds)."""
    x = x[np.lexsort((x["start"], x["doc"], x["block"], x["anchor"]))]
    kind = _groups(x["anchor"], x["block"])
    first = _firsts(kind)
    later = (x["doc"] != x["doc"][first]) | (x["start"] != x["start"][first])
    known = _spans(x["doc"], x["start"], x["n"], x["doc"][first], x["start"][first], 1)[later]
    one = x[kind]
    group = _groups(one["anchor"])
    gid = np.cumsum(group) - 1
    many = np.bincount(gid, minlength=gid[-1] + 1 if len(gid) else 0) > 1
    # any row of the anchor may carry the mark, not only the first of its kind
    np.logical_or.at(many, np.cumsum(_groups(x["anchor"])) - 1, x["many"] > 0)
    one["many"] = many[gid]
    one = one[np.lexsort((one["start"], one["doc"], gid))]
    return known, one


def to_known(x: np.ndarray) -> np.ndarray:
    return _spans(x["doc"], x["start"], x["n"], x["doc"], x["start"], 0)


def _messages(sent: np.ndarray, key: str, known: np.ndarray, parts: int) -> pa.RecordBatch:
    bucket = (sent[key] % np.uint64(parts)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    sent, bucket = sent[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(parts + 1))
    # what is known already travels with the messages, dealt out evenly
    pieces = np.array_split(known, parts)
    rows = [(b, sent[cuts[b] : cuts[b + 1]].tobytes(), pieces[b].tobytes()) for b in range(parts) if cuts[b + 1] > cuts[b] or len(pieces[b])]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _SENT.field(i).type) for i in range(3)], schema=_SENT)


def _answer(spans: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(spans), 100_000):
        s = spans[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(s[k])) for k in _SPAN.names[:-1]], pa.array(s["settled"] > 0)], names=list(_SPAN.names))


def _gather(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    sent, known = [], []
    for b in batches:
        for x in b.column("sent").to_pylist():
            sent.append(np.frombuffer(x, kind))
        for x in b.column("known").to_pylist():
            known.append(np.frombuffer(x, _SPAN))
    return np.concatenate([np.zeros(0, kind), *sent]), np.concatenate([np.zeros(0, _SPAN), *known])


def _words(column: pa.Array):
    """(first row, row after the last, offsets of words by row, both word hashes) of each
    chunk of a text column."""
    for i, j, buf, offsets in text_chunks(column):
        starts, ends = word_bounds(buf, offsets)
        yield i, j, np.searchsorted(starts, offsets), hash_words(buf, starts, ends), hash_words(buf, starts, ends, 1)


def find_matches(docs: DataFrame, parts: int, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(texts, matches) of a table (doc, text, ...) with a non-null integer ``doc``: runs of
    ``n`` windows (doc, start, n, ref_doc, ref_start) which also start earlier."""

    def send_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = as_int64(batch.column("doc"))
            for i, _, first, words, twins in _words(batch.column("text")):
                doc, start, n, anchor, block = blocks_of(words, twins, first, window, gram)
                x = np.zeros(len(doc), _BLOCK)
                for k, v in zip(_BLOCK.names, (anchor, block, ids[i + doc] if len(doc) else doc, start, n), strict=False):
                    x[k] = v
                if len(x):
                    known, one = settle_blocks(x)
                    head = _groups(one["anchor"])
                    yield _messages(one[head], "anchor", np.concatenate([known, to_known(one[~head])]), parts)

    def receive_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, known = _gather(batches, _BLOCK)
        yield from _answer(known)
        if len(sent):
            known, one = settle_blocks(sent)
            yield from _answer(np.concatenate([known, to_known(one[one["many"] > 0])]))

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = as_int64(batch.column("doc"))
            opened = batch.column("spans")
            flat, at = opened.flatten(), np.append(0, np.cumsum(np.asarray([len(v) if v is not None else 0 for v in opened])))
            s_start, s_n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            for i, j, first, words, twins in _words(batch.column("text")):
                seq, twin = Sequence(words), Sequence(twins)
                lo, hi = at[i], at[j]
                row = np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))
                n = s_n[lo:hi].astype(np.int64)
                row, start = np.repeat(row, n), np.repeat(s_start[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                fits = start + window <= (first[1:] - first[:-1])[row - i]
                row, start = row[fits], start[fits]
                x = np.zeros(len(row), _OPEN)
                at_word = first[row - i] + start
                x["window"], x["twin"], x["doc"], x["start"] = seq.hash(at_word, window), twin.hash(at_word, window), ids[row], start
                if len(x):
                    known, one = settle_windows(x)
                    yield _messages(one, "window", known, parts)

    def receive_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, known = _gather(batches, _OPEN)
        yield from _answer(known)
        if len(sent):
            yield from _answer(settle_windows(sent)[0])

    sent = "bucket int, sent binary, known binary"
    texts = docs.repartition(parts, "doc")
    found = docs.select("doc", "text").mapInArrow(send_blocks, sent).repartition(parts, "bucket").mapInArrow(receive_blocks, _SPAN_DDL)
    span = F.struct("start", "n", "ref_doc", "ref_start")
    opened = found.filter(~F.col("settled")).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    # all columns go in, so that the one shuffle of the texts serves here and for the parse
    windows = texts.join(opened, "doc").select(*texts.columns, "spans").mapInArrow(send_windows, sent)
    settled = windows.repartition(parts, "bucket").mapInArrow(receive_windows, _SPAN_DDL)
    spans = found.filter("settled").unionByName(settled).groupBy("doc").agg(F.collect_list(span).alias("spans"))
    return texts, spans


def settle_windows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the windows that are not the earliest of their hash, and the earliest ones."""
    x = x[np.lexsort((x["start"], x["doc"], x["twin"], x["window"]))]
    new = _groups(x["window"], x["twin"])
    first = _firsts(new)
    later = (x["doc"] != x["doc"][first]) | (x["start"] != x["start"][first])
    return _spans(x["doc"], x["start"], 1, x["doc"][first], x["start"][first], 1)[later], x[new]


def parse(start, n, ref_doc, ref_start, window: int) -> list[dict]:
    """Greedy factors of a document from the matches of its windows: at the first place left
    the longest match, extended while the reference advances in step; matches that end
    inside the factor before them add nothing, those that run over its end do."""
    out: list[dict] = []
    for k in np.lexsort((-n, start)):
        s, e, rd, rs = int(start[k]), int(start[k] + n[k] - 1 + window), int(ref_doc[k]), int(ref_start[k])
        if out:
            last = out[-1]
            end = last["start"] + last["length"]
            if e <= end:
                continue
            if last["ref_doc"] == rd and last["ref_start"] - last["start"] == rs - s and s <= end:
                last["length"] = e - last["start"]
                continue
        out.append({"start": s, "length": e - s, "ref_doc": rd, "ref_start": rs})
    return out


def outside(words: list[bytes], factors: list[dict]) -> list[bytes]:
    """The words that no factor covers."""
    kept, at = [], 0
    for f in factors:  # in order of their starts and of their ends
        kept += words[at : max(at, f["start"])]
        at = max(at, f["start"] + f["length"])
    return kept + words[at:]


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> tuple[DataFrame, int]:
    """(id, doc, text, carried columns as c0, c1, ...) and the bytes of all texts. ``doc`` is the
    id, null last; where different texts share an id or have none, it is the rank of id and
    text, so that each is a document of its own."""
    text = F.col(f"`{text_col}`")
    doc, row = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)), F.xxhash64(text)
    named = docs.select(F.col(f"`{id_col}`").alias("id"), doc.alias("doc"), text.alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry) if c != text_col])
    pairs = docs.select(doc.alias("doc"), row.alias("row"), F.octet_length(text).cast("long").alias("size"))
    each = pairs.groupBy("doc").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.sum("size").alias("size"))
    shared, size = each.agg(F.max(F.col("a") != F.col("b")), F.sum("size")).first()
    if shared:
        texts = pairs.groupBy("doc", "row").agg(F.count("*").alias("n"))
        ranks = staged(texts.orderBy("doc", "row").withColumn("rank", F.monotonically_increasing_id()).withColumn("pair", F.struct("doc", "row")).select("pair", "rank", "n"), "row-ranks")
        named = staged(join_spread(named.withColumn("pair", F.struct("doc", F.xxhash64("text").alias("row"))), ranks, "pair", docs.count()).drop("pair", "doc").withColumnRenamed("rank", "doc"), "ranked-rows")
    return named, size or 0


_FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
_RESULT = "n_words long, n_removed long, kept_text string, factors array<struct<start:int,length:int,ref_doc:long,ref_start:int>>"


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_removed, kept_text, factors``, and
    the columns named in ``carry``.

    A word is removed if some run of ``window`` consecutive words of its document
    that covers it also starts earlier (smaller id, or same id and smaller start).
    ``kept_text`` joins the remaining words by one space; a text of which nothing is
    removed is likewise given as its words. ``factors`` are the duplicate spans with
    an earlier occurrence each.

    Null text: no words. Null id: comes after every other id. Different texts under one id,
    or under none, are documents of their own in the order of a hash of the text, and
    ``ref_doc`` then is the rank of id and text. A repeated row (id and text alike) is the
    same document given again: its words are judged by their place in it, so it neither
    removes nor saves anything. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table, size = _keyed(docs, id_col, text_col, carry)
    texts, matches = find_matches(table, max(shuffle_partitions(spark), -(-size // BUCKET_BYTES)), window)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words, factors = raw.split(), []
                kept = words
                if found.is_valid:
                    f = found.values
                    factors = parse(*(f.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n", "ref_doc", "ref_start")), window)
                    kept = outside(words, factors)
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), factors))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(_FACTOR))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], *[batch.column("text" if c == text_col else f"c{i}") for i, c in enumerate(carry)]],
                names=["id", "n_words", "n_removed", "kept_text", "factors", *[f"c{i}" for i in range(len(carry))]],
            )

    given = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kinds = ", ".join([f"id {given[id_col]}", _RESULT, *[f"c{i} {given[c]}" for i, c in enumerate(carry)]])
    found = texts.join(matches, "doc", "left").select(*texts.columns, "spans").mapInArrow(keep, kinds)
    return found.withColumnsRenamed({"id": id_col, **{f"c{i}": c for i, c in enumerate(carry)}})


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM p) WHERE r > 1
), x AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM d
), g AS (
  SELECT w.doc_id, t.k, w.ws[t.k] AS word FROM w, unnest(range(1, len(w.ws) + 1)) AS t(k)
), h AS (
  SELECT g.doc_id, string_agg(g.word, ' ' ORDER BY g.k) AS kept FROM g ANTI JOIN x USING (doc_id, k) GROUP BY g.doc_id
), c AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(h.kept, '')) AS kept_sha256
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)
"""
