"""SimHash near-duplicates with pigeonring filtering.

Two 64-bit fingerprints within ``tau`` bits, cut into m segments on a ring, have a
start from which every chain of l consecutive segments holds at most l*tau/m
differing bits. The first chains allow none, the next ones a single bit; a probe
key therefore fixes the bits of a chain but for one segment that may differ. Pairs
that share a key go through the cumulative chain test and then the full Hamming
check. Equal fingerprints are one row throughout, a key shared by many is cut into
blocks of bounded size, and each pair of blocks gives the stars of its own links,
never all of its pairs: a key of many fingerprints is first refined by the pigeonhole over
the bits it leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import as_int64, small_batches
from termloom.operators.components import connected_components
from termloom.operators.joins import join_spread
from termloom.session import spread, staged, staged_with

SHINGLE, TAU, SEGMENTS, SEED = 3, 3, 7, 42
#: Fingerprints of one key that a task compares at once; larger keys are cut.
BLOCK = 512
_LAST = int(np.iinfo(np.int64).max)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of the word shingles, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for i in range(0, len(rows), 4096):
        count += np.unpackbits(rows[i : i + 4096], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(count * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc, row, fp)`` of a table (doc, row, text), fp as a signed long; ``row`` (a long) is
    passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(as_int64(batch.column("doc"))), batch.column("row"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc", "row", "fp"])

    return docs.select("doc", "row", "text").mapInArrow(run, "doc long, row long, fp long")


def ring_masks(segments: int) -> list[int]:
    """The bits of each segment of the ring."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]


def probes(segments: int = SEGMENTS, tau: int = TAU) -> list[tuple[int, int]]:
    """(start segment, mask of the bits that must agree) of every probe key."""
    masks = ring_masks(segments)
    budget = [length * tau // segments for length in range(1, segments + 1)]
    clean, chain = budget.count(0), sum(b <= 1 for b in budget)
    if clean == chain:
        raise ValueError("segments must exceed the number of differing bits")
    return [
        (start, sum(masks[(start + j) % segments] for j in range(chain) if j != dirty))
        for start in range(segments)
        for dirty in range(clean, chain)
    ]


def block_links(fps: np.ndarray, start: int, segments: int, tau: int) -> np.ndarray:
    """For each of distinct fingerprints the first one that links reach in this block."""
    masks = ring_masks(segments)
    n = len(fps)
    near = np.ones((n, n), bool)
    diff = fps[:, None] ^ fps[None, :]
    total = np.zeros((n, n), np.uint8)
    for length in range(1, segments + 1):
        total += np.bitwise_count(diff & np.uint64(masks[(start + length - 1) % segments]))
        near &= total <= length * tau // segments
    near &= np.bitwise_count(diff) <= tau
    near |= near.T
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = np.minimum(label, least)


def refinements(mask: int, tau: int) -> list[int]:
    """The bits that a probe leaves open, in tau + 1 parts: two fingerprints within ``tau`` bits
    that share the probe's key agree on one of these as well."""
    left = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in left[len(left) * i // (tau + 1) : len(left) * (i + 1) // (tau + 1)]) for i in range(tau + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def link_edges(distinct: DataFrame, segments: int = SEGMENTS, tau: int = TAU, block: int = BLOCK, count: int | None = None) -> DataFrame:
    """Edges (a, b) between representatives ``rep`` of distinct fingerprints ``fp`` that
    keep every link's two ends connected.

    A key of more than ``block`` fingerprints is refined by the bits it leaves open, and only
    a refined key that still holds more is compared in pairs of blocks."""
    ring = probes(segments, tau)
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("probe"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key")) for i, (_, m) in enumerate(ring)])
    rows = distinct.select("fp", "rep", F.explode(keys).alias("k")).select("k.probe", "k.key", "fp", "rep")
    shared, seen = staged_with(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("held", F.col("n")), "shared-keys", most=F.max("n"))
    largest, total = seen["most"] or 0, len(ring) * (distinct.count() if count is None else count)
    # a key of very many fingerprints is not brought together before it is cut
    met = join_spread(rows, shared, "key", total, most=largest)
    zero = F.lit(0).cast("long")
    plain = met.filter(F.col("held") <= block).select("key", "probe", zero.alias("p"), zero.alias("q"), "fp", "rep")
    if largest <= block:
        return _compared(plain, ring, segments, tau)
    open_bits = F.element_at(F.array(*[F.array(*[F.lit(_signed(x)) for x in refinements(m, tau)]) for _, m in ring]), F.col("probe").cast("int") + 1)
    finer = F.transform(open_bits, lambda m, i: F.xxhash64("key", i, F.col("fp").bitwiseAND(m)))
    refined = met.filter(F.col("held") > block).select("probe", F.explode(finer).alias("key"), "fp", "rep")
    many = staged(refined.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("cuts", F.ceil(F.col("n") / block)), "refined-keys")
    dealt = join_spread(refined, many, "key", (tau + 1) * total).withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), "cuts"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).select(
        "key", "probe", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp", "rep"
    )
    return _compared(plain.unionByName(paired), ring, segments, tau)


def _compared(rows: DataFrame, ring: list[tuple[int, int]], segments: int, tau: int) -> DataFrame:
    """The links within each group (key, probe, p, q) of rows (fp, rep), as stars."""
    groups = rows.groupBy("key", "probe", "p", "q").agg(F.collect_list(F.struct("fp", "rep")).alias("rows")).filter(F.size("rows") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for probe, found in zip(batch.column("probe").to_pylist(), batch.column("rows"), strict=True):
                x = found.values
                fps = x.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                reps = x.field("rep").to_numpy(zero_copy_only=False)
                label = block_links(fps, ring[probe][0], segments, tau)
                hit = label != np.arange(len(label))
                a.append(reps[hit])
                b.append(reps[label[hit]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for v in (a, b)], names=["a", "b"])

    return groups.select("probe", "rows").mapInArrow(run, "a long, b long")


def grouped_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, segments: int = SEGMENTS, tau: int = TAU) -> DataFrame:
    """``(doc, row, fp, head)`` of each row: its id (null: the largest long), its text's hash,
    its fingerprint and the least (id, fingerprint) of its near-duplicate group."""
    small_batches(docs.sparkSession)
    table = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    each = staged(fingerprints(table, shingle), "fingerprints")
    distinct, seen = staged_with(each.groupBy("fp").agg(F.min("doc").alias("rep"), F.count("*").alias("n")), "distinct-fingerprints", rows=F.count("*"), total=F.sum("n"), most=F.max("n"))
    # several null ids share one key and must stay apart as nodes: their fingerprint tells them apart
    nodes = distinct.select("fp", "n", F.struct("rep", "fp").alias("node"))
    found = link_edges(distinct.select("fp", F.col("fp").alias("rep")), segments, tau, count=seen["rows"])
    ends = nodes.select(F.col("fp").alias("a"), F.col("node").alias("na"))
    other = nodes.select(F.col("fp").alias("b"), F.col("node").alias("nb"))
    edges = staged(found.distinct(), "links").join(ends, "a").join(other, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    parts = connected_components(edges)
    named = nodes.join(parts, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("head"))
    # rows of a fingerprint that a large share of all rows has stay where they are
    return join_spread(each, named, "fp", seen["total"] or 0, most=seen["most"] or 0).select("doc", "row", "fp", "head")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, segments: int = SEGMENTS, tau: int = TAU) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint, component_id``.

    Null or blank text: fingerprint zero, linked like any other. Null id: a row of its
    own that lends its links but names a component only if all ids in it are null
    (then null). Repeated rows and ids each give their row. Extra columns are ignored.
    """
    each = grouped_rows(docs, id_col, text_col, shingle, segments, tau)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    null_last = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return each.select(null_last("doc").alias(id_col), hexed.alias("fingerprint"), null_last("head.rep").alias("component_id"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
