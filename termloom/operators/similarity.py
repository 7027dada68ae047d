"""Similarity joins over embeddings: (id, embedding).

Vectors are compared in blocks: rows are dealt into blocks of bounded size, every pair
of blocks is one row of work, and numpy multiplies two blocks at once. Only pairs that
reach the threshold, or are among a row's best, leave a block, so nothing of the size of
all pairs is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def _blocked(vectors: DataFrame, blocks: int, salt: int) -> DataFrame:
    """One row for each block: its number, its ids and its vectors."""
    where = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks))
    return vectors.select(where.alias("block"), F.struct("id", "embedding").alias("v")).groupBy("block").agg(F.collect_list("v").alias("rows"))


def _matrix(rows: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
    values = rows.values
    ids = values.field("id").to_numpy(zero_copy_only=False)
    x = np.array([np.asarray(v.values.to_numpy(zero_copy_only=False), float) for v in values.field("embedding")])
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return ids, x / np.where(length > 0, length, 1.0)


def _best(s: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Marks of the ``k`` largest allowed values of each row, and of all that equal the last."""
    if s.shape[1] <= k:
        return allowed
    s = np.where(allowed, s, -np.inf)
    return allowed & (s >= np.partition(s, -k, axis=1)[:, -k, None])


def pairs_above(left: DataFrame, threshold: float, right: DataFrame | None = None, block: int = BLOCK, best: int | None = None) -> DataFrame:
    """(a, b, similarity) with cosine >= ``threshold``: within ``left`` each unordered pair
    once (a < b), or every pair of ``left`` and ``right``. A vector of zero length is
    similar to none (0). With ``best`` only pairs leave a pair of blocks that may be among
    the ``best`` of one of their ends (of ``a``, where there are two tables); ties all do."""
    same = right is None
    other = left if same else right
    kind = dict(left.dtypes)["id"]
    kind_b = dict(other.dtypes)["id"]
    n, m = left.count(), other.count()
    blocks, others = max(1, -(-n // block)), max(1, -(-m // block))
    a = _blocked(left, blocks, 1).select(F.col("block").alias("i"), F.col("rows").alias("x"))
    b = _blocked(other, others, 1).select(F.col("block").alias("j"), F.col("rows").alias("y"))
    if same:
        pairs = a.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1).cast("long"))))
    else:
        pairs = a.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
    work = pairs.join(b, "j").select("i", "j", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ia, xa = _matrix(batch.column("x")[k])
                ib, xb = _matrix(batch.column("y")[k])
                s = xa @ xb.T
                near = s >= threshold
                if same and batch.column("i")[k] == batch.column("j")[k]:
                    near &= ia[:, None] != ib[None, :]
                    if best is not None:
                        near = _best(s, near, best)
                        near |= near.T
                    near &= ia[:, None] < ib[None, :]
                elif best is not None:
                    near = _best(s, near, best) | _best(s.T, near.T, best).T if same else _best(s, near, best)
                p, q = np.nonzero(near)
                u, v, s = ia[p], ib[q], s[p, q]
                if same:
                    u, v = np.minimum(u, v), np.maximum(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], names=["a", "b", "similarity"])

    return work.mapInArrow(run, f"a {kind}, b {kind_b}, similarity double")


def both_ways(pairs: DataFrame) -> DataFrame:
    """(src, dst, similarity) in either direction."""
    there = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity")
    return there.unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "similarity"))


def top_pairs(vectors: DataFrame, threshold: float = 0.7, most: int = 100) -> DataFrame:
    """The most similar pairs at or above the threshold."""
    return pairs_above(vectors, threshold).orderBy(F.desc("similarity"), "a", "b").limit(most)


def _rank(edges: DataFrame) -> DataFrame:
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")))


def _rank_by(edges: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """The ``k`` most similar edges of each node of each key."""
    w = Window.partitionBy(*keys, "src").orderBy(F.desc("similarity"), "dst")
    return edges.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def nearest(vectors: DataFrame, k: int = 12, least: float = 0.30) -> DataFrame:
    """(src, dst, similarity, rank): up to ``k`` nearest others of similarity ``least`` or more."""
    return _rank(both_ways(pairs_above(vectors, least, best=k))).filter(F.col("rank") <= k)


def related(vectors: DataFrame, least: float = 0.5, share: float = 0.15) -> DataFrame:
    """(src, dst, similarity): of each vector's neighbours the top max(1, share * n) of all n
    vectors that reach ``least``, made symmetric."""
    most = max(1, int(vectors.count() * share))
    cut = _rank(both_ways(pairs_above(vectors, least))).filter(F.col("rank") <= most)
    kept = cut.select("src", "dst", "similarity")
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "similarity")).distinct()


def relatedness_graph(edges: DataFrame, share: float = 0.15, keys: tuple[str, ...] = ()) -> DataFrame:
    """Undirected graph (a, b, weight): of each node's edges (those given reach relmin) the
    top max(1, share * m) of its m edges; the union over both ends. ``keys`` partition
    the edges, by document or sentence."""
    w = Window.partitionBy(*keys, "src")
    order = w.orderBy(F.desc("similarity"), "dst")
    cut = edges.withColumn("r", F.row_number().over(order)).withColumn("m", F.count("*").over(w)).filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("m") * share)))
    return cut.select(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("similarity").alias("weight")).dropDuplicates([*keys, "a", "b"])


def search(queries: DataFrame, index: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, doc_id, score, rank): for each query vector the ``k`` best of the index. A pair
    of blocks gives each query's best of the block, the rest is merged here."""
    hits = pairs_above(queries, least, index, best=k).select(F.col("a").alias("query_id"), F.col("b").alias("doc_id"), F.col("similarity").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
