"""Retrieval chains as DataFrame functions, for ``df.transform``. A batch is the table
itself; single inputs are tables of one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import generation as L
from termloom.operators import retrieval as I
from termloom.operators import similarity as V


def hybrid_definition(index: I.Bm25Index, client: L.LlmClient, vectors: DataFrame | None = None, embedder: L.Embedder | None = None, k: int = 5) -> Callable[[DataFrame], DataFrame]:
    """A chain from (query_id, term) to (query_id, term, context, definition): BM25 and, with
    ``vectors`` (id, embedding), vector hits, fused by their real ids."""
    texts = index.docs.select("doc_id", "text")

    def chain(terms: DataFrame) -> DataFrame:
        queries = terms.select("query_id", F.col("term").alias("text"))
        hits = index.search(queries, k).withColumn("source", F.lit("bm25"))
        if vectors is not None:
            asked = L.embed(queries, embedder).select(F.col("query_id").alias("id"), "embedding")
            hits = hits.unionByName(V.search(asked, vectors, k).withColumn("source", F.lit("vector")))
        context = I.context_text(I.fuse(hits.join(texts, "doc_id")))
        return L.define(terms.join(context, "query_id", "left"), client)

    return chain


def vector_definition(vectors: DataFrame, texts: DataFrame, client: L.LlmClient, embedder: L.Embedder | None = None, k: int = 5) -> Callable[[DataFrame], DataFrame]:
    """A chain from (query_id, term) to (…, context, definition) by vector hits alone."""

    def chain(terms: DataFrame) -> DataFrame:
        asked = L.embed(terms.select("query_id", F.col("term").alias("text")), embedder).select(F.col("query_id").alias("id"), "embedding")
        context = I.joined_contexts(V.search(asked, vectors, k).join(texts, "doc_id"), k)
        return L.define(terms.join(context, "query_id", "left"), client)

    return chain
