"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.joins import join_spread
from termloom.session import release, staged_so_far, staged_with


def _with_least(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(edges with ``m``, the least neighbour of ``a``; the least neighbours). The edges of a
    hub are not brought together: its least neighbour is sent to them."""
    grouped = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least, seen = staged_with(grouped, "least", most=F.max("n"))
    return join_spread(edges, least, "a", total, most=seen["most"] or 0), least


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met, _ = _with_least(both, 2 * total)
    return met.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    met, least = _with_least(down, total)
    moved = met.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of the undirected edges ``(a, b)`` of any
    one orderable type; a component is named by its smallest node.

    Self-loops and edges with a null end are ignored. Each half round is written to the
    shared folder, so the lineage stays short, and the one before it removed; the driver
    sees only a row count and a checksum. Raises RuntimeError if ``max_rounds`` do not
    suffice.
    """
    spark = edges.sparkSession
    measures = {"rows": F.count("*"), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now, mark = staged_with(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", **measures)
    seen = None
    for _ in range(max_rounds):
        for star in (_large_star, _small_star):
            since = staged_so_far() - 1
            now, mark = staged_with(star(now, mark["rows"]), "edges", **measures)
            release(spark, since, keep=1)  # the edges before and their least neighbours
        if mark == seen or not mark["rows"]:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        seen = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
