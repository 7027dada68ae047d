"""Containment joins by equality: a term's proper substrings are rows of their own.

A containment test between all terms of a document costs the square of their number;
a term of n characters has fewer than n*(n+1)/2 substrings, so these joins stay linear
in the terms and shuffle by (document, substring).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T


def proper_substrings(terms: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, longer, carried…, term) for every distinct proper substring of every term."""
    n = F.length("longer")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(F.col("longer"), i, size)),
        )
    )
    rows = terms.select("doc_id", F.col("term").alias("longer"), *carried).filter(n > 1)
    return rows.select("doc_id", "longer", *carried, F.explode(F.array_distinct(spans)).alias("term"))


def over_longer(terms: DataFrame, *aggregates) -> DataFrame:
    """(doc_id, term, aggregates…) over the longer terms around each substring, summed up
    before the shuffle; substrings that are no terms are left for a join to drop. A
    term stands once in its document. ``aggregates`` may use the columns of ``terms``."""
    carried = [c for c in terms.columns if c not in ("doc_id", "term")]
    return proper_substrings(terms, *carried).groupBy("doc_id", "term").agg(*aggregates)


def containing_pairs(terms: DataFrame) -> DataFrame:
    """(doc_id, term, longer): both are terms of the document and term is inside longer."""
    own = terms.select("doc_id", "term").distinct()
    return proper_substrings(own).join(own, ["doc_id", "term"])


def sentence_hits(terms: DataFrame, docs: DataFrame, split=T.sentences) -> DataFrame:
    """(doc_id, term, sent_no) for every sentence that holds the term."""
    text = docs.select("doc_id", split(F.col("text")).alias("s"))
    both = terms.select("doc_id", "term").distinct().join(text, "doc_id")
    hits = F.filter(F.transform("s", lambda s, i: F.when(F.contains(s, F.col("term")), i)), lambda i: i.isNotNull())
    return both.select("doc_id", "term", F.explode(hits).alias("sent_no"))


def cooccurrence(terms: DataFrame, docs: DataFrame, split=T.sentences) -> DataFrame:
    """(doc_id, a, b, n): sentences in which both terms stand, a < b."""
    hits = sentence_hits(terms, docs, split).groupBy("doc_id", "sent_no").agg(F.array_sort(F.collect_set("term")).alias("t"))
    left = hits.select("doc_id", "t", F.posexplode("t").alias("i", "a"))
    pairs = left.select("doc_id", "a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b"))
    return pairs.groupBy("doc_id", "a", "b").agg(F.count("*").alias("n"))


def longest_parent(terms: DataFrame) -> DataFrame:
    """(doc_id, child, parent): for each term the longest other term inside it."""
    w = Window.partitionBy("doc_id", "longer").orderBy(F.desc(F.length("term")), "term")
    ranked = containing_pairs(terms).withColumn("r", F.row_number().over(w)).filter("r = 1")
    return ranked.select("doc_id", F.col("longer").alias("child"), F.col("term").alias("parent"))
