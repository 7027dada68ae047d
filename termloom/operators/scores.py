"""Scores of candidates. All work per document: sentences stand in for documents in IDF."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import patterns as P
from termloom.functions import text as T
from termloom.functions.numbers import ln
from termloom.operators.containment import over_longer


def by_doc():
    return Window.partitionBy("doc_id")


def _occurrences(terms: list[str], text: str, sentences: list[str]) -> tuple[list[int], list[int]]:
    """For each of a document's terms how often it stands in the text, without overlap, and in
    how many sentences: one pass over either, whatever the number of terms."""
    matcher = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        matcher.add_word(t, i)
    matcher.make_automaton()
    size, free = [len(t) for t in terms], [0] * len(terms)
    found, held, seen = [0] * len(terms), [0] * len(terms), [-1] * len(terms)
    for end, i in matcher.iter(text):
        if end + 1 - size[i] >= free[i]:
            found[i] += 1
            free[i] = end + 1
    for k, s in enumerate(sentences):
        for _, i in matcher.iter(s):
            if seen[i] != k:
                seen[i] = k
                held[i] += 1
    return found, held


def terms_with_text(candidates: DataFrame, docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, terms, text, more…): each document once, with all its candidates."""
    own = candidates.groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    return own.join(docs.filter("text IS NOT NULL").select("doc_id", "text", *more), "doc_id")


def text_statistics(candidates: DataFrame, docs: DataFrame, split=T.sentences) -> DataFrame:
    """Candidates with ``n_found`` (occurrences in the text), ``n_chars``, ``n_sentences``
    and ``df`` (sentences that hold the term).

    The unit is a document with all its terms: a matcher of them goes over the text once, so
    a long document costs its length, not its length for each term."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, found, held, chars, sentences = [], [], [], [], [], []
            for doc, own, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "terms", "text", "sentences")), strict=True):
                n, df = _occurrences(own, text, parts)
                ids += [doc] * len(own)
                terms += own
                found += n
                held += df
                chars += [len(text)] * len(own)
                sentences += [len(parts)] * len(own)
            columns = [pa.array(ids, batch.schema.field("doc_id").type), pa.array(terms, pa.string()), *(pa.array(x, pa.int64()) for x in (found, chars, sentences, held))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "term", "n_found", "n_chars", "n_sentences", "df"])

    rows = terms_with_text(candidates, docs, split(F.col("text")).alias("sentences"))
    stats = rows.mapInArrow(run, f"doc_id {kind}, term string, n_found long, n_chars long, n_sentences long, df long")
    return candidates.join(stats, ["doc_id", "term"]).select(*candidates.columns, "n_found", "n_chars", "n_sentences", "df")


def tfidf_v4(stats: DataFrame) -> DataFrame:
    """Smoothed TF-IDF of the occurrences in the text; expects ``text_statistics``."""
    tf = (F.col("n_found") + 0.5) / (F.col("n_chars") + 1)
    idf = F.greatest(F.lit(0.1), ln((F.col("n_sentences") + 1) / (F.greatest("df", F.lit(1)) + 1)) + 1)
    return stats.withColumn("tfidf", tf * idf)


def tfidf_v3(stats: DataFrame) -> DataFrame:
    """As v4, but a document whose scores are all zero falls back to shares of occurrences."""
    scored = tfidf_v4(stats)
    total, peak = F.sum("n_found").over(by_doc()), F.max("tfidf").over(by_doc())
    share = F.when(total > 0, F.col("n_found") / total).otherwise(0.0)
    return scored.withColumn("tfidf", F.when(peak > 0, F.col("tfidf")).otherwise(share))


def tfidf_semrerank(stats: DataFrame) -> DataFrame:
    """TF-IDF of the candidate frequency; expects statistics over ``sentences_all``."""
    tf = F.when(F.col("n_chars") > 0, F.col("freq") / F.col("n_chars")).otherwise(0.0)
    return stats.withColumn("tfidf", tf * (ln((F.col("n_sentences") + 1) / (F.col("df") + 1)) + 1))


def nesting(candidates: DataFrame) -> DataFrame:
    """Candidates with ``n_longer`` and ``f_longer``: number and summed frequency of the
    longer candidates around each."""
    rows = candidates.select("doc_id", "term", F.col("freq").alias("f"))
    around = over_longer(rows, F.count("*").alias("n_longer"), F.sum("f").alias("f_longer"))
    out = candidates.join(around, ["doc_id", "term"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_longer", "f_longer")})


def cvalue_v4(nested: DataFrame) -> DataFrame:
    """The v4 form, which divides the nested mean by the number of longer terms once more."""
    n = F.col("n_longer")
    inner = F.when(n == 0, F.col("freq").cast("double")).otherwise(F.col("freq") - F.col("f_longer") / n / n)
    return nested.withColumn("cvalue", F.greatest(F.lit(0.0), ln(F.length("term") + 1) * inner))


def cvalue(nested: DataFrame) -> DataFrame:
    """The published form."""
    n = F.col("n_longer")
    inner = F.when(n == 0, F.col("freq").cast("double")).otherwise(F.col("freq") - F.col("f_longer") / n)
    return nested.withColumn("cvalue", F.greatest(F.lit(0.0), F.log2(F.greatest(F.length("term"), F.lit(2))) * inner))


def min_max(x: Column, over=None) -> Column:
    """To [0, 1]; 1 for a single value, 0.5 where all are alike."""
    over = over or by_doc()
    lo, hi, n = F.min(x).over(over), F.max(x).over(over), F.count(x).over(over)
    return F.when(n == 1, 1.0).when(hi - lo < 1e-10, 0.5).otherwise((x - lo) / (hi - lo))


def to_unit(x: Column, over=None) -> Column:
    """To [0.01, 1]; 0.5 where all are alike."""
    over = over or by_doc()
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    return F.when(hi == lo, 0.5).otherwise(0.01 + 0.99 * (x - lo) / (hi - lo))


def base_v4(scored: DataFrame) -> DataFrame:
    return scored.withColumn("base", 0.7 * F.col("tfidf") + 0.3 * F.col("cvalue"))


def base_v3(scored: DataFrame) -> DataFrame:
    return scored.withColumn("base", 0.4 * to_unit(F.col("tfidf")) + 0.6 * to_unit(F.col("cvalue")))


def base_semrerank(scored: DataFrame, stage: str = "final") -> DataFrame:
    """Stage "seed" favours the C-value, "final" the TF-IDF."""
    a, b = {"seed": (0.3, 0.7), "final": (0.7, 0.3)}[stage]
    return scored.withColumn("base", a * min_max(F.col("tfidf")) + b * min_max(F.col("cvalue")))


def heading_bonus(scored: DataFrame, headings: DataFrame, column: str = "base") -> DataFrame:
    """Double the score of heading terms."""
    flagged = scored.join(headings.select("doc_id", "term").distinct().withColumn("_h", F.lit(2.0)), ["doc_id", "term"], "left")
    return flagged.withColumn(column, F.col(column) * F.coalesce("_h", F.lit(1.0))).drop("_h")


def components(term: Column) -> Column:
    return F.regexp_count(term, F.lit(P.COMPONENT))


def complexity_bonus(scored: DataFrame, column: str = "base") -> DataFrame:
    """0.3 more for each component beyond the first."""
    return scored.withColumn(column, F.col(column) * (1 + 0.3 * F.greatest(F.lit(0), components(F.col("term")) - 1)))


def fuse_rank(scored: DataFrame, ranks: DataFrame) -> DataFrame:
    """Blend 0.4 of ``base`` with 0.6 of the PageRank rescaled to [0.1, 0.9] (0.5 where all
    are alike or none is known): gains ``score``."""
    joined = scored.join(ranks.select("doc_id", "term", "rank"), ["doc_id", "term"], "left")
    lo, hi = F.min("rank").over(by_doc()), F.max("rank").over(by_doc())
    scaled = F.when(hi == lo, 0.5).otherwise(0.1 + 0.8 * (F.col("rank") - lo) / (hi - lo))
    return joined.withColumn("score", 0.4 * F.col("base") + 0.6 * F.coalesce(scaled, F.lit(0.5)))


def multiply_rank(scored: DataFrame, ranks: DataFrame) -> DataFrame:
    """base * rank, missing values 0.01 and 0.5: gains ``score``."""
    joined = scored.join(ranks.select("doc_id", "term", "rank"), ["doc_id", "term"], "left")
    return joined.withColumn("score", F.coalesce("base", F.lit(0.01)) * F.coalesce("rank", F.lit(0.5)))


def revise_by_words(scored: DataFrame, importance: DataFrame) -> DataFrame:
    """(1 + mean normalised importance of a term's words) * base / largest base: gains
    ``score``. ``importance``: (doc_id, word, importance)."""
    peak = F.max("importance").over(by_doc())
    normed = importance.select("doc_id", "word", F.when(peak > 0, F.col("importance") / peak).otherwise(F.col("importance")).alias("imp"))
    words = scored.select("doc_id", "term", F.explode(T.term_words(F.col("term"))).alias("word"))
    mean = words.join(normed, ["doc_id", "word"], "left").groupBy("doc_id", "term").agg(F.avg(F.coalesce("imp", F.lit(0.0))).alias("mean"))
    top = F.max("base").over(by_doc())
    out = scored.join(mean, ["doc_id", "term"], "left")
    return out.withColumn("score", (1 + F.coalesce("mean", F.lit(0.0))) * F.col("base") / F.when(top > 0, top).otherwise(1.0)).drop("mean")


def definition_budget(candidates: Column) -> Column:
    """How many terms to define: a quarter, between 15 and 50."""
    return F.greatest(F.lit(15), F.least(F.floor(candidates * 0.25), F.lit(50))).cast("long")
