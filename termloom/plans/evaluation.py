"""Which terms a model does not know: definitions without context against extracted ones.

``spark-submit -m termloom.plans.evaluation terms.json report/ -t 0.7``
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.vectors import cosine
from termloom.operators import dictionary as D
from termloom.operators import generation as L
from termloom.sources.loaders import flatten_results
from termloom.sources.sinks import save_report


def evaluate_terms(terms: DataFrame, client: L.LlmClient, embedder: L.Embedder | None = None, threshold: float = 0.7) -> DataFrame:
    """Judged terms of (term, definition, field): see ``dictionary.evaluate``."""
    free = L.define_alone(terms.withColumn("field", F.coalesce("field", F.lit(""))), client).withColumnRenamed("definition", "original_definition")
    for column, vector in (("original_definition", "u"), ("context_free_definition", "v")):
        free = L.embed(free, embedder, column).withColumnRenamed("embedding", vector)
    return D.evaluate(free.withColumn("similarity", cosine(F.col("u"), F.col("v"))).drop("u", "v"), threshold)


def evaluate_file(spark: SparkSession, path: str, client: L.LlmClient, embedder: L.Embedder | None = None, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(summary, judged terms) of a file of extraction results. The summary counts terms, the
    unknown (by the model's own admission, or by similarity), the known and the errors."""
    judged = evaluate_terms(flatten_results(spark, path), client, embedder, threshold)
    counts = D.evaluation_summary(judged)
    return counts.withColumn("similarity_unknown", F.col("unknown") - F.col("explicitly_unknown")).withColumn("threshold", F.lit(threshold)), judged


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termloom.evaluation", description="Evaluate extracted terms.")
    p.add_argument("input", nargs="?", default="output/llm_terms.json")
    p.add_argument("output", nargs="?", default="output/unknown_term_evaluation")
    p.add_argument("-t", "--threshold", type=float, default=0.7)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, client: L.LlmClient | None = None, embedder: L.Embedder | None = None) -> None:
    """Without a client every term is one that the model admits not to know."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("termloom").getOrCreate()
    summary, judged = evaluate_file(spark, args.input, client or L.StubClient(lambda prompt: "定義不明"), embedder, args.threshold)
    save_report(summary, judged, args.output)
    summary.show()
    D.shown(judged).select("term", "similarity", "status").show(truncate=False)


if __name__ == "__main__":
    main()
