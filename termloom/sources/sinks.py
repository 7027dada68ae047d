"""Sinks: dictionary table, exports, per-file results, embedding cache."""

from __future__ import annotations

import codecs
import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.dictionary import new_terms

DICTIONARY = "term string, definition string, synonyms string, score double, frequency int, created_at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DICTIONARY).parquet(path) if exists(spark, path) else spark.createDataFrame([], DICTIONARY)


def save_new_terms(terms: DataFrame, path: str) -> DataFrame:
    """Append the terms that the dictionary at ``path`` does not hold; ``terms`` has term,
    definition, synonyms (array), score, frequency and ``ord``. Known terms stay as they are."""
    spark = terms.sparkSession
    rows = new_terms(terms, read_dictionary(spark, path)).select(
        "term", "definition", F.to_json("synonyms").alias("synonyms"), F.col("score").cast("double"), F.col("frequency").cast("int"), F.current_timestamp().alias("created_at")
    )
    rows.write.mode("append").parquet(path)
    return read_dictionary(spark, path)


def drop_tables(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def save_json(terms: DataFrame, path: str) -> None:
    terms.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved dictionary; a missing one is empty."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def export_csv(scored: DataFrame, path: str, most: int = 50) -> None:
    """The best terms as one UTF-8 file with a byte order mark, on any file system that Spark
    reaches: columns 専門用語 and スコア."""
    rows = scored.orderBy(F.desc("score"), "term").limit(most).select("term", "score").collect()
    text = io.StringIO()
    w = csv.writer(text)
    w.writerow(["専門用語", "スコア"])
    w.writerows([r["term"], r["score"]] for r in rows)
    spark = scored.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(codecs.BOM_UTF8 + text.getvalue().encode()))
    finally:
        out.close()


def hierarchy_json(clusters: DataFrame, cluster_terms: DataFrame) -> DataFrame:
    """(representative, json): category, confidence, terms and number of each top cluster."""
    terms = cluster_terms.groupBy("cluster_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    top = clusters.filter("parent_id IS NULL").join(terms, "cluster_id", "left")
    body = F.to_json(F.struct("category", "confidence", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), "cluster_id"))
    return top.select("representative", body.alias("json"))


def save_by_file(results: DataFrame, path: str) -> None:
    """Results of each source file in a folder of its own (column ``source_file``)."""
    results.write.mode("overwrite").partitionBy("source_file").json(path)


def cached_embeddings(texts: DataFrame, path: str, embed) -> DataFrame:
    """(text, embedding): embeddings kept at ``path`` by the md5 of each text; only texts not
    there yet go through ``embed`` (a DataFrame function that adds ``embedding``)."""
    spark = texts.sparkSession
    schema = "key string, embedding array<float>"
    keyed = texts.select("text").distinct().withColumn("key", F.md5(F.col("text").cast("binary")))
    known = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    missing = keyed.join(known, "key", "left_anti")
    embed(missing).select("key", "embedding").write.mode("append").parquet(path)
    return keyed.join(spark.read.schema(schema).parquet(path), "key").select("text", "embedding")


def save_report(summary: DataFrame, judged: DataFrame, path: str) -> None:
    """An evaluation report as JSON below ``path``: the summary row, and the judged terms in a
    folder for each status, written where they are."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    judged.write.mode("overwrite").partitionBy("status").json(f"{path}/terms")
