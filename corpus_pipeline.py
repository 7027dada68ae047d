"""The corpus pipeline: documents to a training mix, in stages that each build on the
rows their predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import decontaminate, language_id, mixing, simhash, substring_dedup
from termloom.session import release, staged, staged_so_far, tidy

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NULL_LAST = (1 << 63) - 1
#: No stage but the plain ones can be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    """The columns a stage works on; what the stage before it left behind is cleaned up."""
    tidy(docs.sparkSession)
    return docs.select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; rejected ones go (so do texts
    without a letter). Without any labelled document nothing is rejected."""
    docs = _documents(docs)
    model = language_id.fit(docs)
    if model is None:
        return docs
    return language_id.identify(docs, model).filter("NOT rejected").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id, null ids last; of
    several texts of that id in the group, and of repeated rows, one stays."""
    docs = _documents(docs)
    heads = simhash.grouped_rows(docs).filter((F.col("doc") == F.col("head.rep")) & (F.col("fp") == F.col("head.fp")))
    kept = heads.groupBy("doc", "fp").agg(F.min("row").alias("kept_row")).select(F.col("doc").alias("kept_doc"), "kept_row")
    keyed = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_LAST))).withColumn("row", F.xxhash64("text"))
    first = keyed.join(kept, (F.col("doc") == F.col("kept_doc")) & (F.col("row") == F.col("kept_row")), "left_semi")
    return first.dropDuplicates(["doc", "row"]).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated passages. A text that loses nothing stays as it
    is; one that loses every word goes; ``n_chars`` follows the text. Rows are judged one by
    one: null and shared ids lose nothing but their own repeated words."""
    out = substring_dedup.dedup_substrings(_documents(docs), carry=COLUMNS[1:])
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.filter(~changed | (F.col("kept_text") != "")).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. A row is told by id and text, so null
    and shared ids do not share a verdict; repeated rows do. An empty table stays empty, an
    empty benchmark removes nothing."""
    row = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_LAST)).alias("doc"), F.xxhash64("text").alias("row"))
    docs = _documents(docs).withColumn("key", row)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key")
    bad = found.filter("contaminated").select(F.col("key").alias("bad_key")).distinct()
    return docs.join(bad, F.col("key") == F.col("bad_key"), "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each document its size, its source's size and target, and the words taken.
    One row for each row given, whatever its id; null text has size 0, a null source is the
    last one; an empty table gives an empty one."""
    return mixing.mixed_documents(_documents(docs))


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each stage's rows are written and read again, and
    what it staged on its way, its predecessor's rows among it, is removed."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_so_far()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name)
            release(spark, mark, keep=1)
    return docs
