"""Terms of a stream of documents. All scores are per document, so a micro-batch needs no
state of earlier ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from termloom.plans.profiles import scored_v4


def read_documents(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of (doc_id, text) from parquet files that arrive below ``path``."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_terms(docs: DataFrame, path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = scored_v4, **trigger) -> StreamingQuery:
    """Write the terms of each micro-batch below ``path``. A batch that is run again replaces
    its own rows, so each document's terms are there once."""

    def each(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
