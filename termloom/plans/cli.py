"""Command line: ``spark-submit`` entry for one file, a folder, or a comparison of profiles."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termloom.operators.dictionary import compare_methods
from termloom.plans.profiles import PROFILES
from termloom.session import release
from termloom.sources.loaders import Loader
from termloom.sources.sinks import save_by_file


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termloom", description="Extract terms from documents.")
    p.add_argument("mode", choices=["single", "batch", "compare"])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--profile", default="v4", choices=PROFILES.names())
    p.add_argument("--pattern", default="*")
    p.add_argument("--recursive", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("termloom").getOrCreate()
    files = Loader().directory(spark, args.input, args.pattern, args.recursive)
    docs = files.select(F.xxhash64("path").alias("doc_id"), "path", "text")
    if args.mode == "compare":
        rows = None
        for name in ("v3", "v4", "semrerank"):
            one = PROFILES.create(name)(docs).select(F.lit(name).alias("method"), "term", "score")
            rows = one if rows is None else rows.unionByName(one)
        compare_methods(rows).write.mode("overwrite").json(args.output)
        release(spark)
        return
    out = PROFILES.create(args.profile)(docs).join(docs.select("doc_id", F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file")), "doc_id")
    save_by_file(out, args.output)
    release(spark)


if __name__ == "__main__":
    main()
