"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (by a hash of their id), laid end to end and cut
into blocks of equal word counts. Slots of the mix are golden-ratio points mapped
through the sources' cumulative shares; a slot's rank among its source's slots names
the block that fills it, going round the blocks again for sources that repeat. The
last block of a source is cut where its target is met.

Running totals over a source (of words, or of slots) are made of totals of small
buckets and a window inside each bucket, so no task holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import word_count
from termloom.operators.joins import join_spread
from termloom.session import staged, staged_with, tidy

WEIGHTS, MOST_REPEATS, BLOCK_WORDS = (5, 2, 1), 3, 512
#: Rows of a source whose shuffled order is summed together, about; the least number of
#: slots ranked together; cells of the unit interval.
BUCKET_ROWS, SLOT_CHUNK, CELLS = 1 << 13, 256, 4096
_GOLDEN = 0.6180339887498949
_GOLDEN_HIGH = 0.6180339887498948482 * (1 << 20) % 1


def golden_point(i: Column) -> Column:
    """frac(i * golden ratio) kept exact for large i by splitting it."""
    high, low = F.floor(i / (1 << 20)), F.pmod(i, F.lit(1 << 20))
    frac = lambda x: x - F.floor(x)
    return frac(frac(high * F.lit(_GOLDEN_HIGH)) + frac(low * F.lit(_GOLDEN)))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sizes``, a table (source, source_size, ...), with ``sid, weight, target``.

    Sources by code point, null last, take the weights in turn and share the total
    size; none exceeds ``most`` times its own size, and what is above is shared again.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    ratio = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    capped = (
        sizes.withColumn("sid", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(ratio), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(ratio), F.lit(0.0))))
        .withColumn("full", F.col("level") >= F.col("ratio"))
        .withColumn("share", F.min_by("level", F.when(~F.col("full"), F.struct("ratio", "sid"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight")))
    return capped.select(*sizes.columns, "sid", "weight", target.alias("target"))


def _block_of(word: Column) -> Column:
    """The block that holds a word offset: the first ``extra`` blocks have one word more."""
    wide = F.col("extra") * (F.col("base") + 1)
    return F.when(word < wide, F.floor(word / (F.col("base") + 1))).otherwise(F.col("extra") + F.floor((word - wide) / F.col("base"))).cast("long")


def _block_start(block: Column) -> Column:
    return block * F.col("base") + F.least(block, F.col("extra"))


def plan(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Sources with their blocks (``blocks`` of ``base`` words, ``extra`` of them one
    longer), the words to take and the slots that needs."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    rest = F.pmod("want", F.greatest("source_size", F.lit(1)))
    return (
        sources.filter("source_size > 0")
        .withColumn("blocks", blocks)
        .withColumn("base", F.floor(F.col("source_size") / F.col("blocks")).cast("long"))
        .withColumn("extra", F.pmod("source_size", "blocks"))
        .withColumn("want", F.floor(F.col("target") + 1e-6).cast("long"))
        .withColumn("rest", rest)
        .withColumn("slots", F.floor(F.col("want") / F.col("source_size")).cast("long") * F.col("blocks") + F.when(F.col("rest") > 0, _block_of(F.col("rest") - 1) + 1).otherwise(0))
        .filter("slots > 0")
    )


def facts(planned: DataFrame) -> dict:
    """Totals and maxima over the sources of a plan."""
    return planned.agg(F.sum("slots").alias("slots"), F.max("slots").alias("most_slots")).first().asDict()


def schedule(planned: DataFrame, known: dict | None = None) -> DataFrame:
    """``(slot, sid, rank)``: which source each slot takes and the slot's rank in it.

    Ranks beyond a source's need are left out; the few that the points miss are
    appended as closing slots."""
    spark = planned.sparkSession
    known = known or facts(planned)
    total = known["slots"] or 0
    if total == 0:
        return spark.createDataFrame([], "slot long, sid int, rank long")
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    shares = (
        planned.select("sid", "slots")
        .withColumn("hi", F.sum("slots").over(upto) / F.lit(float(total)))
        .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    )
    chunk = max(SLOT_CHUNK, math.isqrt(total))  # as many slots in a chunk as there are chunks
    points = spark.range(total).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(shares, "cell").filter("u >= lo AND u < hi").select("slot", "sid", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = hit.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = hit.join(offsets, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.row_number().over(inside) - 1).alias("rank"))
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    need = planned.select("sid", "slots").join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    closing = need.filter("slots > got").select("sid", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank")).select(F.lit(total).cast("long").alias("slot"), "sid", "rank")
    kept = join_spread(ranked, planned.select("sid", "slots", F.col("slots").alias("n")), "sid", total, most=known["most_slots"]).filter("rank < slots").select("slot", "sid", "rank")
    return kept.unionByName(closing)


def laid_out(docs: DataFrame, planned: DataFrame, known: dict, seed: int = 0) -> DataFrame:
    """``(sid, source, base, extra, uid, doc, size, at)``: each row's first word in its source's
    shuffled order. Rows alike in id and text may stand in either order. ``docs`` and
    ``planned`` name a source by ``key``."""
    h = F.xxhash64("doc", "row", F.lit(seed))
    named = planned.select("key", "sid", "source", "base", "extra", F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets"), F.col("rows").alias("n"))
    placed = join_spread(docs.drop("source"), named, "key", known["rows"] or 0, most=known["most_rows"] or 0).select("sid", "source", "base", "extra", "uid", "doc", "row", "size", h.alias("h"), F.pmod(F.shiftright(h, 20), "buckets").alias("bucket"))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", F.col("doc").asc_nulls_last(), "row", "uid").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, ["sid", "bucket"]).select("sid", "source", "base", "extra", "uid", "doc", "size", (F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("at"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(mix, documents)``. ``mix`` holds the pieces in slot order: ``slot, rank, source,
    doc_id, uid, start, n_words`` (words start .. start+n_words of that row). ``documents``
    has one row for each row of ``docs``: ``uid, doc_id, source, size, source_size, target``.

    ``uid`` numbers the rows of this run: null and repeated ids and repeated rows stay rows of
    their own. Null text: size 0, never taken. Null source: the last source. An empty table
    gives two empty ones. Extra columns are ignored.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("row"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    sized = staged(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("key", key), "sizes")
    # totals over the sources are taken while they are written
    sources, every = staged_with(targets(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, most), "sources", rows=F.sum("rows"), most_rows=F.max("rows"))
    planned, known = staged_with(plan(sources, block_words), "plan", slots=F.sum("slots"), most_slots=F.max("slots"), rows=F.sum("rows"), most_rows=F.max("rows"))
    total = known["slots"] or 0
    # schedule and layout are written, so that each plan stays small
    slots = join_spread(staged(schedule(planned, known), "slots"), planned.select("sid", "blocks", "base", "extra", "rest", F.col("slots").alias("need"), F.col("slots").alias("n")), "sid", total, most=known["most_slots"] or 0)
    tidy(docs.sparkSession)  # of the schedule's plan
    block = F.pmod("rank", "blocks")
    lo = _block_start(F.col("block"))
    hi = F.when((F.col("rank") == F.col("need") - 1) & (F.col("rest") > 0), F.col("rest")).otherwise(_block_start(F.col("block") + 1))
    filled = slots.withColumn("block", block).select("slot", "sid", "rank", "block", lo.alias("lo"), hi.alias("hi"))
    pieces = (
        staged(laid_out(sized.filter("size > 0"), planned, known, seed), "layout")
        .withColumn("block", F.explode(F.sequence(_block_of(F.col("at")), _block_of(F.col("at") + F.col("size") - 1))))
        .select("sid", "block", "source", "uid", "doc", "size", "at")
    )
    start, stop = F.greatest("lo", "at"), F.least("hi", F.col("at") + F.col("size"))
    mixed = filled.join(pieces, ["sid", "block"]).filter(start < stop).select("slot", "rank", "source", F.col("doc").alias(id_col), "uid", (start - F.col("at")).alias("start"), (stop - start).alias("n_words"))
    named = sources.select("key", "source_size", "target", F.col("rows").alias("n"))
    documents = join_spread(sized, named, "key", every["rows"] or 0, most=every["most_rows"] or 0).select("uid", F.col("doc").alias(id_col), "source", "size", "source_size", "target")
    return mixed, documents


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, size, source_size, target, taken`` where
    ``taken`` counts the words the mix takes of it, repeats included. See ``mix``."""
    mixed, documents = mix(docs, **options)
    taken = mixed.groupBy(F.col("uid").alias("u")).agg(F.sum("n_words").alias("n"))
    return documents.join(taken, F.col("uid") == F.col("u"), "left").select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
