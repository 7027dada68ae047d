"""Clusters of defined terms and their hierarchy, composed for every document at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.predicates import has_text
from termloom.operators import clustering as K
from termloom.operators import generation as L
from termloom.operators import retrieval as I
from termloom.operators import similarity as V
from termloom.session import staged

KEYS = ("doc_id",)


def term_hierarchy(terms: DataFrame, embedder: L.Embedder | None = None, client: L.LlmClient | None = None, min_size: int = 2) -> tuple[DataFrame, DataFrame]:
    """(clusters, cluster_terms) of defined terms (doc_id, term, definition).

    ``clusters``: doc_id, cluster_id, parent_id, representative, level, category, confidence,
    reason. Density clusters of the definitions' embeddings, represented by their shortest
    term; nodes of the condensed tree with two clusters or more directly below are their
    parents (``cluster_id`` below -1); clusters of one level whose terms stand inside each
    other's are linked. Categories come from ``client``; without one parents alone have
    theirs. ``cluster_terms``: doc_id, cluster_id, term; noise is in neither. Documents with
    fewer than ``min_size`` defined terms have no clusters.
    """
    defined = staged(L.embed(terms.filter(has_text(F.col("definition"))).select(*KEYS, "term", "definition").withColumn("text", F.col("definition")), embedder), "definitions")
    labels = staged(K.cluster_labels(defined, min_size).filter("cluster_id <> -1"), "labels")
    reps = K.representatives(labels, KEYS)
    parents = staged(K.parents_from_tree(K.cluster_tree(defined, min_size), reps, KEYS), "parents")
    above = parents.select(*KEYS, F.explode("children").alias("cluster_id"), (-F.col("parent") - 2).alias("tree_parent"))
    leaves = reps.join(above, [*KEYS, "cluster_id"], "left").select(*KEYS, F.col("cluster_id").cast("long").alias("cluster_id"), F.col("tree_parent").cast("long").alias("tree_parent"), "representative", F.when(F.col("tree_parent").isNotNull(), 1).otherwise(0).alias("level"))
    inner = parents.select(*KEYS, (-F.col("parent") - 2).cast("long").alias("cluster_id"), F.lit(None).cast("long").alias("tree_parent"), "representative", F.lit(1).alias("level"), F.col("name").alias("own_name"))
    nodes = staged(leaves.withColumn("own_name", F.lit(None).cast("string")).unionByName(inner), "nodes")
    inside = labels.join(above, [*KEYS, "cluster_id"]).select(*KEYS, F.col("tree_parent").alias("cluster_id"), "term")
    linked = K.attach_by_subsumption(nodes, K.subsumption_pairs(labels.unionByName(inside), KEYS), KEYS).select(*KEYS, "cluster_id", "parent_id", F.col("level").alias("new_level"))
    joined = nodes.join(linked, [*KEYS, "cluster_id"])
    clusters = joined.select(*KEYS, "cluster_id", F.coalesce("tree_parent", "parent_id").alias("parent_id"), "representative", F.col("new_level").alias("level"), "own_name")
    if client is None:
        none = F.lit(None)
        return clusters.select(*KEYS, "cluster_id", "parent_id", "representative", "level", F.col("own_name").alias("category"), none.cast("double").alias("confidence"), none.cast("string").alias("reason")), labels
    group = F.to_json(F.struct(*KEYS, F.col("cluster_id").cast("long").alias("cluster_id")))
    asked = labels.join(defined.select(*KEYS, "term", "definition"), [*KEYS, "term"]).select(group.alias("cluster_id"), "term", "definition")
    names = L.cluster_categories(asked, client).select(F.col("cluster_id").alias("g"), "category", "confidence", "reason")
    out = clusters.withColumn("g", group).join(names, "g", "left")
    return out.select(*KEYS, "cluster_id", "parent_id", "representative", "level", F.coalesce("category", "own_name").alias("category"), "confidence", "reason"), labels


def hierarchy_lines(clusters: DataFrame, cluster_terms: DataFrame, most: int = 5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys…, term, siblings): the category of a term's cluster and up to ``most`` of the other
    terms in it, as the prompt of a definition has them."""
    own = cluster_terms.join(clusters.select(*keys, "cluster_id", "category"), [*keys, "cluster_id"])
    together = cluster_terms.groupBy(*keys, "cluster_id").agg(F.array_sort(F.collect_set("term")).alias("t"))
    rest = F.filter("t", lambda x: x != F.col("term"))
    name = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.concat(F.lit("クラスタ "), F.col("cluster_id").cast("string")))
    more = F.when(F.size("rest") > most, F.concat(F.lit(" など（他"), (F.size("rest") - most).cast("string"), F.lit("件）"))).otherwise("")
    line = F.when(F.size("rest") > 0, F.concat(F.lit("\n【関連用語（同カテゴリ）】"), F.array_join(F.slice("rest", 1, most), ", "), more)).otherwise("")
    return own.join(together, [*keys, "cluster_id"]).withColumn("rest", rest).select(*keys, "term", F.concat(F.lit("【所属カテゴリ】"), name, line).alias("siblings"))


def blank_words(text: Column) -> Column:
    """What stands between blanks: how the context of a term asks a word index."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def term_contexts(terms: DataFrame, index: I.Bm25Index | None = None, vectors: DataFrame | None = None, texts: DataFrame | None = None, embedder: L.Embedder | None = None, k: int = 3) -> DataFrame:
    """(query_id, context) of (query_id, term): the ``k`` nearest texts of ``vectors`` (id,
    embedding) and ``texts`` (doc_id, text) if there are any, else the ``k`` best of the word
    index for what stands between the term's blanks, one below the other; else empty."""
    if vectors is not None and texts is not None:
        asked = L.embed(terms.select("query_id", F.col("term").alias("text")), embedder).select(F.col("query_id").alias("id"), "embedding")
        hits = V.search(asked, vectors, k).join(texts.select("doc_id", "text"), "doc_id")
    elif index is not None:
        hits = index.search(terms.select("query_id", F.col("term").alias("text")), k, blank_words).join(index.docs.select("doc_id", "text"), "doc_id")
    else:
        return terms.select("query_id", F.lit("").alias("context"))
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("l"))
    return rows.select("query_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("context"))


def hierarchy_definitions(terms: DataFrame, clusters: DataFrame, cluster_terms: DataFrame, client: L.LlmClient, **source) -> DataFrame:
    """Terms (doc_id, term) with ``context``, ``siblings`` and ``definition``: each is defined apart
    from the others of its cluster. ``source`` is what ``term_contexts`` looks in."""
    asked = staged(terms.select("doc_id", "term").distinct().withColumn("query_id", F.xxhash64("doc_id", "term")), "asked")
    lines = hierarchy_lines(clusters, cluster_terms)
    rows = asked.join(term_contexts(asked, **source), "query_id", "left").join(lines, ["doc_id", "term"], "left")
    return L.define(rows.withColumn("siblings", F.coalesce("siblings", F.lit("階層情報なし"))), client).drop("query_id")
