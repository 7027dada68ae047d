"""Named queries over the driver's tables, each with the SQL that gives the same rows.

Scores are rounded to six digits at the edge, on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import patterns as P
from termloom.functions import predicates as is_
from termloom.functions import text as T
from termloom.functions.vectors import cosine
from termloom.operators import candidates as C
from termloom.operators import clustering as K
from termloom.operators import containment as J
from termloom.operators import designed as N
from termloom.operators import dictionary as D
from termloom.operators import generation as L
from termloom.operators import graphs as G
from termloom.operators import ranking as R
from termloom.operators import retrieval as I
from termloom.operators import scores as S
from termloom.operators import similarity as V
from termloom.plans import profiles
from termloom.session import spread, staged

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


def union_sql(patterns, text: str = "text", source: str = "documents") -> str:
    return " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all({text}, '{p}')) AS term FROM {source}" for p in patterns)


# ---------------------------------------------------------------- shared SQL

_GARBAGE = f"(regexp_matches(term, '{P.SHORT_KATAKANA}') OR regexp_matches(term, '^(?:{'|'.join(P.GARBAGE)})'))"
_NOUNS = ", ".join(f"'{n}'" for n in P.COMMON_NOUNS)
_LINES = "SELECT doc_id, trim(l, E' \\t\\r\\x0b\\x0c') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l, E' \\t\\r\\x0b\\x0c') <> ''"


def _heading_sql(headings, flags: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(line, '{flags}{p}') THEN regexp_extract(line, '{flags}{p}', 1)" for p in headings)
    return f"SELECT doc_id, CASE {whens} END AS heading FROM ({_LINES})"


_HEADINGS_V4 = f"SELECT DISTINCT * FROM ({union_sql(P.V4_HEADING_TERMS, 'heading', f'({_heading_sql(P.V4_HEADINGS, '(?i)')})')})"
_HEADINGS_V3 = f"SELECT DISTINCT * FROM ({union_sql(P.SIMPLE_PATTERNS, 'heading', f'({_heading_sql(P.V3_HEADINGS, '')})')}) WHERE length(term) BETWEEN 2 AND 15"

_V4 = f"""
found AS ({union_sql(P.V4_PATTERNS)}),
counted AS (SELECT doc_id, term, count(*) AS freq FROM found WHERE length(term) BETWEEN 2 AND 15 AND NOT regexp_matches(term, '^[0-9]+$') AND NOT {_GARBAGE} AND term NOT IN ({_NOUNS}) GROUP BY doc_id, term),
heads AS ({_HEADINGS_V4}),
merged AS (SELECT doc_id, term, coalesce(freq, 1) + CASE WHEN h.doc_id IS NULL THEN 0 ELSE 2 END AS freq FROM counted FULL JOIN (SELECT doc_id, term, true AS y FROM heads) h USING (doc_id, term)),
merged2 AS (SELECT coalesce(c.doc_id, h.doc_id) AS doc_id, coalesce(c.term, h.term) AS term, coalesce(c.freq, 1) + CASE WHEN h.term IS NULL THEN 0 ELSE 2 END AS freq, h.term IS NOT NULL AS heading FROM counted c FULL JOIN heads h ON c.doc_id = h.doc_id AND c.term = h.term),
cand AS (SELECT doc_id, term, CAST(freq AS BIGINT) AS freq FROM merged2 WHERE NOT {_GARBAGE} AND (freq >= 2 OR regexp_matches(term, '{P.MODEL_NUMBER}') OR (freq = 1 AND heading)))
"""
_V4 = "\n".join(line for line in _V4.splitlines() if not line.startswith("merged AS"))

_SENTENCES_A = "list_filter(string_split(replace(text, chr(10), '。'), '。'), lambda x: regexp_matches(x, '\\S'))"
_SENTENCES_B = "list_filter(string_split_regex(text, '[。！？\\n]+'), lambda x: regexp_matches(x, '\\S'))"
_WHOLE_A = f"CASE WHEN len({_SENTENCES_A}) > 0 THEN {_SENTENCES_A} ELSE [text] END"


def _stats_sql(split: str) -> str:
    return f"""
sent AS (SELECT doc_id, text, {split} AS s FROM documents),
stats AS (SELECT c.*, CAST((length(text) - length(replace(text, term, ''))) // length(term) AS BIGINT) AS n_found, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(s) AS BIGINT) AS n_sentences, CAST(len(list_filter(s, lambda x: contains(x, term))) AS BIGINT) AS df FROM cand c JOIN sent USING (doc_id))"""


_TFIDF = "(n_found + 0.5::DOUBLE) / (n_chars + 1) * greatest(0.1::DOUBLE, ln((n_sentences + 1)::DOUBLE / (greatest(df, 1) + 1)) + 1)"
_NEST = """
nest AS (SELECT a.doc_id, a.term, a.freq, count(b.term) AS n_longer, CAST(coalesce(sum(b.freq), 0) AS BIGINT) AS f_longer FROM cand a LEFT JOIN cand b ON a.doc_id = b.doc_id AND a.term <> b.term AND contains(b.term, a.term) GROUP BY ALL)"""
_CV4 = "greatest(0.0::DOUBLE, ln(length(term) + 1) * CASE WHEN n_longer = 0 THEN freq::DOUBLE ELSE freq - f_longer::DOUBLE / n_longer / n_longer END)"
_CV = "greatest(0.0::DOUBLE, log2(greatest(length(term), 2)) * CASE WHEN n_longer = 0 THEN freq::DOUBLE ELSE freq - f_longer::DOUBLE / n_longer END)"
_SCORED = f"""{_V4}, {_stats_sql(_WHOLE_A)}, {_NEST},
scored AS (SELECT n.doc_id, n.term, n.freq, {_TFIDF} AS tfidf, {_CV4.replace('freq', 'n.freq').replace('n.n.freq', 'n.freq')} AS cvalue FROM nest n JOIN (SELECT doc_id, term AS t, n_found, n_chars, n_sentences, df FROM stats) s ON n.doc_id = s.doc_id AND n.term = s.t),
based AS (SELECT *, 0.7::DOUBLE * tfidf + 0.3::DOUBLE * cvalue AS base FROM scored)
"""


def _mm(x: str) -> str:
    w = "OVER (PARTITION BY doc_id)"
    return f"CASE WHEN count({x}) {w} = 1 THEN 1.0::DOUBLE WHEN max({x}) {w} - min({x}) {w} < 1e-10 THEN 0.5::DOUBLE ELSE ({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w}) END"


def _unit_sql(x: str) -> str:
    w = "OVER (PARTITION BY doc_id)"
    return f"CASE WHEN max({x}) {w} = min({x}) {w} THEN 0.5::DOUBLE ELSE 0.01::DOUBLE + 0.99::DOUBLE * ({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w}) END"


_COMPONENTS = f"len(regexp_extract_all(term, '{P.COMPONENT}'))"
_RANKED = "row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term)"


# ---------------------------------------------------------------- shared frames


def scored_v4(docs: DataFrame) -> DataFrame:
    """(doc_id, term, freq, tfidf, cvalue, base) of the v4 profile."""
    # several branches read the candidates: written once, they are not extracted again for each
    cand = staged(C.candidates_v4(docs), "candidates")
    stats = S.tfidf_v4(S.text_statistics(cand, docs)).select("doc_id", "term", "tfidf")
    return S.base_v4(S.cvalue_v4(S.nesting(cand)).join(stats, ["doc_id", "term"])).select("doc_id", "term", "freq", "tfidf", "cvalue", "base")


def final_scores(docs: DataFrame) -> DataFrame:
    return S.complexity_bonus(scored_v4(docs)).withColumnRenamed("base", "score")


def kept_terms(docs: DataFrame) -> DataFrame:
    """Final scores without terms that a longer one outdoes."""
    return R.drop_substrings(staged(final_scores(docs), "scored"), 0.3)


def flagship(spark, sf_dir: str) -> DataFrame:
    """Ten best terms of every document, without terms that a longer one outdoes."""
    return R.top_n(kept_terms(docs_of(spark, sf_dir)), 10).select("doc_id", "rank", "term", r6("score"))


_FLAG = f"{_SCORED}, bonus AS (SELECT *, base * (1 + 0.3::DOUBLE * greatest(0, {_COMPONENTS} - 1)) AS score FROM based)"
_KEPT = f"{_FLAG}, kept AS (SELECT * FROM bonus a WHERE NOT EXISTS (SELECT 1 FROM bonus b WHERE a.doc_id = b.doc_id AND a.term <> b.term AND contains(b.term, a.term) AND a.score < 0.3::DOUBLE * b.score))"

QUERIES["top_terms"] = flagship
ORACLES["top_terms"] = f"WITH {_KEPT} SELECT * FROM (SELECT doc_id, {_RANKED} AS rank, term, round(score, 6) AS score FROM kept) WHERE rank <= 10"

# ---------------------------------------------------------------- segmentation


@query("sentence_split_a", f"SELECT doc_id, unnest({_WHOLE_A}) AS sentence FROM documents")
def sentence_split_a(spark, d):
    return docs_of(spark, d).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


@query("sentence_split_b", f"SELECT doc_id, trim(unnest({_SENTENCES_B}), E' \\t\\r\\x0b\\x0c') AS sentence FROM documents")
def sentence_split_b(spark, d):
    return docs_of(spark, d).select("doc_id", F.explode(T.sentences_all(F.col("text"), trim=True)).alias("sentence"))


@query("sentence_split_c", "SELECT doc_id, unnest(list_filter(string_split_regex(text, '[。！？、\\n]'), lambda x: regexp_matches(x, '\\S'))) AS sentence FROM documents")
def sentence_split_c(spark, d):
    return docs_of(spark, d).select("doc_id", F.explode(T.sentences_comma(F.col("text"))).alias("sentence"))


@query("index_sentences", "SELECT doc_id, unnest(list_transform(list_filter(string_split(text, '。'), lambda x: regexp_matches(x, '\\S')), lambda x: trim(x, E' \\t\\n\\r\\x0b\\x0c') || '。')) AS sentence FROM documents")
def index_sentences(spark, d):
    return docs_of(spark, d).select("doc_id", F.explode(T.index_sentences(F.col("text"))).alias("sentence"))


@query("text_lines", _LINES)
def text_lines(spark, d):
    return docs_of(spark, d).select("doc_id", F.explode(T.lines(F.col("text"))).alias("line"))


@query("script_words", f"SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{P.SCRIPT_RUN}')) AS word FROM documents) WHERE length(word) > 1")
def script_words(spark, d):
    return docs_of(spark, d).select("doc_id", F.explode(T.script_words(F.col("text"))).alias("word"))


@query("term_words", f"SELECT DISTINCT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT p_partkey, unnest(regexp_extract_all(p_name, '{P.SCRIPT_RUN}')) FROM part) WHERE length(word) > 1")
def term_words(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(T.term_words(F.col("p_name"))).alias("word"))


@query("char_tokens", "SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(string_split(replace(text, ' ', ''), '')) AS token FROM benchmark) WHERE regexp_matches(token, '\\S') GROUP BY ALL")
def char_tokens(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return I.postings(b).withColumnRenamed("doc_id", "item_id")


@query("preprocess", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def preprocess(spark, d):
    return docs_of(spark, d).select("doc_id", F.md5(T.single_blanks(F.col("text")).cast("binary")).alias("digest"))


# ---------------------------------------------------------------- candidates


@query("header_terms", f"SELECT 'v4' AS profile, doc_id, term FROM ({_HEADINGS_V4}) UNION ALL SELECT 'v3', doc_id, term FROM ({_HEADINGS_V3})")
def header_terms(spark, d):
    docs = docs_of(spark, d)
    named = lambda p, x: x.select(F.lit(p).alias("profile"), "doc_id", "term")
    return named("v4", C.heading_terms_v4(docs)).unionByName(named("v3", C.heading_terms_v3(docs)))


@query("candidates_v4", f"WITH {_V4} SELECT * FROM cand")
def candidates_v4(spark, d):
    return C.candidates_v4(docs_of(spark, d))


@query("candidates_semrerank", f"SELECT doc_id, term, count(*) AS freq FROM ({union_sql(P.SIMPLE_PATTERNS)}) WHERE length(term) BETWEEN 2 AND 10 GROUP BY ALL HAVING count(*) >= 2")
def candidates_semrerank(spark, d):
    return C.candidates_semrerank(docs_of(spark, d))


_TECH = "(" + " OR ".join([f"regexp_matches(term, '{P.TWO_SCRIPTS}')", "regexp_matches(term, '[A-Za-z0-9]')", *[f"ends_with(term, '{s}')" for s in P.TECHNICAL_SUFFIXES], "length(term) >= 4"]) + ")"
_V3 = f"""
found AS ({union_sql(P.SIMPLE_PATTERNS)}),
counted AS (SELECT doc_id, term, count(*) AS freq FROM found WHERE length(term) BETWEEN 2 AND 15 GROUP BY ALL),
heads AS ({_HEADINGS_V3}),
merged AS (SELECT coalesce(c.doc_id, h.doc_id) AS doc_id, coalesce(c.term, h.term) AS term, coalesce(c.freq, 1) + CASE WHEN h.term IS NULL THEN 0 ELSE 2 END AS freq, h.term IS NOT NULL AS heading FROM counted c FULL JOIN heads h ON c.doc_id = h.doc_id AND c.term = h.term),
cand AS (SELECT doc_id, term, CAST(freq AS BIGINT) AS freq FROM merged WHERE freq >= 2 OR (freq = 1 AND (heading OR {_TECH})))"""


@query("candidates_v3", f"WITH {_V3} SELECT * FROM cand")
def candidates_v3(spark, d):
    return C.candidates_v3(docs_of(spark, d))


@query(
    "predicates_flags",
    f"SELECT DISTINCT term, {_GARBAGE} AS garbage, term IN ({_NOUNS}) AS common, regexp_matches(term, '{P.MODEL_NUMBER}') AS model, {_TECH} AS technical FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9-]+')) AS term FROM documents UNION ALL SELECT p_name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT unnest(['ス', 'この装置', '当該船', 'タンク', '6DE-18', 'L28ADF', 'HX20', 'pump', '燃料', 'GHG排', 'アンモ', '検査装置']))",
)
def predicates_flags(spark, d):
    part = table(spark, d, "part")
    own = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("ス", "この装置", "当該船", "タンク", "6DE-18", "L28ADF", "HX20", "pump", "燃料", "GHG排", "アンモ", "検査装置")])).alias("term"))
    words = docs_of(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9-]+"), F.lit(0))).alias("term"))
    terms = words.union(part.select("p_name")).union(part.select("p_brand")).union(own).distinct()
    t = F.col("term")
    return terms.select("term", is_.is_garbage(t).alias("garbage"), is_.is_common_noun(t).alias("common"), is_.is_model_number(t).alias("model"), is_.is_likely_technical(t).alias("technical"))


# ---------------------------------------------------------------- joins and scores


_PARTS = "list_distinct(flatten(list_transform(range(1, length({0})), lambda n: list_transform(range(1, length({0}) - n + 2), lambda i: {0}[i:i + n - 1]))))"


@query("containing_pairs", f"WITH {_V4}, sub AS (SELECT doc_id, term AS longer, unnest({_PARTS.format('term')}) AS term FROM cand) SELECT doc_id, term, longer FROM sub JOIN cand USING (doc_id, term)")
def containing_pairs(spark, d):
    return J.containing_pairs(C.candidates_v4(docs_of(spark, d))).select("doc_id", "term", "longer")


@query("text_statistics", f"WITH {_V4}, {_stats_sql(_WHOLE_A)} SELECT * FROM stats")
def text_statistics(spark, d):
    docs = docs_of(spark, d)
    return S.text_statistics(C.candidates_v4(docs), docs)


@query("tfidf_v4", f"WITH {_V4}, {_stats_sql(_WHOLE_A)} SELECT doc_id, term, round({_TFIDF}, 6) AS tfidf FROM stats")
def tfidf_v4(spark, d):
    docs = docs_of(spark, d)
    return S.tfidf_v4(S.text_statistics(C.candidates_v4(docs), docs)).select("doc_id", "term", r6("tfidf"))


_CAND_SEM = f"cand AS (SELECT doc_id, term, count(*) AS freq FROM ({union_sql(P.SIMPLE_PATTERNS)}) WHERE length(term) BETWEEN 2 AND 10 GROUP BY ALL HAVING count(*) >= 2)"
_TFIDF_SEM = "freq::DOUBLE / n_chars * (ln((n_sentences + 1)::DOUBLE / (df + 1)) + 1)"


@query("tfidf_semrerank", f"WITH {_CAND_SEM}, {_stats_sql(_SENTENCES_B)} SELECT doc_id, term, round({_TFIDF_SEM}, 6) AS tfidf FROM stats")
def tfidf_semrerank(spark, d):
    docs = docs_of(spark, d)
    return S.tfidf_semrerank(S.text_statistics(C.candidates_semrerank(docs), docs, T.sentences_all)).select("doc_id", "term", r6("tfidf"))


@query("cvalue_v4", f"WITH {_V4}, {_NEST} SELECT doc_id, term, n_longer, f_longer, round({_CV4}, 6) AS cvalue FROM nest")
def cvalue_v4(spark, d):
    return S.cvalue_v4(S.nesting(C.candidates_v4(docs_of(spark, d)))).select("doc_id", "term", F.col("n_longer").cast("long"), F.col("f_longer").cast("long"), r6("cvalue"))


@query("cvalue_canonical", f"WITH {_V4}, {_NEST} SELECT doc_id, term, round({_CV}, 6) AS cvalue FROM nest")
def cvalue_canonical(spark, d):
    return S.cvalue(S.nesting(C.candidates_v4(docs_of(spark, d)))).select("doc_id", "term", r6("cvalue"))


@query(
    "base_scores",
    f"WITH {_SCORED} SELECT doc_id, term, round(base, 6) AS v4, round(0.4::DOUBLE * {_unit_sql('tfidf')} + 0.6::DOUBLE * {_unit_sql('cvalue')}, 6) AS v3, round(0.3::DOUBLE * {_mm('tfidf')} + 0.7::DOUBLE * {_mm('cvalue')}, 6) AS seed, round(0.7::DOUBLE * {_mm('tfidf')} + 0.3::DOUBLE * {_mm('cvalue')}, 6) AS final FROM based",
)
def base_scores(spark, d):
    x = scored_v4(docs_of(spark, d)).withColumnRenamed("base", "v4")
    x = S.base_v3(x).withColumnRenamed("base", "v3")
    x = S.base_semrerank(x, "seed").withColumnRenamed("base", "seed")
    x = S.base_semrerank(x, "final").withColumnRenamed("base", "final")
    return x.select("doc_id", "term", r6("v4"), r6("v3"), r6("seed"), r6("final"))


@query("normalised_scores", f"WITH {_SCORED} SELECT doc_id, term, round({_mm('base')}, 6) AS min_max, round({_unit_sql('base')}, 6) AS to_unit FROM based")
def normalised_scores(spark, d):
    x = scored_v4(docs_of(spark, d))
    return x.withColumn("a", S.min_max(F.col("base"))).withColumn("b", S.to_unit(F.col("base"))).select("doc_id", "term", r6("a", "min_max"), r6("b", "to_unit"))


@query("header_bonus", f"WITH {_SCORED} SELECT b.doc_id, b.term, round(base * CASE WHEN h.term IS NULL THEN 1 ELSE 2 END, 6) AS base FROM based b LEFT JOIN heads h ON b.doc_id = h.doc_id AND b.term = h.term")
def header_bonus(spark, d):
    docs = docs_of(spark, d)
    return S.heading_bonus(scored_v4(docs), C.heading_terms_v4(docs)).select("doc_id", "term", r6("base"))


@query("complexity_bonus", f"WITH {_FLAG} SELECT doc_id, term, {_COMPONENTS} AS components, round(score, 6) AS score FROM bonus")
def complexity_bonus(spark, d):
    return final_scores(docs_of(spark, d)).select("doc_id", "term", S.components(F.col("term")).cast("long").alias("components"), r6("score"))


@query("substring_dedup", f"WITH {_KEPT} SELECT doc_id, term, round(score, 6) AS score FROM kept")
def substring_dedup(spark, d):
    return kept_terms(docs_of(spark, d)).select("doc_id", "term", r6("score"))


@query("prefiltered_terms", f"""WITH {_FLAG}, ok AS (SELECT * FROM bonus WHERE term NOT IN ({', '.join(f"'{s}'" for s in P.STOPWORDS)}) AND length(term) <> 1 AND NOT regexp_matches(term, '^[0-9]+$') AND NOT regexp_matches(term, '^(19|20)[0-9][0-9]$'))
SELECT doc_id, term, c AS contained, round(score * CASE WHEN c THEN 0.3::DOUBLE ELSE 1 END, 6) AS score FROM (SELECT *, length(term) <= 3 AND EXISTS (SELECT 1 FROM ok b WHERE a.doc_id = b.doc_id AND a.term <> b.term AND contains(b.term, a.term)) AS c FROM ok a)""")
def prefiltered_terms(spark, d):
    return C.prefiltered(staged(final_scores(docs_of(spark, d)), "scored")).select("doc_id", "term", "contained", r6("score"))


@query("cooccurrence", f"""WITH {_V4}, {_stats_sql(_WHOLE_A).split('stats AS')[0].rstrip().rstrip(',')},
one AS (SELECT doc_id, unnest(range(len(s))) AS k, unnest(s) AS x FROM sent),
hit AS (SELECT DISTINCT t.doc_id, k, term FROM cand t JOIN one o ON t.doc_id = o.doc_id AND contains(x, term)),
pair AS (SELECT a.doc_id, a.term AS a, b.term AS b, count(*) AS n FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.k = b.k AND a.term < b.term GROUP BY ALL)
SELECT doc_id, a, count(*) AS others, CAST(sum(n) AS BIGINT) AS together, max(n) AS most, max_by(b, row(n, b)) AS best FROM pair GROUP BY doc_id, a""")
def cooccurrence(spark, d):
    """All pairs of all candidates, told by their smaller term."""
    docs = docs_of(spark, d)
    pairs = J.cooccurrence(staged(C.candidates_v4(docs), "candidates"), docs)
    return pairs.groupBy("doc_id", "a").agg(F.count("*").alias("others"), F.sum("n").alias("together"), F.max("n").alias("most"), F.max_by("b", F.struct("n", "b")).alias("best"))


@query("longest_parent", f"WITH {_V4} SELECT doc_id, child, parent FROM (SELECT b.doc_id, b.term AS child, a.term AS parent, row_number() OVER (PARTITION BY b.doc_id, b.term ORDER BY length(a.term) DESC, a.term) AS r FROM cand a JOIN cand b ON a.doc_id = b.doc_id AND a.term <> b.term AND contains(b.term, a.term)) WHERE r = 1")
def longest_parent(spark, d):
    return J.longest_parent(C.candidates_v4(docs_of(spark, d)))


@query("semrerank_revise", f"""WITH {_SCORED}, imp AS (SELECT doc_id, term AS word, freq::DOUBLE AS importance FROM based),
nrm AS (SELECT doc_id, word, importance / max(importance) OVER (PARTITION BY doc_id) AS imp FROM imp),
w AS (SELECT DISTINCT doc_id, term, unnest(regexp_extract_all(term, '{P.SCRIPT_RUN}')) AS word FROM based UNION SELECT doc_id, term, term FROM based),
m AS (SELECT w.doc_id, w.term, avg(coalesce(imp, 0)) AS mean FROM w LEFT JOIN nrm USING (doc_id, word) WHERE length(word) > 1 GROUP BY ALL)
SELECT b.doc_id, b.term, round((1 + coalesce(mean, 0)) * base / max(base) OVER (PARTITION BY b.doc_id), 6) AS score FROM based b LEFT JOIN m ON b.doc_id = m.doc_id AND b.term = m.term""")
def semrerank_revise(spark, d):
    x = scored_v4(docs_of(spark, d))
    importance = x.select("doc_id", F.col("term").alias("word"), F.col("freq").cast("double").alias("importance"))
    return S.revise_by_words(x, importance).select("doc_id", "term", r6("score"))


# ---------------------------------------------------------------- ranking


@query("seed_terms", f"WITH {_SCORED} SELECT * FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY base DESC, term) AS rank FROM based) WHERE rank <= 5")
def seed_terms(spark, d):
    return R.seeds_v4(scored_v4(docs_of(spark, d))).select("doc_id", "term", "rank")


def _elbow_sql(form: str) -> str:
    return f"""r AS (SELECT doc_id, score, {_RANKED} AS rank FROM bonus),
d1 AS (SELECT *, lag(score) OVER (PARTITION BY doc_id ORDER BY rank) - score AS d FROM r),
d2 AS (SELECT *, {form}(d - lag(d) OVER (PARTITION BY doc_id ORDER BY rank)) AS e FROM d1),
bend AS (SELECT doc_id, count(*) AS n, CASE WHEN count(*) < 3 THEN count(*) ELSE arg_max(rank, row(e, -rank)) FILTER (e IS NOT NULL) - 1 END AS elbow FROM d2 GROUP BY doc_id)"""


@query("elbow_absolute", f"WITH {_FLAG}, {_elbow_sql('abs')} SELECT doc_id, n, CAST(elbow AS BIGINT) AS elbow FROM bend")
def elbow_absolute(spark, d):
    return R.elbow_absolute(final_scores(docs_of(spark, d)))


@query("validation_count", f"""WITH {_FLAG}, {_elbow_sql('')},
part AS (SELECT doc_id, rank, sum(score) OVER (PARTITION BY doc_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(score) OVER (PARTITION BY doc_id) AS p FROM r),
f AS (SELECT doc_id, min(rank) FILTER (p >= 0.85::DOUBLE) AS first FROM part GROUP BY doc_id),
j AS (SELECT doc_id, n, greatest(10, least(elbow, 100)) AS by_elbow, greatest(10, least(coalesce(first, n), 100)) AS by_share FROM bend JOIN f USING (doc_id))
SELECT doc_id, n, CAST(by_elbow AS BIGINT) AS by_elbow, CAST(by_share AS BIGINT) AS by_share, CAST(CASE WHEN n < 3 THEN n ELSE least((by_elbow + by_share) // 2, n) END AS BIGINT) AS count FROM j""")
def validation_count(spark, d):
    out = R.validation_count(final_scores(docs_of(spark, d)))
    return out.select("doc_id", "n", F.col("by_elbow").cast("long"), F.col("by_share").cast("long"), "count")


@query("percentile_filter", f"WITH {_FLAG} SELECT doc_id, term, round(score, 6) AS score FROM (SELECT *, quantile_cont(score, 0.2) OVER (PARTITION BY doc_id) AS q FROM bonus) WHERE score >= q")
def percentile_filter(spark, d):
    return R.above_percentile(final_scores(docs_of(spark, d)), 20).select("doc_id", "term", r6("score"))


@query("definition_budget", f"WITH {_V4} SELECT doc_id, count(*) AS n, CAST(greatest(15, least(floor(count(*) * 0.25::DOUBLE), 50)) AS BIGINT) AS budget FROM cand GROUP BY doc_id")
def definition_budget(spark, d):
    return C.candidates_v4(docs_of(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("budget", S.definition_budget(F.col("n")))


@query("display_table", f"WITH {_KEPT} SELECT doc_id, rank, term, printf('%.3f', score) AS score FROM (SELECT doc_id, {_RANKED} AS rank, term, score FROM kept) WHERE rank <= 50")
def display_table(spark, d):
    return R.numbered(kept_terms(docs_of(spark, d)))


_CTX = """, p1 AS (SELECT doc_id, term, text, strpos(text, term) AS a FROM cand JOIN documents USING (doc_id)),
p2 AS (SELECT *, CASE WHEN a > 0 AND strpos(text[a + length(term):], term) > 0 THEN strpos(text[a + length(term):], term) + a + length(term) - 1 ELSE 0 END AS b FROM p1),
p3 AS (SELECT *, CASE WHEN b > 0 AND strpos(text[b + length(term):], term) > 0 THEN strpos(text[b + length(term):], term) + b + length(term) - 1 ELSE 0 END AS c FROM p2)
SELECT doc_id, term, list_transform(list_filter([a, b, c], lambda p: p > 0), lambda p: text[greatest(0, p - 51) + 1 : least(length(text), p - 1 + length(term) + 50)]) AS contexts FROM p3"""


@query("contexts", f"WITH {_V4} {_CTX}")
def contexts(spark, d):
    docs = docs_of(spark, d)
    return I.term_contexts(C.candidates_v4(docs), docs)


@query("jaccard_bigrams", """WITH g AS (SELECT p_partkey, p_name, list_distinct(list_transform(range(1, length(p_name)), lambda i: p_name[i:i+1])) AS s FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM g a JOIN g b ON b.p_partkey = a.p_partkey + 1""")
def jaccard_bigrams(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"))
    return p.join(q, F.col("p_partkey") == F.col("k")).select(F.col("p_partkey").alias("a"), "b", F.round(T.jaccard(F.col("p_name"), F.col("other")), 6).alias("jaccard"))


@query("mmr_terms")
def mmr_terms(spark, d):
    return R.mmr(final_scores(docs_of(spark, d)).select("doc_id", "term", "score"), 10)


# ---------------------------------------------------------------- vectors and graphs


def vectors_of(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_PAIRS = f"pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.3)"
_BOTH = f"{_PAIRS}, both_ways AS (SELECT a AS src, b AS dst, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs)"


@query("cosine_pairs", f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def cosine_pairs(spark, d):
    return V.pairs_above(vectors_of(spark, d), 0.3).select("a", "b", r6("similarity"))


@query("top_pairs", f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs ORDER BY pairs.similarity DESC, a, b LIMIT 100")
def top_pairs(spark, d):
    return V.top_pairs(vectors_of(spark, d), 0.3).select("a", "b", r6("similarity"))


@query("knn_graph", f"WITH {_BOTH} SELECT src, dst, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM both_ways) WHERE rank <= 12")
def knn_graph(spark, d):
    return V.nearest(vectors_of(spark, d)).select("src", "dst", r6("similarity"), "rank")


_GRAPH = f"{_BOTH}, cut AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS r, count(*) OVER (PARTITION BY src) AS m FROM both_ways), g AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, similarity AS weight FROM cut WHERE r <= greatest(1, floor(m * 0.15::DOUBLE)))"


@query("relatedness_graph", f"WITH {_GRAPH} SELECT a, b, round(weight, 6) AS weight FROM g")
def relatedness_graph(spark, d):
    return V.relatedness_graph(V.both_ways(V.pairs_above(vectors_of(spark, d), 0.3))).select("a", "b", r6("weight"))


@query("relatedness_topk", f"WITH {_BOTH}, n AS (SELECT greatest(1, floor(count(*) * 0.15::DOUBLE)) AS k FROM embeddings), c AS (SELECT src, dst, similarity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS r FROM both_ways) JOIN n ON r <= k) SELECT DISTINCT src, dst, round(similarity, 6) AS similarity FROM (SELECT * FROM c UNION ALL SELECT dst, src, similarity FROM c)")
def relatedness_topk(spark, d):
    return V.related(vectors_of(spark, d), 0.3).select("src", "dst", r6("similarity"))


@query("edge_reweight", f"WITH {_GRAPH}, c AS (SELECT a, b, weight, (a + b) % 5 AS n FROM g) SELECT a, b, round(weight * (1 + 0.3::DOUBLE * ln(1 + n)), 6) AS weight, round(weight * (1 + 0.45::DOUBLE * ln(1 + n)), 6) AS boosted FROM c")
def edge_reweight(spark, d):
    g = V.relatedness_graph(V.both_ways(V.pairs_above(vectors_of(spark, d), 0.3))).withColumn("doc_id", F.lit(0))
    n = g.select("doc_id", "a", "b", F.pmod(F.col("a") + F.col("b"), F.lit(5)).alias("n"))
    plain, boosted = G.reweight(g, n), G.reweight(g, n, boost=1.5).withColumnRenamed("weight", "boosted")
    return plain.join(boosted, ["doc_id", "a", "b"]).select("a", "b", r6("weight"), r6("boosted"))


_PPR_ROUNDS = 20


@query("ppr_fixed20", f"""WITH RECURSIVE {_GRAPH},
e AS (SELECT a AS src, b AS dst, weight FROM g UNION ALL SELECT b, a, weight FROM g),
s AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e),
node AS (SELECT vec_id AS v, CASE WHEN vec_id < 5 THEN 0.2::DOUBLE ELSE 0 END AS p, vec_id NOT IN (SELECT src FROM s) AS loose FROM embeddings),
it AS (SELECT 0 AS i, v, p, loose, 1.0::DOUBLE / (SELECT count(*) FROM node) AS rank FROM node
UNION ALL SELECT i + 1, v, p, loose, 0.85::DOUBLE * (coalesce(came, 0) + total * p) + 0.15::DOUBLE * p FROM (
  SELECT it.i, it.v, it.p, it.loose, (SELECT sum(j.rank) FILTER (j.loose) FROM it j) AS total, c.came
  FROM it LEFT JOIN (SELECT s.dst, sum(k.rank * s.share) AS came FROM it k JOIN s ON k.v = s.src GROUP BY s.dst) c ON it.v = c.dst WHERE it.i < {_PPR_ROUNDS}))
SELECT v AS node, round(rank, 6) AS rank FROM it WHERE i = {_PPR_ROUNDS}""")
def ppr_fixed20(spark, d):
    v = vectors_of(spark, d)
    g = V.relatedness_graph(V.both_ways(V.pairs_above(v, 0.3))).withColumn("doc_id", F.lit(0))
    nodes = v.select(F.lit(0).alias("doc_id"), F.col("id").alias("node"), (F.col("id") < 5).cast("double").alias("personal"))
    return G.pagerank(nodes, g, rounds=_PPR_ROUNDS, tolerance=None).select("node", r6("rank"))


@query("ppr_distributed20", ORACLES["ppr_fixed20"])
def ppr_distributed20(spark, d):
    v = vectors_of(spark, d)
    g = V.relatedness_graph(V.both_ways(V.pairs_above(v, 0.3)))
    return G.pagerank_distributed(v.select(F.col("id").alias("node"), (F.col("id") < 5).cast("double").alias("personal")), g, _PPR_ROUNDS).select("node", r6("rank"))


@query("synonym_groups", f"""WITH RECURSIVE {_PAIRS.replace('0.3)', '0.35)')}, e AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x), c AS (SELECT x AS node, min(y) AS representative FROM reach GROUP BY x)
SELECT representative, list_sort(list(node)) AS members FROM c GROUP BY representative""")
def synonym_groups(spark, d):
    return G.synonym_groups(V.pairs_above(vectors_of(spark, d), 0.35))


# ---------------------------------------------------------------- retrieval


def _bench(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_WORDS = lambda text: F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
_BM = """post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM documents) GROUP BY ALL),
len AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS BIGINT) AS length FROM documents),
st AS (SELECT count(*) AS n, avg(length) AS avgdl FROM len),
idf AS (SELECT token, count(*) AS df, ln(((SELECT n FROM st) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM post GROUP BY token),
ask AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM benchmark),
sc AS (SELECT query_id, doc_id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / (SELECT avgdl FROM st)))) AS score FROM ask JOIN idf USING (token) JOIN post USING (token) JOIN len USING (doc_id) GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 10)"""


@query("bm25_stats", f"WITH {_BM} SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark, d):
    return I.Bm25Index(docs_of(spark, d), _WORDS).statistics.select("token", "df", r6("idf"))


@query("bm25_topk", f"WITH {_BM} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm")
def bm25_topk(spark, d):
    return I.Bm25Index(docs_of(spark, d), _WORDS).search(_bench(spark, d)).select("query_id", "doc_id", "rank", r6("score"))


@query("rrf_fusion", "WITH l AS (SELECT label AS query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings UNION ALL SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) FROM embeddings), f AS (SELECT query_id, doc_id, sum(1 / (60.0::DOUBLE + rank)) AS s FROM l GROUP BY ALL) SELECT query_id, doc_id, round(s, 6) AS rrf_score FROM f")
def rrf_fusion(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"))
    up = v.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    down = v.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("doc_id"))))
    return I.reciprocal_ranks(up.unionByName(down)).select("query_id", "doc_id", r6("rrf_score"))


_INDEXED = "list_transform(list_filter(string_split(text, '。'), lambda x: regexp_matches(x, '\\S')), lambda x: trim(x, E' \\t\\n\\r\\x0b\\x0c') || '。')"


@query("local_context", f"""WITH {_V4}, s AS (SELECT doc_id, unnest(range(len(x)))::INT AS sent_no, unnest(x) AS text FROM (SELECT doc_id, {_INDEXED} AS x FROM documents))
SELECT doc_id, term, sent_no, md5(text) AS digest, rank FROM (SELECT doc_id, term, sent_no, text, row_number() OVER (PARTITION BY doc_id, term ORDER BY sent_no) AS rank FROM cand JOIN s USING (doc_id) WHERE contains(text, term)) WHERE rank <= 5""")
def local_context(spark, d):
    docs = docs_of(spark, d)
    out = I.local_contexts(C.candidates_v4(docs), docs)
    return out.select("doc_id", "term", "sent_no", F.md5(F.col("text").cast("binary")).alias("digest"), "rank")


_VEC = f"vs AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 50 = 0) WHERE rank <= 10)"


def _vector_hits(spark, d):
    v = vectors_of(spark, d)
    return V.search(v.filter("id % 50 = 0"), v, 10)


@query("vector_search", f"WITH {_VEC} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM vs")
def vector_search(spark, d):
    return _vector_hits(spark, d).select("query_id", "doc_id", r6("score"), "rank")


@query("dynamic_threshold_contexts", f"""WITH {_VEC}, t AS (SELECT vs.*, coalesce(text, '') AS text FROM vs LEFT JOIN documents USING (doc_id)),
b AS (SELECT *, 0.7::DOUBLE * avg(score) FILTER (rank <= 3) OVER (PARTITION BY query_id) AS bar FROM t WHERE rank <= 6),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, text[1:200] ORDER BY rank) AS a FROM b WHERE score >= bar),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pick FROM u WHERE a = 1)
SELECT query_id, doc_id, round(score, 6) AS score, md5(text[1:500]) AS digest, pick FROM p WHERE pick <= 3""")
def dynamic_threshold_contexts(spark, d):
    hits = _vector_hits(spark, d).join(docs_of(spark, d), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return I.similar_contexts(hits).select("query_id", "doc_id", r6("score"), F.md5(F.col("text").cast("binary")).alias("digest"), "pick")


_HY = f"""WITH {_VEC}, {_BM.replace("ask AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM benchmark)", "ask AS (SELECT doc_id AS query_id, token FROM post WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings))")},
l AS (SELECT query_id, 'vector' AS source, doc_id, rank FROM vs UNION ALL SELECT query_id, 'bm25', doc_id, rank FROM bm),
f AS (SELECT query_id, doc_id, sum(1 / (60.0::DOUBLE + rank)) AS s FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS rank FROM f),
w AS (SELECT query_id, doc_id, CASE WHEN bool_or(source = 'vector') THEN 'vector' ELSE 'bm25' END AS source FROM l GROUP BY ALL)"""


def _hybrid_lists(spark, d):
    """The BM25 and the vector list of every 50th document."""
    docs = docs_of(spark, d)
    asked = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").filter("doc_id % 50 = 0")
    return I.Bm25Index(docs, _WORDS).search(asked.select(F.col("doc_id").alias("query_id"), "text")), _vector_hits(spark, d)


def _hybrid_hits(spark, d):
    text = lambda x, source: x.withColumn("source", F.lit(source)).withColumn("text", F.col("doc_id").cast("string"))
    words, vectors = _hybrid_lists(spark, d)
    return text(words, "bm25").unionByName(text(vectors, "vector"))


@query("hybrid_index", f"{_HY} SELECT query_id, doc_id, round(s, 6) AS rrf_score, rank FROM r WHERE rank <= 10")
def hybrid_index(spark, d):
    return I.hybrid_search(*_hybrid_lists(spark, d)).select("query_id", "doc_id", r6("rrf_score"), "rank")


@query("hybrid_fusion", f"{_HY} SELECT r.query_id, r.doc_id, w.source, round(s, 6) AS rrf_score FROM r JOIN w ON r.query_id = w.query_id AND r.doc_id = w.doc_id WHERE rank <= 10")
def hybrid_fusion(spark, d):
    return I.fuse(_hybrid_hits(spark, d)).select("query_id", "doc_id", "source", r6("rrf_score"))


@query("hybrid_context", f"{_HY} SELECT r.query_id, string_agg('[' || source || '] ' || r.doc_id, chr(10) ORDER BY rank) AS context FROM r JOIN w ON r.query_id = w.query_id AND r.doc_id = w.doc_id WHERE rank <= 5 GROUP BY r.query_id")
def hybrid_context(spark, d):
    return I.context_text(I.fuse(_hybrid_hits(spark, d)))


# ---------------------------------------------------------------- clusters, dictionary, evaluation


def _part_clusters(spark, d):
    return table(spark, d, "part").select(F.col("p_size").alias("cluster_id"), F.col("p_name").alias("term")).distinct()


@query("cluster_representative", "WITH c AS (SELECT DISTINCT p_size AS cluster_id, p_name AS term FROM part) SELECT cluster_id, arg_min(term, row(length(term), term)) AS representative, count(*) AS size FROM c GROUP BY cluster_id")
def cluster_representative(spark, d):
    return K.representatives(_part_clusters(spark, d))


@query("cluster_flatten", "WITH RECURSIVE c AS (SELECT vec_id AS cluster_id, CASE WHEN vec_id = 0 THEN NULL ELSE vec_id // 3 END AS parent_id FROM embeddings), t AS (SELECT cluster_id AS root_id, cluster_id, 0 AS level FROM c WHERE parent_id IS NULL UNION ALL SELECT t.root_id, c.cluster_id, t.level + 1 FROM t JOIN c ON c.parent_id = t.cluster_id) SELECT * FROM t")
def cluster_flatten(spark, d):
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("cluster_id"))
    return K.flattened(ids.withColumn("parent_id", F.when(F.col("cluster_id") != 0, F.floor(F.col("cluster_id") / 3))))


_TC = "tc AS (SELECT DISTINCT doc_id % 20 AS cluster_id, term FROM cand)"


def _term_clusters(spark, d):
    return C.candidates_v4(docs_of(spark, d)).select(F.pmod("doc_id", F.lit(20)).alias("cluster_id"), "term").distinct()


@query("subsumption_pairs", f"WITH {_V4}, {_TC}, pairs AS (SELECT a.cluster_id AS parent_cluster, b.cluster_id AS child_cluster, a.term AS parent_term, b.term AS child_term, length(b.term) - length(a.term) AS gap FROM (SELECT cluster_id, term, unnest({_PARTS.format('term')}) AS part FROM tc) b JOIN tc a ON a.term = b.part AND a.cluster_id <> b.cluster_id) SELECT parent_cluster, parent_term, count(*) AS pairs, count(DISTINCT child_cluster) AS clusters, count(DISTINCT child_term) AS terms, CAST(sum(gap) AS BIGINT) AS gaps FROM pairs GROUP BY ALL")
def subsumption_pairs(spark, d):
    """All pairs of all clusters, told by the parent's term."""
    pairs = K.subsumption_pairs(_term_clusters(spark, d))
    return pairs.groupBy("parent_cluster", "parent_term").agg(F.count("*").alias("pairs"), F.count_distinct("child_cluster").alias("clusters"), F.count_distinct("child_term").alias("terms"), F.sum("gap").cast("long").alias("gaps"))


@query("sibling_line", f"WITH {_V4}, {_TC}, o AS (SELECT a.cluster_id, a.term, list_sort(list(b.term) FILTER (b.term <> a.term)) AS r FROM tc a JOIN tc b USING (cluster_id) GROUP BY ALL) SELECT cluster_id, term, coalesce(array_to_string(r[1:5], ', '), '') || CASE WHEN coalesce(len(r), 0) > 5 THEN ' 他' || (len(r) - 5) || '件' ELSE '' END AS siblings FROM o")
def sibling_line(spark, d):
    return K.sibling_line(_term_clusters(spark, d))


@query("keep_top_in_cluster", """WITH r AS (SELECT p_brand AS cluster_id, p_partkey AS id, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name || p_partkey) AS r, p_name || p_partkey AS term FROM part),
s AS (SELECT *, max(score) FILTER (r = 1) OVER (PARTITION BY cluster_id) AS f, max(score) FILTER (r = 2) OVER (PARTITION BY cluster_id) AS g FROM r)
SELECT cluster_id, term, CASE WHEN NOT (g IS NULL OR f > 1.001::DOUBLE * g) THEN 'ask' WHEN r = 1 THEN 'keep' ELSE 'drop' END AS decision FROM s""")
def keep_top_in_cluster(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("cluster_id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("term"), F.col("p_retailprice").alias("score"))
    return R.keep_top_in_cluster(p, 1.001).select("cluster_id", "term", "decision")


@query("hdbscan_labels")
def hdbscan_labels(spark, d):
    """Density clusters of the vectors of each label."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.format_string("v%06d", "vec_id").alias("term"), "embedding")
    return K.cluster_labels(v)


def _by_half(spark, d):
    terms = C.candidates_v4(docs_of(spark, d)).select("term", "freq", F.col("doc_id").alias("ord"))
    first = terms.groupBy("term").agg(F.min("ord").alias("ord"), F.sum("freq").alias("frequency"))
    return first.filter("ord % 2 = 0"), first.filter("ord % 3 <> 1")


_HALF = f"{_V4}, f AS (SELECT term, min(doc_id) AS ord, CAST(sum(freq) AS BIGINT) AS frequency FROM cand GROUP BY term), known AS (SELECT * FROM f WHERE ord % 2 = 0), change AS (SELECT * FROM f WHERE ord % 3 <> 1)"


@query("dictionary_new_terms", f"WITH {_HALF} SELECT term, ord, frequency FROM change ANTI JOIN known USING (term)")
def dictionary_new_terms(spark, d):
    known, change = _by_half(spark, d)
    return D.new_terms(change, known).select("term", "ord", "frequency")


@query("dictionary_upsert", f"WITH {_HALF} SELECT term, frequency FROM known ANTI JOIN change USING (term) UNION ALL SELECT term, frequency + 1 FROM change")
def dictionary_upsert(spark, d):
    known, change = _by_half(spark, d)
    return D.upsert(known.select("term", "frequency"), change.withColumn("frequency", F.col("frequency") + 1))


_EVAL = """p AS (SELECT u.conv_id, u.turn, u.text AS original_definition, a.text AS context_free_definition FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
s AS (SELECT *, (conv_id * 7 + turn) % 10 / 10.0::DOUBLE AS similarity FROM p),
e AS (SELECT *, coalesce(original_definition, '') = '' OR coalesce(context_free_definition, '') = '' AS err FROM s),
j AS (SELECT conv_id, turn, CASE WHEN err THEN NULL ELSE similarity END AS similarity, CASE WHEN err THEN 'error' WHEN similarity < 0.7::DOUBLE THEN 'unknown' ELSE 'known' END AS status FROM e)"""


def _judged(spark, d):
    c = table(spark, d, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("original_definition"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context_free_definition"))
    similarity = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(10)) / 10.0
    return D.evaluate(u.join(a, ["conv_id", "turn"], "left").withColumn("similarity", similarity))


@query("unknown_term_eval", f"WITH {_EVAL} SELECT conv_id, turn, round(similarity, 6) AS similarity, status FROM j")
def unknown_term_eval(spark, d):
    return _judged(spark, d).select("conv_id", "turn", r6("similarity"), "status")


@query("eval_summary", f"WITH {_EVAL} SELECT count(*) AS total, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status = 'known') AS known, 0::BIGINT AS explicitly_unknown, count(*) FILTER (status = 'error') AS errors FROM j")
def eval_summary(spark, d):
    return D.evaluation_summary(_judged(spark, d))


@query("json_judgement_parse", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_judgement_parse(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    e = table(spark, d, "events").withColumn("j", F.from_json(T.without_fence(fenced), "k BIGINT"))
    return e.select("event_id", F.col("j.k").alias("k")).filter("k > 50")


@query("method_compare", f"""WITH {_V4}, {_CAND_SEM.replace('cand AS', 'sem AS')}, m AS (SELECT 'semrerank' AS method, doc_id || ':' || term AS term, freq::DOUBLE AS score FROM sem UNION ALL SELECT 'v4', doc_id || ':' || term, freq FROM cand),
r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, term) AS r FROM m)
SELECT method, count(*) AS n_terms, list(term ORDER BY r) FILTER (r <= 10) AS top_terms FROM r GROUP BY method""")
def method_compare(spark, d):
    docs = docs_of(spark, d)
    name = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("term")).alias("term")
    row = lambda m, x: x.select(F.lit(m).alias("method"), name, F.col("freq").cast("double").alias("score"))
    return D.compare_methods(row("semrerank", C.candidates_semrerank(docs)).unionByName(row("v4", C.candidates_v4(docs))))


@query("cosine_same_label", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id + 10 = b.vec_id")
def cosine_same_label(spark, d):
    v = vectors_of(spark, d)
    w = v.select((F.col("id") - 10).alias("k"), F.col("id").alias("b"), F.col("embedding").alias("f"))
    return v.join(w, F.col("id") == F.col("k")).select(F.col("id").alias("a"), "b", F.round(cosine(F.col("embedding"), F.col("f")), 6).alias("similarity"))


# ---------------------------------------------------------------- further operators


@query("fused_scores", f"WITH {_SCORED}, r AS (SELECT *, CASE WHEN freq % 3 = 0 THEN NULL ELSE freq::DOUBLE END AS rank FROM based), q AS (SELECT *, min(rank) OVER (PARTITION BY doc_id) AS lo, max(rank) OVER (PARTITION BY doc_id) AS hi FROM r) SELECT doc_id, term, round(0.4::DOUBLE * base + 0.6::DOUBLE * coalesce(CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE 0.1::DOUBLE + 0.8::DOUBLE * (rank - lo) / (hi - lo) END, 0.5::DOUBLE), 6) AS fused, round(base * coalesce(rank, 0.5::DOUBLE), 6) AS product FROM q")
def fused_scores(spark, d):
    x = scored_v4(docs_of(spark, d))
    ranks = x.filter("freq % 3 <> 0").select("doc_id", "term", F.col("freq").cast("double").alias("rank"))
    fused = S.fuse_rank(x, ranks).select("doc_id", "term", r6("score", "fused"))
    return fused.join(S.multiply_rank(x, ranks).select("doc_id", "term", r6("score", "product")), ["doc_id", "term"])


_TOKENS = "tok AS (SELECT doc_id, 0 AS sent_no, unnest(range(len(w))) AS pos, unnest(w) AS surface FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)), tagged AS (SELECT *, CASE WHEN length(surface) > 5 THEN '名詞' ELSE '助詞' END AS pos_tag FROM tok)"
_RUNS = f"{_TOKENS}, br AS (SELECT *, sum(CASE WHEN pos_tag = '名詞' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM tagged), runs AS (SELECT doc_id, run, list(surface ORDER BY pos) AS words, max(pos) AS last FROM br WHERE pos_tag = '名詞' GROUP BY ALL)"


def _tokens(spark, d):
    words = docs_of(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "surface"))
    return words.withColumn("sent_no", F.lit(0)).withColumn("pos_tag", F.when(F.length("surface") > 5, "名詞").otherwise("助詞"))


@query("noun_phrases", f"WITH {_RUNS} SELECT doc_id, term, count(*) AS freq FROM (SELECT doc_id, array_to_string(words, '') AS term FROM runs) WHERE length(term) BETWEEN 2 AND 15 GROUP BY ALL")
def noun_phrases(spark, d):
    return C.noun_phrases(_tokens(spark, d))


@query("noun_phrases_v3", f"""WITH {_RUNS}, e AS (SELECT doc_id, max(pos) AS fin FROM tok GROUP BY doc_id),
t AS (SELECT doc_id, array_to_string(words, '') AS term FROM runs UNION ALL SELECT doc_id, array_to_string(words[i:], '') FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM runs JOIN e USING (doc_id) WHERE len(words) > 2 AND last < fin))
SELECT doc_id, term, count(*) AS freq FROM t WHERE length(term) BETWEEN 2 AND 15 GROUP BY ALL""")
def noun_phrases_v3(spark, d):
    return C.noun_phrases_v3(_tokens(spark, d))


@query("noun_ngrams", f"WITH {_RUNS}, n AS (SELECT doc_id, words, unnest(range(2, least(4, len(words)) + 1)) AS k FROM runs WHERE len(words) >= 2), w AS (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM n) SELECT doc_id, term, count(*) AS freq FROM (SELECT doc_id, array_to_string(words[i:i + k - 1], '') AS term FROM w) WHERE length(term) BETWEEN 2 AND 30 GROUP BY ALL")
def noun_ngrams(spark, d):
    return C.noun_ngrams(_tokens(spark, d), high=30)


@query("seeds_semrerank", f"""WITH {_FLAG.replace('AS score FROM based', 'AS old, freq::DOUBLE AS score FROM based')}, top AS (SELECT * FROM (SELECT doc_id, term, score, {_RANKED} AS rank FROM bonus) WHERE rank <= 100),
d1 AS (SELECT *, lag(score) OVER (PARTITION BY doc_id ORDER BY rank) - score AS d FROM top), d2 AS (SELECT *, abs(d - lag(d) OVER (PARTITION BY doc_id ORDER BY rank)) AS e FROM d1),
bend AS (SELECT doc_id, count(*) AS n, CASE WHEN count(*) < 3 THEN count(*) ELSE arg_max(rank, row(e, -rank)) FILTER (e IS NOT NULL) - 1 END AS elbow FROM d2 GROUP BY doc_id),
cut AS (SELECT doc_id, CASE WHEN n > 3 THEN greatest(5, least(elbow, 70, n)) ELSE greatest(5, n // 2) END AS c FROM bend)
SELECT doc_id, term, rank FROM top JOIN cut USING (doc_id) WHERE rank <= c""")
def seeds_semrerank(spark, d):
    return R.seeds_semrerank(scored_v4(docs_of(spark, d)).withColumn("freq", F.col("freq").cast("double"))).select("doc_id", "term", "rank")


@query("position_scores", f"""WITH {_V4}, p AS (SELECT doc_id, term, length(text) AS n, string_split(text, term) AS x FROM cand JOIN documents USING (doc_id)),
q AS (SELECT doc_id, term, n, list_transform(range(1, len(x)), lambda i: CAST(list_sum(list_transform(x[1:i], lambda y: length(y))) + (i - 1) * length(term) AS BIGINT)) AS ps FROM p)
SELECT doc_id, term, len(ps) AS n_found, round(CASE WHEN len(ps) <= 1 THEN 0.5::DOUBLE ELSE 1 / (1 + list_aggregate(ps, 'stddev_pop') / (n::DOUBLE / (len(ps) + 1))) END, 6) AS distribution, round(1 - 0.5::DOUBLE * ps[1] / n, 6) AS position FROM q WHERE len(ps) > 0""")
def position_scores(spark, d):
    docs = docs_of(spark, d)
    return N.position_scores(C.candidates_v4(docs), docs).select("doc_id", "term", "n_found", r6("distribution"), r6("position"))


@query("nc_value", f"""WITH {_TOKENS}, {_SCORED}, nx AS (SELECT doc_id, surface, lag(surface) OVER w AS p, lead(surface) OVER w AS n FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
near AS (SELECT doc_id, surface, p AS near FROM nx WHERE p IS NOT NULL UNION SELECT doc_id, surface, n FROM nx WHERE n IS NOT NULL),
fr AS (SELECT doc_id, surface AS near, count(*) AS f FROM tok GROUP BY ALL), wt AS (SELECT doc_id, surface AS term, sum(f) AS f FROM near JOIN fr USING (doc_id, near) GROUP BY ALL)
SELECT b.doc_id, b.term, round(0.8::DOUBLE * cvalue + 0.2::DOUBLE * coalesce(f, 0), 6) AS ncvalue FROM based b LEFT JOIN wt ON b.doc_id = wt.doc_id AND b.term = wt.term""")
def nc_value(spark, d):
    return N.nc_value(scored_v4(docs_of(spark, d)), _tokens(spark, d)).select("doc_id", "term", r6("ncvalue"))


@query("text_chunks", "WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(1, length(text) - 200), 1800)) AS i FROM documents) SELECT doc_id, i // 1800 AS chunk, md5(text[i + 1:i + 2000]) AS digest FROM c")
def text_chunks(spark, d):
    return docs_of(spark, d).select("doc_id", F.posexplode(N.chunks(F.col("text"))).alias("chunk", "piece")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5(F.col("piece").cast("binary")).alias("digest"))


_CL = "cl AS (SELECT DISTINCT p_size::BIGINT AS cluster_id, CASE WHEN p_size > 5 THEN p_size::BIGINT % 5 + 1 END AS parent_id, CASE WHEN p_size > 5 THEN 1 ELSE 0 END AS level, 'c' || p_size AS category FROM part), ct AS (SELECT DISTINCT p_size::BIGINT AS cluster_id, p_name AS term FROM part)"


def _clusters(spark, d):
    terms = table(spark, d, "part").select(F.col("p_size").cast("long").alias("cluster_id"), F.col("p_name").alias("term")).distinct()
    below = F.col("cluster_id") > 5
    clusters = terms.select("cluster_id").distinct().select("cluster_id", F.when(below, F.pmod("cluster_id", F.lit(5)) + 1).alias("parent_id"), F.when(below, 1).otherwise(0).alias("level"), F.concat(F.lit("c"), F.col("cluster_id").cast("string")).alias("category"))
    return clusters, terms


@query("cluster_sizes", f"WITH {_CL}, n AS (SELECT c.cluster_id, c.parent_id, count(t.term) AS n FROM cl c LEFT JOIN ct t ON c.cluster_id = t.cluster_id GROUP BY ALL), u AS (SELECT cluster_id AS id, n FROM n UNION ALL SELECT parent_id, n FROM n WHERE parent_id IS NOT NULL) SELECT id AS cluster_id, CAST(sum(n) AS BIGINT) AS size FROM u GROUP BY id")
def cluster_sizes(spark, d):
    return K.sizes_with_children(*_clusters(spark, d))


@query("first_cluster", f"WITH {_CL} SELECT term, cluster_id, category FROM (SELECT t.term, c.cluster_id, c.category, row_number() OVER (PARTITION BY t.term ORDER BY level, c.cluster_id) AS r FROM ct t JOIN cl c USING (cluster_id)) WHERE r = 1")
def first_cluster(spark, d):
    clusters, terms = _clusters(spark, d)
    return K.first_cluster_of_terms(terms, clusters)


@query("cluster_parents", f"WITH {_CL}, r AS (SELECT cluster_id, arg_min(term, row(length(term), term)) AS representative FROM ct GROUP BY cluster_id), k AS (SELECT c.parent_id AS parent, r.* FROM cl c JOIN r USING (cluster_id) WHERE c.parent_id IS NOT NULL) SELECT parent, arg_min(representative, row(length(representative), representative)) AS representative, list_sort(list(DISTINCT cluster_id)) AS children, arg_min(representative, row(length(representative), representative)) || '系' AS name FROM k GROUP BY parent HAVING count(DISTINCT cluster_id) >= 2")
def cluster_parents(spark, d):
    clusters, terms = _clusters(spark, d)
    tree = clusters.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("parent"), F.col("cluster_id").alias("child"), F.col("cluster_id").alias("child_label"))
    return K.parents_from_tree(tree, K.representatives(terms).select("cluster_id", "representative"))


@query("interface_metrics", f"WITH {_CL}, t AS (SELECT p_partkey, p_retailprice AS score, p_name AS term, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS definition FROM part), b AS (SELECT avg(score) AS m FROM (SELECT score FROM t ORDER BY score DESC, term LIMIT 50)), c AS (SELECT count(DISTINCT cluster_id) AS clusters, count(*) AS clustered FROM ct) SELECT count(*) AS total, round(any_value(m), 6) AS mean_top50, any_value(clusters) AS clusters, any_value(clustered) AS clustered, count(*) FILTER (definition <> '') - any_value(clustered) AS noise FROM t, b, c")
def interface_metrics(spark, d):
    t = table(spark, d, "part").select(F.col("p_retailprice").alias("score"), F.col("p_name").alias("term"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_type")).alias("definition"))
    return D.interface_metrics(t, _clusters(spark, d)[1]).withColumn("mean_top50", F.round("mean_top50", 6))


@query("vector_context", f"WITH {_VEC} SELECT query_id, string_agg(doc_id::VARCHAR, chr(10) || chr(10) ORDER BY rank) AS context FROM vs WHERE rank <= 5 GROUP BY query_id")
def vector_context(spark, d):
    return I.joined_contexts(_vector_hits(spark, d).withColumn("text", F.col("doc_id").cast("string")))


@query("validated_terms", f"WITH {_V4}, a AS (SELECT p_name AS headword, p_type AS definition, p_partkey AS ord FROM part UNION ALL SELECT term, 'd' || doc_id, doc_id FROM cand), f AS (SELECT headword AS term, arg_min(definition, row(ord, definition)) AS definition FROM a GROUP BY headword) SELECT doc_id, c.term, f.definition FROM cand c JOIN f ON c.term = f.term")
def validated_terms(spark, d):
    cand = C.candidates_v4(docs_of(spark, d))
    part = table(spark, d, "part").select(F.col("p_name").alias("headword"), F.col("p_type").alias("definition"), F.col("p_partkey").cast("long").alias("ord"))
    own = cand.select(F.col("term").alias("headword"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("definition"), F.col("doc_id").alias("ord"))
    answers = part.unionByName(own).withColumn("synonyms", F.array().cast("array<string>")).withColumn("ord", F.struct("ord", "definition"))
    return D.validated(cand, answers).select("doc_id", "term", "definition")


_SENT_GRAPH = """s AS (SELECT item_id AS doc_id, unnest(range(len(x)))::INT AS sent_no, unnest(x) AS t FROM (SELECT item_id, list_filter(string_split_regex(text, '[。！？\\n]+'), lambda z: regexp_matches(z, '\\S')) AS x FROM benchmark)),
w AS (SELECT DISTINCT doc_id, sent_no, word FROM (SELECT doc_id, sent_no, unnest(regexp_extract_all(t, '[A-Za-z0-9]+')) AS word FROM s) WHERE length(word) > 3),
rel AS (SELECT a.doc_id, a.sent_no, a.word AS src, b.word AS dst, 1 / (1.0::DOUBLE + abs(length(a.word) - length(b.word))) AS similarity FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND a.word <> b.word),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no, src ORDER BY similarity DESC, dst) AS r, count(*) OVER (PARTITION BY doc_id, sent_no, src) AS m FROM rel)
SELECT DISTINCT doc_id, sent_no, least(src, dst) AS a, greatest(src, dst) AS b, round(similarity, 6) AS weight FROM c WHERE r <= greatest(1, floor(m * 0.15::DOUBLE))"""


@query("sentence_graphs", f"WITH {_SENT_GRAPH}")
def sentence_graphs(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(T.sentences_all(F.col("text"))).alias("sent_no", "t"))
    words = b.select("doc_id", "sent_no", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("[A-Za-z0-9]+"), F.lit(0)))).alias("word")).filter(F.length("word") > 3)
    src, dst = (words.select("doc_id", "sent_no", F.col("word").alias(c)) for c in ("src", "dst"))
    together = src.join(dst, ["doc_id", "sent_no"]).filter("src <> dst").select("src", "dst").distinct()
    related = together.withColumn("similarity", 1 / (1.0 + F.abs(F.length("src") - F.length("dst"))))
    return G.sentence_graphs(words, related).select("doc_id", "sent_no", "a", "b", r6("weight"))


# ---------------------------------------------------------------- Japanese texts

#: Texts with what the tables do not hold: kanji, katakana, headings, model numbers, full-width marks.
JAPANESE = (
    (1, "第1章 燃料噴射ポンプ\n燃料噴射ポンプは燃料をシリンダへ送る。燃料噴射ポンプの圧力は20MPaである。\n燃料ポンプと噴射弁を毎月検査する！弁は二個あるか？"),
    (2, "■ 排気ガス浄化装置\n排気ガス浄化装置は窒素酸化物を減らす。この装置は触媒を用いる。排気ガスの温度を測る、触媒の温度も測る。\n1.2 触媒の交換\n触媒の交換は一年ごとに行う。"),
    (3, "主機関は6DE-18型で、主機関の出力は1200kWである。主機関制御盤と主機関用ポンプを確認する。L28ADFも確認する。"),
    (4, "アンモニア燃料エンジンとアンモニア燃料タンクを試験した。エンジンの試験は良好。タンクとエンジンの検査装置も試験した。"),
    (5, ""),
    (6, "データ、データ、データ。情報と情報。技術の技術"),
)
_JA = "WITH documents AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}')" for i, t in JAPANESE) + ") v(doc_id, text))"


def japanese(spark) -> DataFrame:
    return spark.createDataFrame(list(JAPANESE), "doc_id long, text string")


@query("japanese_sentences", f"""{_JA}, s AS (SELECT doc_id, 'a' AS way, unnest({_WHOLE_A}) AS sentence FROM documents
UNION ALL SELECT doc_id, 'b', trim(unnest({_SENTENCES_B}), E' \\t\\r\\x0b\\x0c') FROM documents
UNION ALL SELECT doc_id, 'c', unnest(list_filter(string_split_regex(text, '[。！？、\\n]'), lambda x: regexp_matches(x, '\\S'))) FROM documents
UNION ALL SELECT doc_id, 'd', unnest({_INDEXED}) FROM documents) SELECT doc_id, way, sentence FROM s""")
def japanese_sentences(spark, d):
    ways = {"a": T.sentences(F.col("text")), "b": T.sentences_all(F.col("text"), trim=True), "c": T.sentences_comma(F.col("text")), "d": T.index_sentences(F.col("text"))}
    parts = [japanese(spark).select("doc_id", F.lit(w).alias("way"), F.explode(c).alias("sentence")) for w, c in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("japanese_words", f"{_JA} SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{P.SCRIPT_RUN}')) AS word FROM documents) WHERE length(word) > 1")
def japanese_words(spark, d):
    return japanese(spark).select("doc_id", F.explode(T.script_words(F.col("text"))).alias("word"))


@query("japanese_headings", f"{_JA} SELECT 'v4' AS profile, doc_id, term FROM ({_HEADINGS_V4}) UNION ALL SELECT 'v3', doc_id, term FROM ({_HEADINGS_V3})")
def japanese_headings(spark, d):
    named = lambda p, x: x.select(F.lit(p).alias("profile"), "doc_id", "term")
    return named("v4", C.heading_terms_v4(japanese(spark))).unionByName(named("v3", C.heading_terms_v3(japanese(spark))))


@query("japanese_candidates_v4", f"{_JA}, {_V4} SELECT * FROM cand")
def japanese_candidates_v4(spark, d):
    return C.candidates_v4(japanese(spark))


@query("japanese_candidates_v3", f"{_JA}, {_V3} SELECT * FROM cand")
def japanese_candidates_v3(spark, d):
    return C.candidates_v3(japanese(spark))


@query("japanese_candidates_semrerank", f"{_JA}, {_CAND_SEM} SELECT * FROM cand")
def japanese_candidates_semrerank(spark, d):
    return C.candidates_semrerank(japanese(spark))


@query("japanese_scores", f"{_JA}, {_KEPT.removeprefix('WITH ')} SELECT b.doc_id, b.term, b.freq, round(b.tfidf, 6) AS tfidf, round(b.cvalue, 6) AS cvalue, round(b.score, 6) AS score, k.term IS NOT NULL AS kept FROM bonus b LEFT JOIN kept k ON b.doc_id = k.doc_id AND b.term = k.term")
def japanese_scores(spark, d):
    scores = staged(final_scores(japanese(spark)), "scored")
    kept = R.drop_substrings(scores, 0.3).select("doc_id", "term", F.lit(True).alias("kept"))
    return scores.join(kept, ["doc_id", "term"], "left").select("doc_id", "term", "freq", r6("tfidf"), r6("cvalue"), r6("score"), F.coalesce("kept", F.lit(False)).alias("kept"))


# ---------------------------------------------------------------- whole profiles


@query("pipeline_v4")
def pipeline_v4(spark, d):
    return profiles.extract_v4(docs_of(spark, d)).select("doc_id", "rank", "term", r6("score"))


@query("pipeline_v3")
def pipeline_v3(spark, d):
    return profiles.extract_v3(docs_of(spark, d)).select("doc_id", "pick", "term", r6("score"))


@query("pipeline_semrerank")
def pipeline_semrerank(spark, d):
    return profiles.extract_semrerank(docs_of(spark, d)).select("doc_id", "rank", "term", r6("score"))


@query("definitions_stub", f"""WITH {_FLAG}, best AS (SELECT doc_id, term FROM (SELECT doc_id, term, {_RANKED} AS rank FROM bonus) WHERE rank <= 5),
s AS (SELECT doc_id, unnest(range(len(x)))::INT AS sent_no, unnest(x) AS text FROM (SELECT doc_id, {_INDEXED} AS x FROM documents)),
f AS (SELECT b.doc_id, b.term, arg_min(text, sent_no) AS text FROM best b JOIN s ON s.doc_id = b.doc_id AND contains(text, term) GROUP BY ALL)
SELECT doc_id, term, regexp_replace(regexp_replace(split_part(text, chr(10), 1)[1:200], '^\\s+', ''), '\\s+$', '') AS definition FROM f""")
def definitions_stub(spark, d):
    """Definitions by the extractive stub: the first line of the context."""
    docs = docs_of(spark, d)
    best = R.top_n(final_scores(docs), 5).select("doc_id", "term")
    context = I.local_contexts(best, docs, 1).select("doc_id", "term", F.col("text").alias("context"))
    return L.define(context, L.StubClient(extract_definition)).select("doc_id", "term", "definition")


def extract_definition(prompt: str) -> str:
    return prompt.split("Context:\n", 1)[-1].split("\n")[0][:200]
