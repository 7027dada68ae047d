"""Term candidates of each profile: (doc_id, term, freq)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import patterns as P
from termloom.functions import text as T
from termloom.functions.predicates import is_common_noun, is_garbage, is_likely_technical, is_model_number, is_number, is_stopword

MIN_LENGTH, MAX_LENGTH, MIN_FREQUENCY = 2, 15, 2


#: A character that every match of a pattern holds: texts without it skip the pattern.
NEEDED = {p: "[ァ-ヶー一-龯]" for p in (P.KATAKANA, P.KANJI, P.TWO_SCRIPTS, P.THREE_RUNS)} | {p: "[0-9]" for p in (P.MODEL_DIGIT_FIRST, P.MODEL_LETTER_FIRST)}
#: The same matches in Java's dialect without going back into a run: a match begins where a run does.
FASTER = {P.MODEL_DIGIT_FIRST: "(?<![0-9])[0-9]++" + P.MODEL_DIGIT_FIRST.removeprefix("[0-9]+"), P.MODEL_LETTER_FIRST: "(?<![A-Za-z])[A-Za-z]++" + P.MODEL_LETTER_FIRST.removeprefix("[A-Za-z]+")}


def all_matches(text: Column, patterns) -> Column:
    """Matches of each pattern, in no order that matters."""
    parts = []
    for needed in dict.fromkeys(NEEDED.get(p) for p in patterns):
        found = F.concat(*[F.regexp_extract_all(text, F.lit(FASTER.get(p, p)), F.lit(0)) for p in patterns if NEEDED.get(p) == needed])
        parts.append(found if needed is None else F.when(text.rlike(needed), found).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def surfaces(docs: DataFrame, patterns) -> DataFrame:
    return docs.select("doc_id", F.explode(all_matches(F.col("text"), patterns)).alias("term"))


def _heading(line: Column, headings, flags: str) -> Column:
    """The text of a heading line by the first pattern that matches it, else null."""
    tests = [(line.rlike(flags + p), F.regexp_extract(line, flags + p, 1)) for p in headings]
    return reduce(lambda c, t: c.when(*t), tests[1:], F.when(*tests[0]))


def _heading_terms(docs: DataFrame, headings, flags: str, patterns) -> DataFrame:
    line = docs.select("doc_id", F.explode(T.lines(F.col("text"))).alias("line"))
    head = line.select("doc_id", _heading(F.col("line"), headings, flags).alias("heading")).filter("heading IS NOT NULL")
    return head.select("doc_id", F.explode(all_matches(F.col("heading"), patterns)).alias("term")).distinct()


def heading_terms_v4(docs: DataFrame) -> DataFrame:
    """Distinct terms of heading lines, of any length."""
    return _heading_terms(docs, P.V4_HEADINGS, "(?iUd)", P.V4_HEADING_TERMS)


def heading_terms_v3(docs: DataFrame) -> DataFrame:
    return _heading_terms(docs, P.V3_HEADINGS, "(?Ud)", P.SIMPLE_PATTERNS).filter(F.length("term").between(2, 15))


def _with_headings(found: DataFrame, headings: DataFrame) -> DataFrame:
    """Counts of (doc_id, term, n) with the bonus of heading terms: two more, or three for one
    not counted yet. One aggregation over both, no join."""
    flag = lambda x, n, heading: x.select("doc_id", "term", n.cast("long").alias("n"), F.lit(heading).alias("heading"))
    both = flag(found, F.col("n"), False).unionByName(flag(headings, F.lit(None), True))
    out = both.groupBy("doc_id", "term").agg(F.sum("n").alias("n"), F.max("heading").alias("heading"))
    return out.select("doc_id", "term", (F.coalesce("n", F.lit(1)) + F.when(F.col("heading"), 2).otherwise(0)).alias("freq"), "heading")


def candidates_v4(docs: DataFrame, extra: DataFrame | None = None, low: int = MIN_LENGTH, high: int = MAX_LENGTH, min_frequency: int = MIN_FREQUENCY, headings: bool = True) -> DataFrame:
    """Candidates of the v4 profile, with or without the bonus of heading terms. ``extra``: further counts (doc_id, term, freq), such
    as those of ``noun_phrases`` and ``noun_ngrams``; counts of one term add up."""
    term = F.col("term")
    usable = F.length(term).between(low, high) & ~is_number(term) & ~is_garbage(term) & ~is_common_noun(term)
    found = surfaces(docs, P.V4_PATTERNS).filter(usable).withColumn("n", F.lit(1).cast("long"))
    if extra is not None:
        found = found.unionByName(extra.select("doc_id", "term", F.col("freq").cast("long").alias("n")))
    out = _with_headings(found, heading_terms_v4(docs) if headings else found.select("doc_id", "term").limit(0))
    keep = (F.col("freq") >= min_frequency) | is_model_number(term) | ((F.col("freq") == 1) & F.col("heading"))
    return out.filter(~is_garbage(term) & keep).select("doc_id", "term", F.col("freq").cast("long").alias("freq"))


def candidates_semrerank(docs: DataFrame, low: int = 2, high: int = 10, min_frequency: int = 2) -> DataFrame:
    found = surfaces(docs, P.SIMPLE_PATTERNS).filter(F.length("term").between(low, high))
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("freq")).filter(F.col("freq") >= min_frequency)


def candidates_v3(docs: DataFrame, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> DataFrame:
    found = surfaces(docs, P.SIMPLE_PATTERNS).filter(F.length("term").between(low, high))
    out = _with_headings(found.withColumn("n", F.lit(1)), heading_terms_v3(docs))
    keep = (F.col("freq") >= 2) | ((F.col("freq") == 1) & (F.col("heading") | is_likely_technical(F.col("term"))))
    return out.filter(keep).select("doc_id", "term", F.col("freq").cast("long").alias("freq"))


def _islands(tokens: DataFrame, inside: Column, *by: str) -> DataFrame:
    """Maximal runs of consecutive tokens that ``inside`` holds for: the tokens' surfaces in
    order, per document (and ``by``)."""
    order = Window.partitionBy("doc_id", *by).orderBy("pos")
    marked = tokens.withColumn("in", inside).withColumn("run", F.sum((~F.col("in")).cast("int")).over(order))
    runs = marked.filter("in").groupBy("doc_id", *by, "run").agg(F.sort_array(F.collect_list(F.struct("pos", "surface"))).alias("t"))
    return runs.select("doc_id", F.transform("t", lambda x: x["surface"]).alias("words"), F.element_at("t", -1)["pos"].alias("last"))


def _usable(term: Column, low: int, high: int) -> Column:
    return F.length(term).between(low, high) & ~is_garbage(term) & ~is_common_noun(term)


def noun_phrases(tokens: DataFrame, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> DataFrame:
    """Counts of maximal runs of nouns and prefixes of a token table (doc_id, sent_no, pos,
    surface, pos_tag)."""
    runs = _islands(tokens, F.col("pos_tag").isin("名詞", "接頭辞"))
    term = F.array_join("words", "").alias("term")
    return runs.select("doc_id", term).filter(_usable(F.col("term"), low, high)).groupBy("doc_id", "term").agg(F.count("*").alias("freq"))


def noun_phrases_v3(tokens: DataFrame, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> DataFrame:
    """As ``noun_phrases``, but a run of three or more that something follows also gives its
    endings, the whole run among them."""
    runs = _islands(tokens, F.col("pos_tag").isin("名詞", "接頭辞"))
    end = tokens.groupBy("doc_id").agg(F.max("pos").alias("end"))
    n = F.size("words")
    tails = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice("words", i, n), ""))
    more = F.when((n > 2) & (F.col("last") < F.col("end")), tails).otherwise(F.array().cast("array<string>"))
    terms = runs.join(end, "doc_id").select("doc_id", F.explode(F.concat(F.array(F.array_join("words", "")), more)).alias("term"))
    return terms.filter(F.length("term").between(low, high)).groupBy("doc_id", "term").agg(F.count("*").alias("freq"))


def noun_ngrams(tokens: DataFrame, longest: int = 4, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> DataFrame:
    """Counts of the windows of two to ``longest`` nouns inside a sentence's noun runs."""
    runs = _islands(tokens, F.col("pos_tag") == "名詞", "sent_no").filter(F.size("words") >= 2)
    n = F.size("words")
    windows = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.least(F.lit(longest), n)),
            lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice("words", i, k), "")),
        )
    )
    terms = runs.select("doc_id", F.explode(windows).alias("term"))
    return terms.filter(_usable(F.col("term"), low, high)).groupBy("doc_id", "term").agg(F.count("*").alias("freq"))


def prefiltered(scored: DataFrame, fold=T.nfkc) -> DataFrame:
    """Drop stopwords, single characters, numbers and years; a term of up to three
    characters inside a longer survivor keeps 0.3 of its score. (doc_id, term, score) gains
    ``contained``. ``fold`` normalises the term for the tests."""
    from termloom.operators.containment import over_longer

    n = fold(F.col("term"))
    year = (F.length(n) == 4) & n.rlike(r"(?U)^(?:19|20)\d\d$")
    left = scored.filter(~is_stopword(n) & (F.length(n) != 1) & ~n.rlike(r"(?U)^\d+$") & ~year)
    inside = over_longer(left.select("doc_id", "term"), F.first(F.lit(True)).alias("inside"))
    flag = (F.length("term") <= 3) & F.coalesce("inside", F.lit(False))
    out = left.join(inside, ["doc_id", "term"], "left").withColumn("contained", flag).drop("inside")
    return out.withColumn("score", F.col("score") * F.when(F.col("contained"), 0.3).otherwise(1.0))


def damped_stopwords(scored: DataFrame) -> DataFrame:
    return scored.withColumn("score", F.col("score") * F.when(is_stopword(F.col("term")), 0.1).otherwise(1.0))
