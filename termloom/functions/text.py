"""Text functions over columns. Blanks and digits are Unicode's unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from termloom.functions import patterns as P


#: Unicode's blanks.
BLANK_CHARS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def single_blanks(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def sentences(text: Column) -> Column:
    """Split at the ideographic stop and at line ends; untrimmed; the whole text if none is left."""
    parts = F.filter(F.split(F.translate(text, "\n", P.ENDS_PLAIN), P.ENDS_PLAIN, -1), not_blank)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def sentences_all(text: Column, trim: bool = False) -> Column:
    """Split at any sentence end."""
    parts = F.filter(F.split(text, P.ENDS_ALL, -1), not_blank)
    return F.transform(parts, trimmed) if trim else parts


def sentences_comma(text: Column) -> Column:
    """Split at sentence ends and the ideographic comma, for n-grams."""
    return F.filter(F.split(text, P.ENDS_COMMA, -1), not_blank)


def index_sentences(text: Column) -> Column:
    """Sentences for an index: trimmed, each with its stop again."""
    parts = F.filter(F.split(text, P.ENDS_PLAIN, -1), not_blank)
    return F.transform(parts, lambda s: F.concat(trimmed(s), F.lit(P.ENDS_PLAIN)))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda s: s != "")


def script_words(text: Column) -> Column:
    """Distinct runs of one script of two characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(P.SCRIPT_RUN), F.lit(0)), lambda w: F.length(w) > 1))


def term_words(term: Column) -> Column:
    """The blank-separated pieces of a term and its script runs, two characters or more each."""
    pieces = F.filter(F.split(trimmed(term), r"(?U)\s+"), lambda w: F.length(w) > 1)
    return F.array_union(pieces, script_words(term))


def char_tokens(text: Column) -> Column:
    """Characters without blanks: the tokens where no morphological tokenizer is at hand."""
    return F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), lambda c: (c != "") & not_blank(c))


def char_ngrams(text: Column, n: int = 2) -> Column:
    """Distinct character n-grams; none if the text is shorter."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, n: int = 2) -> Column:
    """Overlap of character n-grams; texts shorter than n compare by equality."""
    x, y = char_ngrams(a, n), char_ngrams(b, n)
    union = F.size(F.array_union(x, y))
    share = F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)
    return F.when((F.length(a) < n) | (F.length(b) < n), (a == b).cast("double")).otherwise(share)


def count_of(text: Column, part: Column) -> Column:
    """Occurrences of ``part`` from left to right without overlap."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.length(text) + 1)


def contexts(text: Column, part: Column, window: int = 50, most: int = 3) -> Column:
    """The surroundings of the first occurrences, clipped to the text."""
    found, at = [], F.lit(1)
    for _ in range(most):
        p = F.call_function("locate", part, text, at)
        p = F.when(at > 0, p).otherwise(0)
        found.append(p)
        at = F.when(p > 0, p + F.length(part)).otherwise(0)
    spots = F.filter(F.array(*found), lambda p: p > 0)

    def around(p: Column) -> Column:
        start = F.greatest(F.lit(0), p - 1 - window)
        end = F.least(F.length(text), p - 1 + F.length(part) + window)
        return F.substring(text, start + 1, end - start)

    return F.transform(spots, around)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def without_fence(reply: Column) -> Column:
    """A model's reply without a code fence around it."""
    bare = trimmed(reply)
    for pattern in (r"^```json", r"^```", r"```$"):
        bare = F.regexp_replace(bare, pattern, "")
    return trimmed(bare)


def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark has no function for."""
    return F.pandas_udf(_compose, StringType())(text)
