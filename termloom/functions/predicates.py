"""Predicates over terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions import patterns as P


def is_garbage(term: Column) -> Column:
    # of the terms that begin in ASCII only those in GHG can be; the others skip the patterns
    may_be = (F.ascii(term) > 127) | term.startswith("GHG")
    return may_be & (term.rlike(P.SHORT_KATAKANA) | term.rlike("^(?:" + "|".join(P.GARBAGE) + ")"))


def is_number(term: Column) -> Column:
    return ((F.ascii(term) < 58) | (F.ascii(term) > 127)) & term.rlike(r"(?U)^\d+$")


def is_common_noun(term: Column) -> Column:
    return term.isin(*P.COMMON_NOUNS)


def is_model_number(term: Column) -> Column:
    return term.rlike(P.MODEL_NUMBER)


def is_likely_technical(term: Column) -> Column:
    ends = F.lit(False)
    for s in P.TECHNICAL_SUFFIXES:
        ends = ends | term.endswith(s)
    return term.rlike(P.TWO_SCRIPTS) | term.rlike("[A-Za-z0-9]") | ends | (F.length(term) >= 4)


def is_stopword(term: Column) -> Column:
    return term.isin(*P.STOPWORDS)


def has_text(column: Column) -> Column:
    """Neither null nor empty."""
    return column.isNotNull() & (column != "")
