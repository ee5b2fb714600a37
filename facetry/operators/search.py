"""Search in glossaries and names, and checks of names a user asks for."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.errors import FacetryError
from facetry.functions.missing import column
from facetry.functions.text import has_words, text_has_words

# Fixed value: hits of the glossary shown at once.
GLOSSARY_HITS = 20


def fuzzy_search(df: DataFrame, query: str, name: str) -> DataFrame:
    """Rows whose text holds all words of the query; an empty query finds nothing."""
    return df.where(has_words(column(name), query))


def matching_names(names: Iterable[str], query: str) -> list[str]:
    """The names of a short list that hold all words of the query."""
    return [n for n in names if text_has_words(n, query)]


def glossary_search(df: DataFrame, query: str, names: Sequence[str] = ("name", "description")) -> DataFrame:
    """Rows where one of the columns holds all words; an empty query finds every row."""
    if not query.strip():
        return df
    hit = F.lit(False)
    for name in names:
        hit = hit | has_words(column(name), query)
    return df.where(hit)


def first_hits(hits: DataFrame, order: str, limit: int = GLOSSARY_HITS) -> DataFrame:
    return hits.orderBy(column(order)).limit(limit)


def hit_counts(df: DataFrame, query: str, names: Sequence[str] = ("name", "description")) -> DataFrame:
    """``(shown, total)`` of a glossary search."""
    total = F.count("*")
    shown = F.least(total, F.lit(GLOSSARY_HITS).cast("bigint"))
    return glossary_search(df, query, names).agg(shown.alias("shown"), total.alias("total"))


def unknown_names(df: DataFrame, name: str, requested: Iterable[str]) -> DataFrame:
    """The requested names that do not occur in the column, found in one pass over it."""
    asked = df.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(requested)], "name string")
    known = df.select(column(name).alias("name")).where(F.col("name").isin(list(requested))).distinct()
    return asked.join(known, "name", "left_anti")


def require_known(df: DataFrame, name: str, requested: Sequence[str], what: str) -> None:
    """Refuse names that do not occur; reading stops at the first row of each name."""
    unknown = sorted(n for n in dict.fromkeys(requested) if df.where(column(name) == F.lit(n)).isEmpty())
    if unknown:
        raise FacetryError(f"unknown {what}: {', '.join(unknown)}")
