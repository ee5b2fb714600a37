"""Rows whose identifier is on a list.

A short list becomes literals, which reach the Parquet reader.  Every other list is a DataFrame and
the condition an IN subquery: a semi join that Spark broadcasts or shuffles by the size it measures.
Where the catalogue is stored in the order of the identifier, the ranges in which the list has values
reach the reader too, however long the list is.
"""

from __future__ import annotations

import operator
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.errors import FacetryError
from facetry.functions.missing import column, type_of
from facetry.profile import CatalogProfile
from facetry.sources.identifiers import INTEGER, NOT_INTEGERS, parse_identifiers

MOST_LITERALS = 1000
#: Ranges of a list that reach the reader; values it is cut at, and steps between two of them; letters of texts.
RANGES = 32
CUTS = 128
STEPS = 32
LETTERS = 12


def crossmatch_condition(
    df: DataFrame,
    identifiers: str | DataFrame | None,
    id_type: str,
    dataset: str,
    profile: CatalogProfile,
) -> Column | None:
    """Condition for a list given as text (one identifier per line) or as lines of a DataFrame."""
    if id_type not in profile.identifiers:
        raise FacetryError(f"there is no identifier type {id_type!r}")
    if (id_type, profile.dataset(dataset)) in profile.refused_identifiers:
        raise FacetryError(f"{id_type} is not supported with dataset {dataset}")
    if identifiers is None or (isinstance(identifiers, str) and not identifiers.strip()):
        return None
    name = profile.identifiers[id_type]
    dtype = type_of(df, name)
    if isinstance(identifiers, DataFrame):
        listed = parse_identifiers(identifiers, dtype)
        held = column(name).isin(listed)
        if id_type not in profile.ordered_identifiers:
            return held
        return within_ranges(name, identifier_ranges(listed, dtype)) & held
    values = text_identifiers(identifiers, dtype)
    if len(values) <= MOST_LITERALS:
        return column(name).isin(values)
    # An Arrow table becomes a local relation, whose size Spark knows when it chooses the join.
    listed = df.sparkSession.createDataFrame(pa.table({"id": values}))
    return column(name).isin(listed)


def identifier_ranges(listed: DataFrame, dtype: T.DataType) -> list[tuple[int, int]] | list[tuple[str, str]]:
    """At most ``RANGES`` ranges, in order, in which a list has values: what reaches the driver is bounded.

    The list is cut into parts, and the widest gaps between the values of neighbouring parts are left out.  Texts are cut by
    their first letters, numbers at values with about equal shares of the list, and what lies between two of them again into
    equal steps, so that neither a few values far away nor a gap in the middle hides the gaps elsewhere.
    """
    text = isinstance(dtype, T.StringType)
    part = _letters_part(listed) if text else _number_part(listed)
    found = listed.groupBy(part.alias("part")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    ranges = sorted((r["low"], r["high"]) for r in found.collect())
    if not ranges:
        return []
    nearness = _shared_letters if text else operator.sub
    gaps = sorted(range(1, len(ranges)), key=lambda i: nearness(ranges[i - 1][1], ranges[i][0]))[: RANGES - 1]
    begins = [0, *sorted(gaps)]
    return [(ranges[a][0], ranges[b - 1][1]) for a, b in zip(begins, [*begins[1:], len(ranges)], strict=True)]


def _letters_part(listed: DataFrame) -> Column:
    counts = listed.agg(*[F.approx_count_distinct(F.substring("id", 1, n)) for n in range(1, LETTERS + 1)]).first()
    letters = max([n for n, c in enumerate(counts, 1) if c <= CUTS * STEPS], default=0)
    return F.substring("id", 1, letters) if letters else F.lit("")


def _number_part(listed: DataFrame) -> Column:
    shares = [i / CUTS for i in range(1, CUTS)]
    low, high, cuts = listed.agg(F.min("id"), F.max("id"), F.percentile_approx("id", shares, 10_000)).first()
    if low is None:
        return F.lit(0)
    ends = sorted({low, *cuts, high + 1})
    number = F.col("id").cast("decimal(20,0)")

    def steps(i: int) -> Column:
        """The part of a number between two cuts."""
        width = -(-(ends[i + 1] - ends[i]) // STEPS)
        return i * STEPS + F.floor((number - F.lit(ends[i]).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))

    def between(a: int, b: int) -> Column:
        if b - a == 1:
            return steps(a)
        middle = (a + b) // 2
        return F.when(F.col("id") < F.lit(ends[middle]), between(a, middle)).otherwise(between(middle, b))

    return between(0, len(ends) - 1).cast("bigint")


def _shared_letters(a: str, b: str) -> int:
    """Letters that two different texts begin with: the fewer, the further apart they are in order."""
    return len(os.path.commonprefix([a, b]))


def within_ranges(name: str, ranges: list[tuple]) -> Column:
    found = F.lit(False)
    for low, high in ranges:
        found = found | column(name).between(F.lit(low), F.lit(high))
    return found


def text_identifiers(text: str, dtype: T.DataType) -> list[int] | list[str]:
    """The distinct identifiers of a text a user typed or pasted."""
    lines = dict.fromkeys(line.strip() for line in text.split("\n") if line.strip())
    if isinstance(dtype, T.StringType):
        return list(lines)
    bad = next((line for line in lines if not re.fullmatch(INTEGER, line) or not -(2**63) <= int(line) < 2**63), None)
    if bad is not None:
        raise FacetryError(f"{NOT_INTEGERS}: {bad}")
    return list(dict.fromkeys(int(line) for line in lines))
