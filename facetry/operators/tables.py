"""Rows in a fixed order: pages, samples and the seeded shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.functions.missing import column, type_of
from facetry.operators.addresses import ADDRESS, FILE, MOST_ADDRESSES, NUMBER, at_addresses, with_address
from facetry.operators.binning import bin_number

# Seed of the shuffle, rows of a page, points of a scatter view.
SHUFFLE_SEED = 42
PAGE_ROWS = 10
SCATTER_POINTS = 10_000

SAMPLE_PLACES = 1024
# The column of a table stored in the order of its shuffle; the share of it that is read first, and how fast that grows.
SHUFFLE = "_shuffle"
FIRST_SHARE = 2.0**-24
MOST_WIDENING = 4096.0
# Pages that end within the first rows are read directly; others from a range of the key.
FEW_ROWS = 100
RANGE_ROWS = 1_000_000
KEY_PARTS = 4096
# Letters by which the prefixes of a text key grow in each step.
PREFIX_LETTERS = 2
TIE = "_tie"


def shuffle_key(key: Sequence[str | Column], seed: int = SHUFFLE_SEED) -> Column:
    """A number in text form that orders rows at random, the same on every run and any partitioning."""
    parts = [column(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def shuffle_metadata(key: Sequence[str | Column], seed: int) -> dict[str, str]:
    """What a stored shuffle is of."""
    return {"seed": str(seed), "key": ",".join(map(str, key))}


def seeded_shuffle(df: DataFrame, key: Sequence[str | Column], seed: int = SHUFFLE_SEED) -> DataFrame:
    """All rows in the random order of the seed.

    Copies of a row have the same key; the running id lets the sort split them over several tasks.
    """
    ordered = df.withColumn("shuffle_key", shuffle_key(key, seed))
    return ordered.orderBy("shuffle_key", F.monotonically_increasing_id())


def seeded_sample(
    df: DataFrame, key: Sequence[str | Column], limit: int = SCATTER_POINTS, seed: int = SHUFFLE_SEED
) -> DataFrame:
    """The first ``limit`` rows of the seeded shuffle, with their ``shuffle_key``.

    Sorting everything for a few rows would send ``limit`` rows of every task to one.  The keys are spread evenly, so the
    count of the rows says which share of them holds the first ones; only rows of that share, hardly more than the
    limit, take part in the sort.  If it holds too few, because the key has copies, a larger share is taken.

    Rows of files are found by their key and address, at once; what the caller selects is then read from the files that
    hold them.  Other rows, and limits past ``MOST_ADDRESSES``, are sorted whole, ties by all columns.  Of a table that is
    stored in the order of this shuffle only its beginning is read, and its rows are not counted.
    """
    stored = SHUFFLE in df.columns and df.schema[SHUFFLE].metadata == shuffle_metadata(key, seed)
    addressed = with_address(df) if limit <= MOST_ADDRESSES else None
    if addressed is None:
        tied = [column(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        rows = df.withColumn("shuffle_key", shuffle_key(key, seed))
        narrow = rows
    else:
        tied = [F.col(c) for c in ADDRESS]
        rows = addressed.withColumn("shuffle_key", shuffle_key(key, seed))
        narrow = rows.select("shuffle_key", *ADDRESS, *([SHUFFLE] if stored else []))
    for share in _shares(narrow, limit, stored):
        few = _first_by_key(_beginning(narrow, share, stored), limit, tied)
        if addressed is None:
            if share == 1 or few.count() == limit:
                return few
            continue
        found = few.select(FILE, NUMBER).toArrow()
        if share == 1 or found.num_rows == limit:
            break
    held = _beginning(rows, share, stored) if stored else rows
    return at_addresses(held, found).orderBy("shuffle_key", *tied).drop(*ADDRESS)


def _shares(rows: DataFrame, limit: int, stored: bool) -> Iterator[float]:
    """Shares of the shuffle to look for its first ``limit`` rows in, one after the other; at last all of it."""
    share = FIRST_SHARE if stored else min(1.0, (limit + 6 * math.sqrt(limit) + 10) / max(rows.count(), 1))
    while share < 1:
        yield share
        if stored:
            # Widened by what the share asks for, so that few rows cost two or three short jobs more.
            held = rows.where(_within(share, stored)).limit(limit).count()
            share *= min(MOST_WIDENING, max(4.0, 2.0 * limit / max(held, 1)))
        else:
            share *= 8
    yield 1


def _within(share: float, stored: bool) -> Column:
    """The beginning of the shuffle: by the stored digits, which the reader compares with its statistics, or by the key."""
    end = int(share * 16**15)
    return F.col(SHUFFLE) < F.lit(end) if stored else F.col("shuffle_key") < F.lit(f"{end:015x}")


def _beginning(rows: DataFrame, share: float, stored: bool) -> DataFrame:
    return rows if share == 1 else rows.where(_within(share, stored))


def _first_by_key(rows: DataFrame, limit: int, tied: list[Column]) -> DataFrame:
    """The first rows by ``shuffle_key``, then by ``tied``; copies of a key are first cut down in many places."""
    placed = rows.withColumn("_part", F.spark_partition_id() % SAMPLE_PLACES)
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("shuffle_key", *tied))
    few = placed.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_part", "_nth")
    return few.orderBy("shuffle_key", *tied).limit(limit)


def scatter_points(
    df: DataFrame,
    x: str,
    y: str,
    color: str,
    key: Sequence[str | Column],
    log_color: bool = False,
    limit: int = SCATTER_POINTS,
    seed: int = SHUFFLE_SEED,
) -> DataFrame:
    """Points of a scatter view: ``x``, ``y``, ``color`` and the columns of the row's key."""
    names = [k for k in key if isinstance(k, str)]
    tint = F.log10(column(color).cast("double")) if log_color else column(color)
    sample = seeded_sample(df, key, limit, seed)
    return sample.select(column(x).alias("x"), column(y).alias("y"), tint.alias("color"), *map(column, names))


def page(
    df: DataFrame, key: Sequence[str], number: int, rows: int = PAGE_ROWS, columns: Sequence[str] | None = None
) -> DataFrame:
    """One page of a table in the order of a key, from page 0, with the row number.

    Rows with the same key follow in the order of their addresses, or of a hash of their values where they are not rows
    of files, so pages never overlap.  The page is found on the key and the address alone, at once; the columns that are
    shown are then read from the files that hold its rows.  To show a page, each task hands all rows before its end to
    one other task.  That is cheap for the first pages; for a later one the range of the key in which it lies is found
    first.
    """
    skipped = number * rows
    shown_columns = list(columns or df.columns)
    addressed = with_address(df) if rows <= MOST_ADDRESSES else None
    if addressed is None:
        ties = [c for c in df.columns if c not in key and not isinstance(type_of(df, c), T.MapType)]
        found, before, by = _placed_page(df.withColumn(TIE, _tie(df)), [*key, TIE], ties, skipped, rows)
    else:
        narrow = addressed.select(*map(column, key), *ADDRESS)
        found, before, by = _placed_page(narrow, [*key, *ADDRESS[:-1]], [ADDRESS[-1]], skipped, rows)
    shown = found.orderBy(*by).offset(skipped - before).limit(rows)
    if addressed is not None and not set(shown_columns) <= set(key):
        shown = at_addresses(addressed, shown.select(FILE, NUMBER).toArrow())
    counted = shown.withColumn("row", F.row_number().over(Window.orderBy(*by)) + skipped - 1)
    return counted.select("row", *map(column, shown_columns))


def _placed_page(
    source: DataFrame, order: list[str], ties: list[str], skipped: int, rows: int
) -> tuple[DataFrame, int, list[Column]]:
    """Rows that hold a page, the number of rows before them, and what they are ordered by."""
    before = 0
    if skipped + rows > FEW_ROWS:
        source, before = _page_range(source, order, skipped, rows)
    return source, before, [column(name) for name in [*order, *ties]]


def _tie(df: DataFrame) -> Column:
    """A number that tells rows with the same key apart."""
    values = [column(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.xxhash64(*values)


def _page_range(df: DataFrame, key: Sequence[str], skipped: int, rows: int) -> tuple[DataFrame, int]:
    """Rows that hold the page and follow each other in the order of the key, and the rows before them.

    The range of the first key column is cut into parts, whose rows are counted; the parts the page touches are
    cut again, until few rows are left.  When one value of a column is all that is left, the next column goes on.
    Each step sends the counts of the parts to the shuffle, never rows.
    """
    source, before, total = df, 0, None
    for name in key:
        letters = 0
        while total is None or total > RANGE_ROWS:
            letters += PREFIX_LETTERS
            single, part = _key_part(source, name, letters)
            if single:
                break
            if part is None:
                return source, before
            counts = source.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
            start = F.col("upto") - F.col("n") + before
            touched = (
                counts.withColumn("upto", F.sum("n").over(Window.orderBy("part")))
                .where((start < skipped + rows) & (start + F.col("n") > skipped))
                .agg(F.min("part"), F.max("part"), F.min(start), F.sum("n"))
            )
            first, last, first_start, kept = touched.first()
            text = isinstance(type_of(df, name), T.StringType)
            if not kept or (kept == total and not text):
                return source, before
            source, before, total = source.where(part.between(first, last)), first_start, kept
        if total is not None and total <= RANGE_ROWS:
            break
    return source, before


def _key_part(source: DataFrame, name: str, letters: int) -> tuple[bool, Column | None]:
    """Whether a key column has one value only, and else a value that grows with it and has few values.

    Texts are cut by their first letters, numbers into equal parts of their range; nothing where that does not
    divide them further. NULL is the first part.
    """
    value, kind = column(name), type_of(source, name)
    if isinstance(kind, T.StringType):
        low, high, longest, missing = source.agg(
            F.min(value), F.max(value), F.max(F.length(value)), F.count_if(value.isNull())
        ).first()
        if low == high and not (missing and low is not None):
            return True, None
        # One letter in front of every text, so that NULL is less than the empty text.
        shown = F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), F.substring(value, 1, letters)))
        return False, shown if letters < longest + PREFIX_LETTERS else None
    if isinstance(kind, T.IntegralType):
        low, high, missing = source.agg(F.min(value), F.max(value), F.count_if(value.isNull())).first()
        if low == high and not (missing and low is not None):
            return True, None
        step = -(-(high - low + 1) // KEY_PARTS)
        whole = value.cast("decimal(38,0)") - F.lit(low).cast("decimal(20,0)")
        number = F.floor(whole / F.lit(step).cast("decimal(20,0)"))
        return False, F.when(value.isNull(), -1).otherwise(number.cast("bigint"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        finite = F.when(F.abs(value) < F.lit(float("inf")), value)
        low, high = source.agg(F.min(finite), F.max(finite)).first()
        if low is None:
            return False, None
        number = bin_number(value, (low, high), KEY_PARTS)
        outside = F.when(F.isnan(value), KEY_PARTS + 1).when(value > 0, KEY_PARTS).when(value < 0, -1).otherwise(-2)
        one = source.where(F.coalesce(value != low, F.lit(True))).isEmpty()
        return one, F.when(finite.isNotNull(), number).otherwise(outside)
    return False, None


def page_after(
    df: DataFrame, key: str, last: int | str, rows: int = PAGE_ROWS, columns: Sequence[str] | None = None
) -> DataFrame:
    """The page that follows the row with key ``last``: a range the reader can push down."""
    following = df.where(column(key) > F.lit(last)).orderBy(column(key)).limit(rows)
    return following.select(*map(column, columns or df.columns))
