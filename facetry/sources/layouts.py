"""Orders of a catalogue's rows that let the reader leave out most of the files.

*Sampled*: rows lie in the order of the seeded shuffle, so its first rows are the first row groups of each pipeline.
*Ordered*: each row group covers a short range of a column, such as an identifier that lists are looked up by.
*Clustered*: rows that are near in several columns at once lie together, so a box in two of them is a few row groups.
Both write one range of the order per task; a pipeline, a place or a value that holds most of the rows is spread over
several by a hash of the row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.errors import FacetryError
from facetry.functions.missing import column, is_numeric, present, type_of
from facetry.operators.tables import SHUFFLE, SHUFFLE_SEED, shuffle_key, shuffle_metadata

#: Bytes of a row group: small enough that a few of them are a small share of a file.
ROW_GROUP_BYTES = 16 * 2**20
#: Bits of each column in a clustered order, and the error of the ranks that the parts are cut at.
CLUSTER_BITS = 6
SPREAD = "_spread"


def write_sampled(
    df: DataFrame,
    path: str,
    pipeline: str,
    key: Sequence[str | Column],
    seed: int = SHUFFLE_SEED,
    files: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Write a catalogue in the order of the seeded shuffle of a key.

    The leading digits of the shuffle are a column of their own, which names key and seed; ``seeded_sample`` with the same
    ones then reads only as many row groups as it needs.
    """
    # The first 15 hexadecimal digits, so that the number is never negative.
    digits = F.conv(F.substring(shuffle_key(key, seed), 1, 15), 16, 10).cast("bigint")
    marked = df.withColumn(SHUFFLE, digits.alias(SHUFFLE, metadata=shuffle_metadata(key, seed)))
    _write_in_order(marked, path, pipeline, [F.col(SHUFFLE)], files, row_group_bytes)


def write_ordered(
    df: DataFrame,
    path: str,
    pipeline: str,
    columns: Sequence[str],
    identifiers: Sequence[str] = (),
    files: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Write a catalogue in the order of some columns, with Bloom filters of its identifier columns.

    Each row group covers a short range of the first column, and tells which values of an identifier it may hold: lists of
    identifiers are looked up in few of them.
    """
    blooms = {f"parquet.bloom.filter.enabled#{name}": "true" for name in identifiers}
    if blooms:
        blooms["parquet.bloom.filter.adaptive.enabled"] = "true"
    _write_in_order(df, path, pipeline, [column(c) for c in columns], files, row_group_bytes, blooms)


def write_clustered(
    df: DataFrame,
    path: str,
    pipeline: str,
    columns: Sequence[str],
    files: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Write a catalogue in the Morton order of two or more numeric columns.

    Each column is cut into parts with about equal numbers of rows, so that values far apart from the rest do not take all
    parts; the bits of the parts' numbers are interleaved. Missing values are a part of their own, the first.
    """
    if len(columns) < 2:
        raise FacetryError("a clustered order needs two columns")
    parts = cluster_parts(df, columns)
    _write_in_order(df, path, pipeline, [_interleaved(parts), *map(column, columns)], files, row_group_bytes)


def cluster_parts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The number of the part in which each column's value lies. One pass finds all cuts, a fixed number of values."""
    for name in columns:
        if not is_numeric(type_of(df, name)):
            raise FacetryError(f"column {name!r} is not numeric")
    shares = [i / 2**CLUSTER_BITS for i in range(1, 2**CLUSTER_BITS)]
    values = [present(df, name).cast("double") for name in columns]
    found = df.agg(*[F.percentile_approx(v, shares, 1000).alias(f"cuts{i}") for i, v in enumerate(values)]).first()
    cuts = [sorted(set(found[i] or [])) for i in range(len(columns))]
    # Missing values are 0, and so is what lies below the first cut.
    return [F.when(v.isNotNull(), _part(v, c, 0)).otherwise(0) for v, c in zip(values, cuts, strict=True)]


def _part(value: Column, cuts: list[float], first: int) -> Column:
    """How many cuts are not above a value, by halves."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    below, above = cuts[:middle], cuts[middle + 1 :]
    return F.when(value < F.lit(cuts[middle]), _part(value, below, first)).otherwise(
        _part(value, above, first + middle + 1)
    )


def _interleaved(parts: list[Column]) -> Column:
    bits = []
    for bit in range(CLUSTER_BITS):
        for i, part in enumerate(parts):
            one = F.shiftright(part, bit).bitwiseAND(F.lit(1)).cast("bigint")
            bits.append(F.shiftleft(one, bit * len(parts) + len(parts) - 1 - i))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _write_in_order(
    df: DataFrame,
    path: str,
    pipeline: str,
    order: list[Column],
    files: int | None,
    row_group_bytes: int,
    options: Mapping[str, str] | None = None,
) -> None:
    hashed = [column(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    names = [f"_order{i}" for i in range(len(order))]
    keyed = df.withColumns({n: c for n, c in zip(names, order, strict=True)} | {SPREAD: F.xxhash64(*hashed)})
    by = [column(pipeline), *map(F.col, names), F.col(SPREAD)]
    count = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = keyed.repartitionByRange(count, *by).sortWithinPartitions(*by).drop(*names, SPREAD)
    writer = sorted_rows.write.partitionBy(pipeline).options(**(options or {})).option("parquet.block.size", row_group_bytes)
    # The reader skips pages inside a row group too.
    writer.option("parquet.page.size", max(row_group_bytes // 16, 4096)).parquet(path)
