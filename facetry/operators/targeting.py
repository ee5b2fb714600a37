"""Targeting bits: rows that one of the selected programmes targeted.

Each row carries an array of flag bytes; bit ``b`` is bit ``b % 8`` of byte ``b div 8``.  The mapping
table names the programme (mapper) and the carton of each bit.  A selection becomes a mask of at most
one number per byte, which is put into the plan as literals: the test of a row reads only the bytes
the mask uses, stays in generated code and needs no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, ne, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.errors import FacetryError
from facetry.functions.missing import column

COMBINE = {"AND": and_, "OR": or_, "XOR": ne}
MODES = ("bitwise", "bytewise")


def selected_bits(
    mapping: DataFrame, cartons: Sequence[str], mappers: Sequence[str], combine: str = "AND"
) -> DataFrame:
    """The mapping rows of a selection by carton, by mapper, or by both."""
    if combine not in COMBINE:
        raise FacetryError(f"combine is one of {', '.join(COMBINE)}, not {combine!r}")
    by_carton = F.coalesce(F.col("alt_name").isin(list(cartons)), F.lit(False))
    by_mapper = F.coalesce(F.col("mapper").isin(list(mappers)), F.lit(False))
    if not mappers:
        return mapping.where(by_carton)
    if not cartons:
        return mapping.where(by_mapper)
    return mapping.where(COMBINE[combine](by_mapper, by_carton))


def byte_masks(bits: DataFrame, n_bytes: int) -> DataFrame:
    """``(byte, mask)`` of the given bits; bits past the last byte are left out."""
    return (
        bits.where(F.col("bit") < n_bytes * 8)
        .groupBy(F.expr("cast(bit div 8 as int)").alias("byte"))
        .agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("mask"))
    )


def carries_bits(flags: Column, masks: dict[int, int], mode: str = "bitwise") -> Column:
    """Row test: one of the masked bits is set.

    ``mode="bytewise"`` is the older test, which only asks whether the byte of a selected bit holds
    any bit at all, and so also finds the neighbours of a carton.
    """
    if mode not in MODES:
        raise FacetryError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    if not masks:
        return F.lit(False)
    tests = []
    for byte, mask in sorted(masks.items()):
        value = F.get(flags, F.lit(byte)).cast("int")
        tests.append(value.bitwiseAND(F.lit(mask)) != 0 if mode == "bitwise" else value != 0)
    return reduce(or_, tests)


def target_condition(
    mapping: DataFrame,
    cartons: Sequence[str] = (),
    mappers: Sequence[str] = (),
    combine: str = "AND",
    invert: bool = False,
    flags: str = "flags",
    n_bytes: int = 57,
    mode: str = "bitwise",
) -> Column | None:
    """Condition on the flag bytes; ``None`` when nothing is selected.

    The mask is read at once: it has at most ``n_bytes`` rows.
    """
    if not cartons and not mappers:
        return None
    rows = byte_masks(selected_bits(mapping, cartons, mappers, combine), n_bytes).collect()
    test = carries_bits(column(flags), {r["byte"]: r["mask"] for r in rows}, mode)
    return ~test if invert else test
