"""Quick flags: named conditions a user switches on, joined by AND."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame

from facetry.errors import FacetryError
from facetry.functions.expressions import condition
from facetry.profile import CatalogProfile


def flag_condition(
    df: DataFrame, names: Iterable[str], dataset: str, profile: CatalogProfile, invert: bool = False
) -> Column | None:
    """All named flags as one condition; ``None`` when no flag applies to the dataset.

    Inverting negates the flags as a block: a row then fails at least one of them.
    """
    overrides = profile.flag_overrides.get(profile.dataset(dataset), {})
    parts = []
    for name in names:
        if name not in profile.quick_flags:
            raise FacetryError(f"there is no quick flag {name!r}")
        text = overrides.get(name, profile.quick_flags[name])
        if text is not None:
            parts.append(condition(df, text))
    if not parts:
        return None
    block = reduce(and_, parts)
    return ~block if invert else block
