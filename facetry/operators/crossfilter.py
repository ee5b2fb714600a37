"""Cross-filtering: every view sees the conditions of all others, not its own."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame


class CrossFilter:
    """Conditions on one subset, kept under the name of the view or control that set them."""

    def __init__(self) -> None:
        self._conditions: dict[str, Column] = {}

    def set(self, key: str, condition: Column | None) -> None:
        """Put, replace or, with ``None``, take back the condition of a view."""
        if condition is None:
            self._conditions.pop(key, None)
        else:
            self._conditions[key] = condition

    def clear(self, key: str) -> None:
        self.set(key, None)

    @property
    def keys(self) -> list[str]:
        return list(self._conditions)

    def condition_of(self, key: str) -> Column:
        """What a view or control has set."""
        return self._conditions[key]

    def condition_for(
        self, view: str | None = None, reducer: Callable[[Column, Column], Column] = and_
    ) -> Column | None:
        """What restricts a view: the conditions of all others; all conditions when none is named."""
        others = [c for key, c in self._conditions.items() if key != view]
        return reduce(reducer, others) if others else None

    def frame_for(
        self, df: DataFrame, view: str | None = None, reducer: Callable[[Column, Column], Column] = and_
    ) -> DataFrame:
        condition = self.condition_for(view, reducer)
        return df if condition is None else df.where(condition)
