"""Computed columns: named formulas a user adds to a catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from facetry.errors import ExpressionError
from facetry.functions.expressions import formula, formula_names


@dataclass(frozen=True)
class ComputedColumns:
    """Formulas by name, in the order they were added; a later one may use an earlier one."""

    formulas: tuple[tuple[str, str], ...] = ()

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.formulas]

    def add(self, df: DataFrame, name: str, text: str) -> ComputedColumns:
        """With one more column; name and formula are checked against ``df`` and the columns so far."""
        if not name:
            raise ExpressionError("no name given")
        known = self.apply(df)
        if name in known.columns:
            raise ExpressionError(f"the name {name!r} exists already")
        formula(known, text)
        return ComputedColumns((*self.formulas, (name, text)))

    def dependents(self, name: str) -> set[str]:
        """The columns that use ``name``, directly or through others."""
        found = {name}
        for other, text in self.formulas:
            if formula_names(text) & found:
                found.add(other)
        return found - {name}

    def drop(self, name: str) -> ComputedColumns:
        """Without the column and without all that use it."""
        if name not in self.names:
            raise ExpressionError(f"there is no computed column {name!r}")
        gone = {name} | self.dependents(name)
        return ComputedColumns(tuple(f for f in self.formulas if f[0] not in gone))

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with all computed columns; those that do not use each other share a projection."""
        batch: dict[str, str] = {}
        for name, text in self.formulas:
            if formula_names(text) & set(batch):
                df = df.withColumns({n: formula(df, t) for n, t in batch.items()})
                batch = {}
            batch[name] = text
        return df.withColumns({n: formula(df, t) for n, t in batch.items()}) if batch else df
