"""Subset specifications: what a user asks for, and the lazy DataFrame it compiles to."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame

from facetry.errors import FacetryError
from facetry.functions.expressions import condition, expand_spellings
from facetry.operators.computed import ComputedColumns
from facetry.operators.crossmatch import crossmatch_condition
from facetry.operators.quickflags import flag_condition
from facetry.operators.search import require_known
from facetry.operators.targeting import target_condition
from facetry.profile import CatalogProfile
from facetry.sources.catalog import Catalog

LISTS = ("flags", "cartons", "mappers")
# Names of the request parameters that are called differently here.
REQUEST_NAMES = {"carton": "cartons", "mapper": "mappers", "cmtype": "crossmatch_type", "combotype": "combine"}


@dataclass(frozen=True)
class SubsetSpec:
    """A dataset and up to four optional conditions on it, joined by AND.

    ``invert`` negates the expression, the targeting selection and the flags, each by itself; the
    identifier list stays as it is.  A dataset that is ``None`` is the default of the catalogue.
    """

    name: str = "A"
    dataset: str | None = None
    expression: str = ""
    flags: tuple[str, ...] | None = None
    cartons: tuple[str, ...] = ()
    mappers: tuple[str, ...] = ()
    combine: str = "AND"
    crossmatch: str = ""
    crossmatch_type: str = ""
    computed: tuple[tuple[str, str], ...] = ()
    invert: bool = False
    target_mode: str = "bitwise"

    @staticmethod
    def from_params(params: Mapping[str, str | bool]) -> SubsetSpec:
        """A spec from the texts of a request: lists are separated by commas, no flags unless given."""
        known = {f.name for f in fields(SubsetSpec)} - {"computed"}
        values: dict = {"flags": ()}
        for key, value in params.items():
            name = REQUEST_NAMES.get(key, key)
            if name not in known:
                continue
            if name in LISTS:
                value = tuple(part.strip() for part in str(value).split(",") if part.strip())
            elif name == "expression":
                value = expand_spellings(str(value))
            elif name == "invert":
                value = value if isinstance(value, bool) else str(value).lower() == "true"
            values[name] = value
        return SubsetSpec(**values)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> SubsetSpec:
        values = json.loads(text)
        for name in LISTS:
            if values.get(name) is not None:
                values[name] = tuple(values[name])
        values["computed"] = tuple((n, f) for n, f in values.get("computed", ()))
        return SubsetSpec(**values)

    def with_defaults(self, profile: CatalogProfile, datatype: str = "star") -> SubsetSpec:
        """The spec with the defaults of a catalogue put in."""
        return replace(
            self,
            dataset=self.dataset or profile.default_dataset(datatype),
            flags=profile.default_flags if self.flags is None else self.flags,
            crossmatch_type=self.crossmatch_type or profile.default_identifier,
        )

    def source(self, catalog: Catalog) -> DataFrame:
        """The dataset with its computed columns, before any condition."""
        spec = self.with_defaults(catalog.profile, catalog.datatype)
        return ComputedColumns(spec.computed).apply(catalog.slice(spec.dataset))

    def conditions(
        self, catalog: Catalog, df: DataFrame | None = None, identifiers: DataFrame | None = None
    ) -> dict[str, Column]:
        """The conditions that are set, by kind; ``identifiers`` replaces the list in the spec."""
        spec = self.with_defaults(catalog.profile, catalog.datatype)
        profile = catalog.profile
        df = spec.source(catalog) if df is None else df
        found: dict[str, Column | None] = {
            "expression": condition(df, spec.expression, spec.invert),
            "targeting": None,
            "flags": flag_condition(df, spec.flags, spec.dataset, profile, spec.invert),
            "crossmatch": crossmatch_condition(
                df, spec.crossmatch if identifiers is None else identifiers, spec.crossmatch_type, spec.dataset, profile
            ),
        }
        if spec.cartons or spec.mappers:
            if catalog.mapping is None:
                raise FacetryError("the catalogue has no mapping for a targeting selection")
            found["targeting"] = target_condition(
                catalog.mapping,
                spec.cartons,
                spec.mappers,
                spec.combine,
                spec.invert,
                profile.target_flags,
                profile.target_bytes,
                spec.target_mode,
            )
        return {kind: c for kind, c in found.items() if c is not None}

    def compile(self, catalog: Catalog, identifiers: DataFrame | None = None) -> DataFrame:
        """The rows of the subset, lazily: dataset first, then all conditions at once."""
        df = self.source(catalog)
        conditions = list(self.conditions(catalog, df, identifiers).values())
        return df.where(reduce(and_, conditions)) if conditions else df

    def check(self, catalog: Catalog) -> None:
        """Refuse names of datasets, flags, mappers and cartons the catalogue does not have."""
        spec = self.with_defaults(catalog.profile, catalog.datatype)
        profile = catalog.profile
        require_known(catalog.table, profile.pipeline, [profile.dataset(spec.dataset)], "dataset")
        for flag in spec.flags:
            if flag not in profile.quick_flags:
                raise FacetryError(f"there is no quick flag {flag!r}")
        if catalog.mapping is not None:
            require_known(catalog.mapping, "mapper", list(spec.mappers), "mapper")
            require_known(catalog.mapping, "alt_name", list(spec.cartons), "carton")


@dataclass(frozen=True)
class SubsetCollection:
    """The subsets of a user, by key; names are unique."""

    subsets: tuple[tuple[str, SubsetSpec], ...] = ()

    def to_json(self) -> str:
        return json.dumps({key: json.loads(spec.to_json()) for key, spec in self.subsets})

    @staticmethod
    def from_json(text: str) -> SubsetCollection:
        specs = json.loads(text)
        return SubsetCollection(tuple((key, SubsetSpec.from_json(json.dumps(s))) for key, s in specs.items()))

    def get(self, key: str) -> SubsetSpec:
        return dict(self.subsets)[key]

    @property
    def names(self) -> list[str]:
        return [spec.name for _, spec in self.subsets]

    def _check_name(self, name: str) -> None:
        if not name:
            raise FacetryError("no name given")
        if name in self.names:
            raise FacetryError(f"the name {name!r} exists already")

    def add(self, key: str, spec: SubsetSpec) -> SubsetCollection:
        self._check_name(spec.name)
        return SubsetCollection((*self.subsets, (key, spec)))

    def update(self, key: str, **changes: object) -> SubsetCollection:
        return SubsetCollection(tuple((k, replace(s, **changes) if k == key else s) for k, s in self.subsets))

    def rename(self, key: str, name: str) -> SubsetCollection:
        self._check_name(name)
        return self.update(key, name=name)

    def clone(self, key: str, new_key: str) -> SubsetCollection:
        """A copy under the name ``copy of X``, repeated while that name is taken."""
        spec = self.get(key)
        name = f"copy of {spec.name}"
        while name in self.names:
            name = f"copy of {name}"
        return self.add(new_key, replace(spec, name=name))

    def remove(self, key: str) -> SubsetCollection:
        return SubsetCollection(tuple((k, s) for k, s in self.subsets if k != key))
