"""One request: a subset and a view of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from facetry.operators.crossfilter import CrossFilter
from facetry.plans.subset import SubsetSpec
from facetry.plans.view import ViewSpec
from facetry.sources.catalog import Catalog


def run_request(
    catalog: Catalog,
    subset: SubsetSpec,
    view: ViewSpec,
    selections: CrossFilter | None = None,
    view_key: str | None = None,
    identifiers: DataFrame | None = None,
    require: bool = False,
) -> DataFrame:
    """The data of a view over a subset, restricted by the selections of the other views.

    With ``require`` a plot without data is an error, as users see it.
    """
    rows = subset.compile(catalog, identifiers)
    if selections is not None:
        rows = selections.frame_for(rows, view_key)
    return view.compile(rows, catalog.profile, require)


def run_params(catalog: Catalog, params: Mapping[str, str], require: bool = False) -> DataFrame:
    """The view of a subset that the texts of one request ask for, after a check of all names."""
    subset, view = SubsetSpec.from_params(params), ViewSpec.from_params(params)
    subset.check(catalog)
    spec = subset.with_defaults(catalog.profile, catalog.datatype)
    valid = catalog.allowed_columns(spec.dataset) + [name for name, _ in spec.computed]
    return view.fitted(valid, catalog.profile).compile(subset.compile(catalog), catalog.profile, require)
