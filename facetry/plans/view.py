"""View specifications: which statistic of a subset is shown, and the DataFrame that holds it."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.errors import FacetryError
from facetry.operators.binning import HEATMAP_BINS, HISTOGRAM_BINS, heatmap, histogram
from facetry.operators.ranges import axis_range, count_axis_range, heatmap_color_range, scatter_color_range
from facetry.operators.summaries import describe, require_rows, require_values
from facetry.operators.tables import PAGE_ROWS, SCATTER_POINTS, page, scatter_points
from facetry.profile import CatalogProfile

# Names of the request parameters that are called differently here.
REQUEST_NAMES = {
    "plottype": "kind",
    "bintype": "statistic",
    "nbins": "bins",
    "logx": "log_x",
    "logy": "log_y",
    "logcolor": "log_color",
    "flipx": "flip_x",
    "flipy": "flip_y",
}
TOGGLES = ("log_x", "log_y", "log_color", "flip_x", "flip_y", "dense")
KINDS = ("histogram", "heatmap", "scatter", "stats", "targets")


@dataclass(frozen=True)
class ViewSpec:
    """One view.  What is ``None`` takes the default of the catalogue or of the kind of view."""

    kind: str
    x: str | None = None
    y: str | None = None
    color: str | None = None
    bins: int | None = None
    statistic: str = "mean"
    log_x: bool = False
    log_y: bool = False
    log_color: bool = False
    flip_x: bool = False
    flip_y: bool = False
    dense: bool = False
    columns: tuple[str, ...] = ()
    page: int = 0
    page_rows: int = PAGE_ROWS
    points: int = SCATTER_POINTS
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise FacetryError(f"a view is one of {', '.join(KINDS)}, not {self.kind!r}")

    @staticmethod
    def from_params(params: Mapping[str, str]) -> ViewSpec:
        """A view from the texts of a request; other parameters are left alone."""
        known = {f.name for f in fields(ViewSpec)} - {"limits"}
        values: dict = {}
        for key, value in params.items():
            name = REQUEST_NAMES.get(key, key)
            if name in TOGGLES:
                values[name] = str(value).lower() == "true"
            elif name in ("bins", "page", "page_rows", "points"):
                values[name] = int(value)
            elif name == "columns":
                values[name] = tuple(part.strip() for part in value.split(",") if part.strip())
            elif name in known:
                values[name] = value
        if "kind" not in values:
            raise FacetryError("the request names no view")
        return ViewSpec(**values)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> ViewSpec:
        values = json.loads(text)
        values["columns"] = tuple(values.get("columns", ()))
        values["limits"] = {name: tuple(ends) for name, ends in values.get("limits", {}).items()}
        return ViewSpec(**values)

    def swapped(self) -> ViewSpec:
        """The view with x and y exchanged."""
        return replace(
            self,
            x=self.y,
            y=self.x,
            log_x=self.log_y,
            log_y=self.log_x,
            flip_x=self.flip_y,
            flip_y=self.flip_x,
        )

    def with_defaults(self, profile: CatalogProfile) -> ViewSpec:
        bins = HISTOGRAM_BINS if self.kind == "histogram" else HEATMAP_BINS
        shown = profile.default_targets if self.kind == "targets" else profile.default_statistics
        return replace(
            self,
            x=self.x or profile.default_x,
            y=self.y or profile.default_y,
            color=self.color or profile.default_color,
            bins=self.bins or bins,
            columns=self.columns or shown,
        )

    def fitted(self, valid: Sequence[str], profile: CatalogProfile) -> ViewSpec:
        """The view for a dataset that has only the ``valid`` columns.

        A missing axis falls back to the default of the catalogue; missing table columns are dropped.
        """
        spec = self.with_defaults(profile)
        return replace(
            spec,
            x=spec.x if spec.x in valid else profile.default_x,
            y=spec.y if spec.y in valid else profile.default_y,
            color=spec.color if spec.color in valid else profile.default_color,
            columns=tuple(c for c in spec.columns if c in valid),
        )

    def compile(self, df: DataFrame, profile: CatalogProfile, require: bool = False) -> DataFrame:
        """The data of the view over the rows of a subset.

        With ``require`` a plot of a subset without rows, or of cells without any value, is an error at once.
        """
        if require and self.kind in ("histogram", "heatmap", "scatter"):
            cells = self.compile(require_rows(df), profile)
            return require_values(cells) if self.kind == "heatmap" else cells
        spec = self.with_defaults(profile)
        if spec.kind == "histogram":
            return histogram(df, spec.x, spec.bins, spec.limits.get(spec.x), dense=spec.dense)
        if spec.kind == "heatmap":
            return heatmap(
                df,
                spec.x,
                spec.y,
                None if spec.statistic == "count" else spec.color,
                spec.statistic,
                spec.bins,
                spec.limits,
                dense=spec.dense,
                log=spec.log_color,
            )
        if spec.kind == "scatter":
            return scatter_points(df, spec.x, spec.y, spec.color, profile.row_key, spec.log_color, spec.points)
        if spec.kind == "stats":
            return describe(df, spec.columns)
        return page(df, profile.row_key, spec.page, spec.page_rows, spec.columns)

    def ranges(self, df: DataFrame, profile: CatalogProfile) -> DataFrame:
        """``(axis, start, end)`` of the axes of a plot and of its colours, padded and flipped as it is drawn."""
        spec = self.with_defaults(profile)
        if spec.kind not in ("histogram", "heatmap", "scatter"):
            raise FacetryError(f"a {spec.kind} view has no axes")
        x = axis_range(df, spec.x, spec.kind, spec.log_x, spec.flip_x)
        if spec.kind == "histogram":
            return _named("x", x).unionAll(_named("y", count_axis_range(spec.compile(df, profile), spec.log_y)))
        y = axis_range(df, spec.y, spec.kind, spec.log_y, spec.flip_y)
        if spec.kind == "heatmap":
            color = heatmap_color_range(spec.compile(df, profile), spec.statistic, spec.log_color)
        else:
            color = scatter_color_range(df, spec.color, spec.log_color)
        color = color.withColumnsRenamed({"low": "start", "high": "end"})
        return _named("x", x).unionAll(_named("y", y)).unionAll(_named("color", color))


def _named(axis: str, ends: DataFrame) -> DataFrame:
    return ends.select(F.lit(axis).alias("axis"), "start", "end")
