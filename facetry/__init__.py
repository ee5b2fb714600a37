"""Subsets, cross-filtering and binned statistics of one wide catalogue, on Spark."""

from facetry.plans.request import run_request
from facetry.plans.subset import SubsetSpec
from facetry.plans.view import ViewSpec
from facetry.profile import CatalogProfile
from facetry.session import get_session
from facetry.sources.catalog import Catalog, CatalogPaths

__all__ = [
    "Catalog",
    "CatalogPaths",
    "CatalogProfile",
    "SubsetSpec",
    "ViewSpec",
    "get_session",
    "run_request",
]
