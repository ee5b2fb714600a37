"""Errors a user of the engine can act on."""


class FacetryError(ValueError):
    """Base class of all errors raised for wrong user input."""


class ExpressionError(FacetryError):
    """A filter text or a formula cannot be used."""


class CatalogError(FacetryError):
    """A catalogue file, dataset or column does not exist."""


class EmptySubsetError(FacetryError):
    """A subset that must hold rows holds none."""
