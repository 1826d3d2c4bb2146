"""All registered queries and oracles."""

from __future__ import annotations


def all_queries() -> dict:
    from . import catalog, catalog_models, catalog_more, catalog_trees  # noqa: F401  (registration side effects)
    return dict(catalog.QUERIES)


def all_oracles() -> dict:
    from . import catalog, catalog_models, catalog_more, catalog_trees  # noqa: F401
    return dict(catalog.ORACLES)
