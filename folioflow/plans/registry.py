"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.plans import catalog, catalog_text, catalog_markup, catalog_sources, catalog_grids, catalog_books  # noqa: F401, I001  (these register their queries in catalog; grids and books come last, as they build on other twins)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
