"""The registered queries of the screening engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import chain, changes, flows, limits, locks, reviews, screening

    return {f.__name__: f for plan in (screening, reviews, limits, changes, locks, flows, chain) for f in plan.QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import chain, changes, flows, limits, locks, reviews, screening

    return {k: v for plan in (screening, reviews, limits, changes, locks, flows, chain) for k, v in plan.SQL.items()}
