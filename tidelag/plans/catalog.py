"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelag.plans import edm, problems


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**edm.QUERIES, **{f.__name__: f for f in (problems.p2_found, problems.p3_found, problems.p3_observed, problems.p3_series)}}


def oracle_sql() -> dict[str, str]:
    return {**edm.ORACLE, **problems.ORACLE}
