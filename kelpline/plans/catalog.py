"""All registered queries of the reference operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelpline.plans import feeds, series, values


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return values.QUERIES | series.QUERIES | feeds.QUERIES


def oracle_sql() -> dict[str, str]:
    return values.SQL | series.SQL | feeds.SQL
