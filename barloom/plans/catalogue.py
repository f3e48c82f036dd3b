"""Every registered query, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import briefings, clusters, desk, happenings, more, narratives, prices, reports, shapes, studies, trading

_PARTS = (prices, happenings, studies, trading, shapes, desk, more, reports, clusters, narratives, briefings)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, means, crosses, next-open entries, forward returns and their statistics, end to end."""
    return studies.sma_cross_study(spark, sf_dir)
