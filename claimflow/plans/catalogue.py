"""Registered queries over the star-schema tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import frames_queries, score_queries, stream_queries, text_queries  # noqa: F401
from .inputs import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows flagged by their activity, merged into segments, recentred on the first maximum."""
    return frames_queries.recenter_argmax(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
