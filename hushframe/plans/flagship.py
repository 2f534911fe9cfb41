"""The flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import QUERIES


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Every document sanitised."""
    return QUERIES["sanitize"](spark, folder)
