"""Reads of a table (key, value) of live keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(start: str, end: str, key: str = "key") -> Column:
    """start <= key < end, in byte order."""
    return (F.col(key) >= start) & (F.col(key) < end)


def overlaps(start: str, end: str) -> Column:
    """Whether [min_key, max_key] meets [start, end)."""
    return (F.col("max_key") >= start) & (F.col("min_key") < end)


def status(value: str = "value") -> Column:
    """404 for missing and, as both are read as one, for empty values; else 200."""
    return F.when(F.coalesce(F.col(value), F.lit("")) == "", 404).otherwise(200)


def get(live: DataFrame, key: str) -> DataFrame:
    """key, value, status: one row if the key is live."""
    return live.where(F.col("key") == key).withColumn("status", status())


def multi_get(live: DataFrame, probes: DataFrame) -> DataFrame:
    """key, value, status for each row of probes (key). Spark broadcasts the side it measures as small."""
    return probes.select("key").join(live, "key", "left").withColumn("status", status())


def scan(live: DataFrame, start: str, end: str) -> DataFrame:
    """Live keys in [start, end), ascending; an empty or inverted range has none. Empty values are listed."""
    return live.where(in_range(start, end)).select("key").orderBy("key")


def count_live(live: DataFrame) -> DataFrame:
    return live.agg(F.count(F.lit(1)).alias("n_live"))
