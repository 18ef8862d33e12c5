"""Mutation logs: DataFrames (key, op, value, seq), op PUT or DELETE, seq totally ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.shared import table

PUT, DELETE = "PUT", "DELETE"


def key_of(letter: str, number: str, width: int) -> Column:
    return F.concat(F.lit(letter), F.lpad(F.col(number).cast("string"), width, "0"))


def log_lineitem(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    gone = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        key_of("k", "l_orderkey", 8).alias("key"),
        F.when(gone, DELETE).otherwise(PUT).alias("op"),
        F.when(~gone, F.col("l_partkey").cast("string")).alias("value"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
        *extra,
    )


def log_events(events: DataFrame) -> DataFrame:
    gone = F.col("event_type") == "error"
    return events.select(key_of("u", "user_id", 6).alias("key"), F.when(gone, DELETE).otherwise(PUT).alias("op"), F.when(~gone, F.col("props")).alias("value"), F.col("event_id").alias("seq"))


def log_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(key_of("o", "o_orderkey", 9).alias("key"), F.lit(PUT).alias("op"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"))


def valid_puts(log: DataFrame) -> DataFrame:
    """Without PUTs of an empty key, which are refused; DELETEs aren't checked."""
    return log.where((F.col("op") == DELETE) | (F.length("key") > 0))


def puts(rows: DataFrame) -> DataFrame:
    """PUT mutations of (key, value, seq)."""
    return valid_puts(rows.select("key", F.lit(PUT).alias("op"), "value", "seq"))


def deletes(rows: DataFrame) -> DataFrame:
    """DELETE mutations of (key, seq)."""
    return rows.select("key", F.lit(DELETE).alias("op"), F.lit(None).cast("string").alias("value"), "seq")
