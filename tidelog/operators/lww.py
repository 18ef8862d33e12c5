"""Last writer wins: the latest mutation of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, seq: str = "seq") -> DataFrame:
    """key, op, value of the newest mutation. The tombstone flag travels with the value, so a null value of
    a DELETE is never taken for an older PUT's. Filters on key pass below the aggregate to the scan."""
    return log.groupBy("key").agg(F.max_by(F.struct("op", "value"), seq).alias("m")).select("key", "m.op", "m.value")


def latest_by_window(log: DataFrame, seq: str = "seq") -> DataFrame:
    newest = Window.partitionBy("key").orderBy(F.desc(seq))
    return log.withColumn("__r", F.row_number().over(newest)).where("__r = 1").select("key", "op", "value")


def live(log: DataFrame) -> DataFrame:
    """key, value of the keys whose newest mutation is a PUT."""
    return latest(log).where("op = 'PUT'").select("key", "value")


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).where("op = 'DELETE'").select("key")


def resurrected(log: DataFrame) -> DataFrame:
    """Keys with a DELETE before their last PUT."""
    last_put, first_delete = F.max(F.when(F.col("op") == "PUT", F.col("seq"))), F.min(F.when(F.col("op") == "DELETE", F.col("seq")))
    return log.groupBy("key").agg(last_put.alias("p"), first_delete.alias("d")).where("d < p").select("key")


def blind_deletes(log: DataFrame) -> DataFrame:
    """Keys whose first mutation is a DELETE."""
    return log.groupBy("key").agg(F.min_by("op", "seq").alias("op")).where("op = 'DELETE'").select("key")
