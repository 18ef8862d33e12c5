"""Runs: sorted slices of a log with one row a key, their splits, indexes and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.codec import SPLIT, STRIDE, run_line
from tidelog.plans.shared import floor_lookup, ranked


def flush_runs(log: DataFrame, n: int) -> DataFrame:
    """run, key, op, value: each n consecutive mutations are one run, newest a key, tombstones kept."""
    cut = ranked(log, F.col("seq"), without=("seq",)).withColumn("run", F.floor((F.col("rn") - 1) / n).cast("long"))
    newest = cut.groupBy("run", "key").agg(F.max_by(F.struct("op", "value"), "rn").alias("m"))
    return newest.select("run", "key", "m.op", "m.value")


def merge_runs(runs: DataFrame, newest_first: str = "run") -> DataFrame:
    """key, op, value: the newest run that mentions a key decides, tombstones included."""
    return runs.groupBy("key").agg(F.max_by(F.struct("op", "value"), newest_first).alias("m")).select("key", "m.op", "m.value")


def split(rows: DataFrame, size: int = SPLIT) -> DataFrame:
    """file, min_key, max_key, n: consecutive keys cut into files of `size` rows."""
    cut = ranked(rows.select("key"), F.col("key")).withColumn("file", F.floor((F.col("rn") - 1) / size).cast("long"))
    return cut.groupBy("file").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n"))


def files_of(keys: DataFrame, files: DataFrame) -> DataFrame:
    """key, file: the one file of a level whose range may hold the key; none for other keys."""
    near = floor_lookup(keys.select("key"), files.select(F.col("min_key").alias("key")), "min_key")
    return near.join(files, "min_key").where("key <= max_key").select("key", "file")


def overlapping(files: DataFrame) -> DataFrame:
    """Neighbours (file, next_file) by least key whose ranges overlap. A sound level has none, and any unsound one has some,
    but this is no list of all pairs: a file may also meet others behind its neighbour."""
    pairs = ranked(files, F.col("min_key"), F.col("max_key"), F.col("file"))
    after = pairs.select((F.col("rn") - 1).alias("rn"), F.col("file").alias("next_file"), F.col("min_key").alias("next_min"))
    return pairs.join(after, "rn").where("next_min <= max_key").select("file", "next_file")


def sparse_index(rows: DataFrame, stride: int = STRIDE) -> DataFrame:
    """rn, key of every stride-th key, from the first."""
    return ranked(rows.select("key"), F.col("key")).where((F.col("rn") - 1) % stride == 0).select("rn", "key")


def sparse_offsets(runs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """run, key, file_offset of every stride-th line of each run's JSON-lines file."""
    own = Window.partitionBy("run").orderBy("key")
    size = F.octet_length(run_line()).cast("long") + 1
    rows = runs.withColumn("__rn", F.row_number().over(own)).withColumn("file_offset", F.coalesce(F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return rows.where((F.col("__rn") - 1) % stride == 0).select("run", "key", "file_offset")
