"""Replay traces: PUT k v, GET k v, DELETE k, SCAN s e k1,k2,...; other lines are INVALID."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.shared import floor_lookup, ranked, written

# The grammar, tried in this order.
SCAN_LINE = r"SCAN (\S+) (\S+) (\S+)"
PAIR_LINE = r"(PUT|GET) (.+) (.+)"
DELETE_LINE = r"DELETE (.+)"
MISSING = "NOT_FOUND"


def parse(lines: DataFrame) -> DataFrame:
    """line_no, method, key, end_key, value of (line_no, line). NOT_FOUND stands for an empty value."""
    part = lambda pattern, k: F.regexp_extract("line", pattern, k)
    scan, pair, gone = (F.col("line").rlike(p) for p in (SCAN_LINE, PAIR_LINE, DELETE_LINE))
    value = F.when(scan, part(SCAN_LINE, 3)).when(pair, part(PAIR_LINE, 3))
    return lines.select(
        "line_no",
        F.when(scan, "SCAN").when(pair, part(PAIR_LINE, 1)).when(gone, "DELETE").otherwise("INVALID").alias("method"),
        F.when(scan, part(SCAN_LINE, 1)).when(pair, part(PAIR_LINE, 2)).when(gone, part(DELETE_LINE, 1)).alias("key"),
        F.when(scan, part(SCAN_LINE, 2)).alias("end_key"),
        F.when(value == MISSING, "").otherwise(value).alias("value"),
    )


def expected_keys(value: str = "value"):
    """The keys that a SCAN expects."""
    return F.transform(F.split(F.col(value), ","), lambda k: F.trim(k))


def replay_gets(trace: DataFrame) -> DataFrame:
    """line_no, key, expected, actual, ok of every GET, against the newest earlier mutation of its key.

    One pass: a window a key, ordered by line, carries the last mutation to each GET."""
    at = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("method").isin("PUT", "DELETE"), F.struct("method", "value"))
    rows = trace.where(F.col("method").isin("PUT", "DELETE", "GET")).withColumn("m", F.last(change, ignorenulls=True).over(at))
    actual = F.when(F.col("m.method") == "PUT", F.col("m.value")).otherwise("")
    rows = rows.where("method = 'GET'").select("line_no", "key", F.coalesce("value", F.lit("")).alias("expected"), F.coalesce(actual, F.lit("")).alias("actual"))
    return rows.withColumn("ok", F.col("expected") == F.col("actual"))


def replay_writes(trace: DataFrame) -> DataFrame:
    """line_no, method, status of every PUT and DELETE: a PUT of an empty key is refused."""
    status = F.when((F.col("method") == "PUT") & (F.length("key") == 0), 400).otherwise(200)
    return trace.where(F.col("method").isin("PUT", "DELETE")).select("line_no", "method", status.alias("status"))


STRIPE = 256  # keys


def replay_scans(trace: DataFrame) -> DataFrame:
    """line_no, expected, actual, ok of every SCAN: the live keys of its range at that line, ascending, as a list.

    The time from a PUT to the key's next mutation is an interval of lines. Keys are cut into stripes of STRIPE
    neighbours; a scan meets the intervals of the stripes that its range touches, by a join on the stripe."""
    changes = trace.where(F.col("method").isin("PUT", "DELETE"))
    spans = changes.withColumn("until", F.lead("line_no").over(Window.partitionBy("key").orderBy("line_no"))).where("method = 'PUT'")
    keys = written(ranked(spans.select("key").distinct(), F.col("key")), "keys")
    scans = trace.where("method = 'SCAN'").select("line_no", "key", "end_key", "value")
    ends = floor_lookup(scans.select("key").union(scans.select("end_key")).distinct(), keys.select("key"), "near")
    place = ends.join(keys.withColumnRenamed("key", "near"), "near", "left").select("key", F.floor((F.coalesce("rn", F.lit(1)) - 1) / STRIPE).alias("stripe"))
    place = written(place, "ends")
    first, last = place.select("key", F.col("stripe").alias("a")), place.select(F.col("key").alias("end_key"), F.col("stripe").alias("b"))
    near = scans.join(first, "key").join(last, "end_key").where("key < end_key and a <= b")
    near = near.select(F.col("line_no").alias("at"), F.col("key").alias("lo"), F.col("end_key").alias("hi"), F.explode(F.sequence("a", "b")).alias("stripe"))
    held = spans.join(keys, "key").select("key", "line_no", "until", F.floor((F.col("rn") - 1) / STRIPE).alias("stripe"))
    met = near.join(held, "stripe").where("key >= lo and key < hi and line_no < at and (until is null or until > at)")
    found = met.groupBy(F.col("at").alias("line_no")).agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("actual"))
    rows = scans.join(found, "line_no", "left").select("line_no", F.array_join(expected_keys(), ",").alias("expected"), F.coalesce("actual", F.lit("")).alias("actual"))
    return rows.withColumn("ok", (F.col("actual") != "") & (F.col("expected") == F.col("actual")))


def verb_stats(calls: DataFrame) -> DataFrame:
    """method, n, retries, avg_us of (method, retries, us)."""
    return calls.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("retries").alias("retries"), F.avg("us").alias("avg_us"))
