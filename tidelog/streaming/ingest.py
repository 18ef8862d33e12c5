"""Structured Streaming over mutation logs."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.engine import Engine


def into(engine: Engine, log: DataFrame, name: str, checkpoint: str, **trigger) -> object:
    """Start a query that turns each micro-batch of a streaming log into a run, exactly once.

    Batch ids are those of the checkpoint, so they are kept by its id: with a new checkpoint, which counts anew, the
    stream is a new one. The checkpoint must not lie in the engine's folder."""
    if checkpoint.rstrip("/").startswith(engine.path + "/"):
        raise ValueError("keep a stream's checkpoint outside the table")
    began, query = threading.Event(), []

    def step(batch: DataFrame, i: int) -> None:
        began.wait()
        engine.ingest(batch, f"{name}/{query[0].id}", i)

    writer = log.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    query.append(writer.foreachBatch(step).trigger(**(trigger or {"availableNow": True})).start())
    began.set()
    return query[0]


def latest_state(log: DataFrame) -> DataFrame:
    """The running newest mutation of each key of a streaming log, for complete output mode.

    State is a row a key: tombstones stay in it, as no bound on late mutations is given."""
    return log.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("m")).select("key", "m.op", "m.value")
