"""Shared plumbing: tables in the shared folder, names, and distributed connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.shared import drop, settings, shared_dir, small_batches, table, tidy, written

__all__ = ["Forest", "components", "drop", "free", "held_out", "partitions", "settings", "shared_dir", "small_batches", "table", "tidy", "whole", "written"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened as far as needed to differ from all columns of df, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def held_out():
    """crc32(doc_id as text) mod 3 is 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Forest:
    """Union-find on arbitrary ids; the smallest id is the root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up, root = self.up, x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.up[y] = x
        self.up.setdefault(x, x)
        return True


def _contract(batches):
    """Replace each batch of edges by stars with the same connectivity."""
    for pdf in batches:
        f = Forest()
        for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            f.join(x, y)
        ids = [(x, f.find(x)) for x in f.up]
        ids = [(x, r) for x, r in ids if x != r]
        yield pd.DataFrame({"a": np.array([x for x, _ in ids], "int64"), "b": np.array([r for _, r in ids], "int64")})


SMALL = 1 << 17  # edges that one task may hold: 2 MB


def _stars(batches):
    """All edges at once, as (id, root) stars."""
    f = Forest()
    for pdf in batches:
        for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            f.join(x, y)
    ids = [(x, f.find(x)) for x in list(f.up)]
    yield pd.DataFrame({"a": np.array([x for x, r in ids if x != r], "int64"), "b": np.array([r for x, r in ids if x != r], "int64")})


@tidy
def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (a, b); component is the smallest id reachable.

    Alternating large-star and small-star steps on the edge table, after contracting each partition's
    edges with a local union-find; up to SMALL contracted edges are finished by one task. Hubs meet in joins
    that AQE can split, never in one group. Null ends and loops are ignored; repeated edges change nothing; no
    edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    cur = written(pairs.mapInPandas(_contract, "a long, b long").distinct(), "edges")
    state = None
    if cur.count() <= SMALL:
        old, cur = cur, written(cur.coalesce(1).mapInPandas(_stars, "a long, b long"), "edges")
        drop(old)
        state = "done"
    while state != "done":
        now = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        new = written(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct(), "edges")
        drop(cur)
        cur = new
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).union(cur.select("b", "b")).distinct()


def whole(key: str, f):
    """f over batches that never split the rows of a key, for rows sorted by it."""

    def run(batches):
        def cut():
            rest = None
            for pdf in batches:
                rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                if len(rest):
                    at = rest[key].to_numpy()
                    n = int((at != at[-1]).nonzero()[0].max(initial=-1)) + 1
                    yield rest.iloc[:n]
                    rest = rest.iloc[n:]
            if rest is not None:
                yield rest

        yield from f(x for x in cut() if len(x))

    return run
