"""Operator 2, embedding near-dedup: an epsilon grid order join.

Unit vectors at cosine c or more are within eps = sqrt(2 - 2c) of one another. Vectors are rotated to
principal axes (of a bounded sample: SAMPLE vectors, AXES bytes at most; any rotation keeps distances, so the
sample decides only how much is skipped), sorted by the eps-wide grid cells of the LEADING axes, and cut into
blocks of BLOCK consecutive vectors with their bounding boxes. Consecutive blocks make a stretch, of up to
STRETCH bytes. The join recurses on intervals of that sequence: a pair of intervals whose boxes are further
apart than eps is skipped, any other is replaced by the pairs of their FAN parts, level by level, as joins of
small tables, down to stretches. A pair of stretches that remains is a tile, and one task's: a block goes
to each of its stretch's tiles, not to every block it may meet. In a tile the recursion goes on in memory, to
blocks and their parts, and what remains is compared by matrix products in single precision; whatever comes
near the threshold is computed again in double precision.

Equal vectors are one class, counted before the join. A tile gives link counts and a spanning forest, never
its pairs, so a third of all vectors in one class, or in one cluster, stays linear in output and within two
stretches in memory. On isotropic data of many dimensions no ordering can prune much (eps is several standard
deviations wide), and the work is quadratic, in blocks.

Defined results: a vector that is null, empty, zero, or has null or non-finite components links with nothing,
as does one with a null vec_id; vectors of different lengths never link. Repeated rows are vectors of their
own; rows that share a vec_id share its component. Extra columns are ignored; an empty table gives no rows.
near_duplicates() leaves its tables to the tidy() function around it, as op2_epsilon_grid is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop, small_batches, table, tidy, written

LEADING, BLOCK, FAN, PART = 6, 1024, 4, 128
SAMPLE, AXES = 4096, 16 << 20
STRETCH = 16 << 20
FEW = 100_000  # halves of tiles that may be broadcast: 3 MB
MARGIN = 1e-4  # far over the rounding of a single-precision product of unit vectors
BLOCKS = "at long, part int, seq int, dim int, lo array<double>, hi array<double>, keys binary, ids binary, copies binary, units binary"


def _units(batches):
    """key, id, dim and the unit vector as doubles; the latter two are null for vectors that can't link."""
    for pdf in batches:
        rows = []
        for i, e in zip(pdf["vec_id"], pdf["embedding"]):
            own = None, None, None
            if e is not None and len(e) and not pd.isna(i):
                x = np.array([np.nan if v is None else v for v in e] if getattr(e, "dtype", object) == object else e, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top  # so that squares neither overflow nor vanish
                    own = len(x), x.tobytes(), (x / np.sqrt((x * x).sum())).tobytes()
            rows.append((i, *own))
        yield pd.DataFrame(rows, columns=["id", "dim", "raw", "unit"]).astype({"id": "Int64", "dim": "Int32"})


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for the commonest length, from the SAMPLE vectors of least hash; other lengths keep their own."""
    found = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if found is None or found["dim"] ** 2 * 8 > AXES:
        return {}
    dim = found["dim"]
    rows = classes.where(F.col("dim") == dim).select("unit").orderBy(F.xxhash64("key"), "key", "unit").limit(min(SAMPLE, AXES // (8 * dim))).collect()
    x = np.frombuffer(b"".join(r["unit"] for r in rows), np.float64).reshape(-1, dim)
    x = x - x.mean(0)
    return {dim: np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()}


def _cells(turn: dict[int, np.ndarray], eps: float):
    def run(batches):
        for pdf in batches:
            cells, units = [None] * len(pdf), [None] * len(pdf)
            for dim, at in pdf.groupby("dim").indices.items():
                x = np.frombuffer(b"".join(pdf["unit"].iloc[at]), np.float64).reshape(len(at), dim)
                y = x @ turn[dim] if dim in turn else x
                c = np.zeros((len(at), LEADING), np.int32)
                c[:, : min(dim, LEADING)] = np.floor(y[:, :LEADING] / eps)
                for k, a in enumerate(at):
                    cells[a], units[a] = c[k].tolist(), y[k].tobytes()
            yield pdf[["key", "id", "copies", "dim"]].assign(cells=cells, unit=units)

    return run


def _pack(most: int):
    def run(batches):
        part, seq, have = TaskContext.get().partitionId(), 0, []

        def block(rows):
            nonlocal seq
            dim = int(rows["dim"].iloc[0])
            x = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), dim)
            seq += 1
            own = [rows[c].to_numpy("int64").tobytes() for c in ("key", "id", "copies")]
            return pd.DataFrame({"part": [part], "seq": [seq - 1], "dim": [dim], "lo": [x.min(0)], "hi": [x.max(0)], "keys": [own[0]], "ids": [own[1]], "copies": [own[2]], "units": [x.tobytes()]})

        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            while len(rest):
                dim = int(rest["dim"].iloc[0])
                same, n = int((rest["dim"] == dim).sum()), max(1, min(most, STRETCH // (16 * dim)))
                if same == len(rest) and same <= n:
                    break
                n = min(n, same)
                yield block(rest.iloc[:n])
                rest = rest.iloc[n:]
        if rest is not None and len(rest):
            yield block(rest)

    return run


def apart(a_lo, a_hi, b_lo, b_hi) -> float:
    """The least squared distance between two boxes."""
    gap = np.maximum(0, np.maximum(a_lo - b_hi, b_lo - a_hi))
    return float((gap * gap).sum())


def _prune(eps: float):
    def run(batches):
        for pdf in batches:
            near = [d == e and apart(*map(np.asarray, v)) <= eps * eps * (1 + 1e-9) for d, e, *v in zip(pdf["d1"], pdf["d2"], pdf["lo1"], pdf["hi1"], pdf["lo2"], pdf["hi2"])]
            yield pdf.loc[near, ["x", "y"]]

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Boxes of neighbours become their parent's; a parent of mixed lengths has dim 0 and is never skipped."""
    dims = set(pdf["dim"])
    if len(dims) == 1 and 0 not in dims:
        box = dims.pop(), np.min(np.stack(pdf["lo"]), 0), np.max(np.stack(pdf["hi"]), 0)
    else:
        box = 0, np.zeros(0), np.zeros(0)
    return pd.DataFrame([(pdf["at"].iloc[0], *box)], columns=["at", "dim", "lo", "hi"])


def _parents(level: DataFrame, fan: int) -> DataFrame:
    up = level.withColumn("at", F.floor(F.col("at") / fan).cast("long"))
    return written(up.groupBy("at").applyInPandas(_merge, "at long, dim int, lo array<double>, hi array<double>"), "intervals")


def interval_pairs(boxes: DataFrame, n: int, eps: float) -> DataFrame:
    """The pairs x <= y of the n numbers in boxes (at, dim, lo, hi) that are not provably further apart than eps."""
    spark, levels = boxes.sparkSession, [boxes]
    while n > FAN:
        levels.append(_parents(levels[-1], FAN))
        n = -(-n // FAN)
    pairs = spark.range(n).select(F.col("id").alias("x"), F.explode(F.sequence("id", F.lit(n - 1))).alias("y")) if n else spark.createDataFrame([], "x long, y long")
    for k in reversed(range(len(levels))):
        if k < len(levels) - 1:
            parts = {c: F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1) for c in ("x", "y")}
            pairs = pairs.select("y", F.explode(parts["x"]).alias("x")).select("x", F.explode(parts["y"]).alias("y")).where("x <= y")
        one, two = (levels[k].select(F.col("at").alias(c), F.col("dim").alias(f"d{i}"), F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}")) for i, c in ((1, "x"), (2, "y")))
        both = pairs.join(one, "x").join(two, "y")
        mixed = (F.col("d1") == 0) | (F.col("d2") == 0)
        pairs = written(both.where(~mixed).mapInPandas(_prune(eps), "x long, y long").union(both.where(mixed).select("x", "y")), "block_pairs")
    return pairs


def linked(a: np.ndarray, b: np.ndarray, least: float, eps: float, part: int = PART) -> np.ndarray:
    """Which rows of a and b have a cosine of at least `least`; parts whose boxes are too far are skipped."""
    out = np.zeros((len(a), len(b)), bool)
    box = lambda x: [(k, x[k : k + part].min(0), x[k : k + part].max(0)) for k in range(0, len(x), part)]
    a32, b32, parts = a.astype(np.float32), b.astype(np.float32), box(b)
    for i, lo, hi in box(a):
        for j, lo2, hi2 in parts:
            if apart(lo, hi, lo2, hi2) > eps * eps * (1 + 1e-9):
                continue
            s = a32[i : i + part] @ b32[j : j + part].T
            sure = s >= least + MARGIN
            x, y = np.nonzero((s >= least - MARGIN) & ~sure)
            if len(x):
                sure[x, y] = np.einsum("ij,ij->i", a[i + x], b[j + y]) >= least
            out[i : i + part, j : j + part] = sure
    return out


def forest(m: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Edges (id, id) with the connectivity of the linked pairs, at most one for each row and column."""
    r, c = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
    m, top = m[np.ix_(r, c)], np.iinfo(np.int64).max
    x, y = rows[r].copy(), cols[c].copy()
    while len(r):
        y2 = np.minimum(y, np.where(m, x[:, None], top).min(0))
        x2 = np.minimum(x, np.where(m, y2[None, :], top).min(1))
        if (x2 == x).all() and (y2 == y).all():
            break
        x, y = x2, y2
    return np.concatenate([np.stack([rows[r], x], 1), np.stack([cols[c], y], 1)])


class _Side:
    """A block of a tile."""

    def __init__(self, r):
        self.keys, self.ids, self.copies = (np.frombuffer(v, np.int64) for v in (r.keys, r.ids, r.copies))
        self.units = np.frombuffer(r.units, np.float64).reshape(len(self.keys), -1)
        self.lo, self.hi = self.units.min(0), self.units.max(0)
        self.links = np.zeros(len(self.keys), np.int64)


def _tile(least: float, eps: float, part: int):
    """Link counts (key, n) and a spanning forest (a, b) of every tile, from its blocks in order, one after another."""

    def pairs_of(x, y, one, two):
        edges = []
        for i, p in enumerate(one):
            for q in one[i:] if x == y else two:
                if p.units.shape[1] != q.units.shape[1] or apart(p.lo, p.hi, q.lo, q.hi) > eps * eps * (1 + 1e-9):
                    continue
                m = linked(p.units, q.units, least, eps, part)
                if p is q:
                    np.fill_diagonal(m, False)
                if m.any():
                    p.links += m @ q.copies
                    if p is not q:
                        q.links += p.copies @ m
                    edges.append(forest(m, p.ids, q.ids))
        e = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        e = e[e[:, 0] != e[:, 1]]
        keys = np.concatenate([np.zeros(0, np.int64), *(b.keys[b.links > 0] for b in (*one, *two))])
        n = np.concatenate([np.zeros(0, np.int64), *(b.links[b.links > 0] for b in (*one, *two))])
        none = np.zeros(len(e), np.int64)
        return pd.DataFrame({"key": np.concatenate([keys, none]), "n": np.concatenate([n, none]), "a": np.concatenate([0 * keys, e[:, 0]]), "b": np.concatenate([0 * keys, e[:, 1]])})

    def run(batches):
        tile, one, two = None, [], []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if tile is not None and tile != (r.x, r.y):
                    yield pairs_of(*tile, one, two)
                    one, two = [], []
                tile = r.x, r.y
                (one if r.stretch == r.x else two).append(_Side(r))
        if tile is not None:
            yield pairs_of(*tile, one, two)

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, block: int = BLOCK, part: int = PART, span: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding); span: blocks of a stretch."""
    spark, eps = vectors.sparkSession, float(np.sqrt(2 - 2 * least))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = vectors.mapInPandas(_units, "id long, dim int, raw binary, unit binary").withColumn("key", F.when(F.col("raw").isNotNull(), F.xxhash64("raw")))
    rows = written(rows.drop("raw"), "units")
    classes = rows.where("unit is not null").groupBy("key", "dim", "unit").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "vectors")
    rows, units = written(rows.select("id", "key"), "rows"), rows
    drop(units)
    turned = classes.mapInPandas(_cells(axes(classes), eps), "key long, id long, copies long, dim int, cells array<int>, unit binary")
    order = ["dim", "cells", "id", "key"]
    packed = written(turned.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_pack(block), BLOCKS.removeprefix("at long, ")), "blocks")
    classes, wide = written(classes.select("key", "id", "copies"), "classes"), classes
    drop(wide)
    per = packed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition written
    per = per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    blocks = packed.join(F.broadcast(per), "part").withColumn("at", F.col("first") + F.col("seq"))  # a row a task
    size = packed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("units")).alias("bytes")).first()
    if span is None:  # enough tiles for all cores, and no more copies of a block than that needs
        wanted = int(np.ceil(np.sqrt(8 * spark.sparkContext.defaultParallelism)))
        span = max(1, min(size["n"] // wanted, int(STRETCH * size["n"] / (size["bytes"] or 1))))
    boxes = written(blocks.select("at", "dim", "lo", "hi"), "boxes")
    tiles = interval_pairs(_parents(boxes, span) if span > 1 else boxes, -(-size["n"] // span), eps)
    halves = tiles.select(F.col("x").alias("stretch"), "x", "y").union(tiles.where("x <> y").select(F.col("y").alias("stretch"), "x", "y"))
    halves = F.broadcast(halves) if halves.count() <= FEW else halves
    sent = blocks.withColumn("stretch", F.floor(F.col("at") / span).cast("long")).join(halves, "stretch")
    sent = sent.select("x", "y", "stretch", "at", "keys", "ids", "copies", "units")
    with small_batches(spark, 4):
        found = written(sent.repartition("x", "y").sortWithinPartitions("x", "y", "at").mapInPandas(_tile(least, eps, part), "key long, n long, a long, b long"), "links")
    drop(packed)
    counts = found.where("n > 0").groupBy("key").agg(F.sum("n").alias("others"))
    several = classes.where("copies > 1")
    comps = components(found.where("n = 0").select("a", "b").union(rows.join(several.select("key", F.col("id").alias("first")), "key").select("id", "first")))
    own = classes.groupBy("key").agg(F.sum("copies").alias("copies")).join(counts, "key", "left")
    of = own.where("copies > 1 or others > 0").select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.join(of, "key", "left").join(comps, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@tidy
def op2_epsilon_grid(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
