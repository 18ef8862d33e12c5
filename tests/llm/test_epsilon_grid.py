import numpy as np
import pytest

from tidelog.llm import epsilon_grid as op


def brute(rows, least):
    ok, up = [], {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, e in rows:
        x = None if e is None or any(v is None for v in e) or not len(e) else np.array(e, float)
        ok.append(None if i is None or x is None or not np.isfinite(x).all() or not x.any() else x / np.linalg.norm(x))
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] is not None and ok[b] is not None and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= least:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                up[y] = x
    return sorted(((i, n, None if i is None else find(i)) for (i, _), n in zip(rows, links)), key=str)


def data(n=400, dim=12):
    r = np.random.default_rng(4)
    base = r.normal(size=(25, dim))
    rows = [(i, [float(np.float32(v)) for v in (base[r.integers(25)] + r.normal(size=dim) * r.choice([0.1, 0.25, 2]))]) for i in range(n)]
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(30)] + [(2000, None), (2001, []), (2002, [0.0] * dim), (2003, [1.0, None] * 6), (2004, [float("nan")] * dim), (2005, [float("inf")] + [0.0] * (dim - 1)), (2006, [1.0, 0.0]), (2007, [2.0, 0.1]), (5, same), (None, same), (2008, [v * 1e30 for v in rows[7][1]])]
    return rows


@pytest.mark.parametrize("block,part", [(1024, 128), (16, 4)])
def test_against_brute_force(spark, block, part):
    rows = data()
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<double>, component_id int").repartition(3)
    found = op.near_duplicates(df, block=block, part=part).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=str) == brute(rows, 0.9)


def test_empty(spark):
    assert op.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_far_blocks_are_skipped(spark, monkeypatch):
    r = np.random.default_rng(0)
    corners = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0], [0, -1, 0], [0, 0, -1]], float)
    x = np.repeat(corners, 64, 0) + r.normal(size=(384, 3)) * 0.02
    seen = []
    real = op.written
    monkeypatch.setattr(op, "written", lambda df, name: seen.append((name, out := real(df, name))) or out)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = op.near_duplicates(df, block=16).collect()
    assert {r["component_id"] for r in found} == {64 * k for k in range(6)} and all(r["n_links"] == 63 for r in found)
    pairs = [d for n, d in seen if n == "block_pairs"][-1].count()
    assert pairs < 24 * 25 // 2 / 2


@pytest.mark.parametrize("span", [None, 1, 3])
def test_planted_links_among_many(spark, span):
    """4,000 vectors of 64 dimensions with planted links on both sides of the threshold, against one matrix product."""
    r = np.random.default_rng(12)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 1500, 3):  # k + 1 and k + 2 at cosines from 0.85 to 0.95 of k
        for j, c in ((1, r.uniform(0.85, 0.95)), (2, 0.9 + r.choice([-1, 1]) * 1e-9)):
            y = r.normal(size=64)
            y -= (y @ x[k]) * x[k]
            x[k + j] = c * x[k] + (1 - c * c) ** 0.5 * y / np.linalg.norm(y)
    x[2000:2600] = x[1999] + r.normal(size=(600, 64)) * 0.02  # a cluster
    x *= r.uniform(0.1, 10, (4000, 1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    up = list(range(4000))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(near))):
        p, q = sorted((find(a), find(b)))
        up[q] = p
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {q["vec_id"]: (q["n_links"], q["component_id"]) for q in op.near_duplicates(df, block=128, span=span).collect()}
    assert got == {i: (int(near[i].sum()), find(i)) for i in range(4000)}


def test_share_that_is_skipped(spark):
    """On clustered data most pairs of stretches are skipped, level by level."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 50, 0) + r.normal(size=(2000, 16)) * 0.01
    units = spark.createDataFrame([(i, i, 1, 16, [int(c) for c in np.floor(v[:6] / 0.45)], v.tobytes()) for i, v in enumerate(x)], "key long, id long, copies long, dim int, cells array<int>, unit binary")
    packed = units.repartitionByRange(4, "cells", "id").sortWithinPartitions("cells", "id").mapInPandas(op._pack(25), op.BLOCKS.removeprefix("at long, "))
    boxes = packed.selectExpr("row_number() over (order by part, seq) - 1L as at", "dim", "lo", "hi").selectExpr("cast(at as long) at", "dim", "lo", "hi")
    n = boxes.count()
    left = op.interval_pairs(op.written(boxes, "boxes"), n, 0.447).count()
    assert left < 0.3 * n * (n + 1) / 2
