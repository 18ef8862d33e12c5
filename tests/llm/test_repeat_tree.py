import hashlib
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidelog.llm import repeat_tree as op


def brute(rows, length=50):
    least = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        if d is not None:
            for k in range(len(t) - length + 1):
                w = t[k : k + length]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        if d is not None:
            for k in range(len(t) - length + 1):
                if least[t[k : k + length]] < d:
                    gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(12)]
    line = "this line stands in very many of the documents, whole and unchanged."
    rows = []
    for d in r.sample(range(10 * n), n):
        parts = []
        for _ in range(r.randint(0, 8)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            parts.append(r.choice([p, p[a:], p[:a], line, " ".join(word() for _ in range(20)), "a" * r.randint(0, 120), "ab" * r.randint(0, 60), "\0" * r.randint(0, 70)]))
        rows.append((d, r.choice(["", " ", "\n"]).join(parts)))
    big = " ".join(word() for _ in range(6000))
    return rows + [(5, rows[3][1]), (99999, rows[3][1]), (99998, big), (99997, big[500:] + "x"), (99996, None), (99995, ""), (None, big), (99994, "x" * 49), (99993, "x" * 50), (99992, "x" * 51), (99998, big), (-3, passages[0])]


@pytest.mark.parametrize("seed,hot,block", [(1, 4096, 4 << 20), (2, 3, 4000), (3, 20, 20000), (4, 10**9, 3000)])
def test_against_brute_force(spark, seed, hot, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_removed int").repartition(3)
    assert sorted(map(tuple, op.deduplicate(df, hot=hot, block=block).collect()), key=str) == brute(rows)


def test_intervals_are_the_maximal_groups():
    r = random.Random(2)
    for _ in range(200):
        s = sorted("".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 9)))
        lcp = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(s, s[1:])]
        got = set(op.intervals(lcp))
        want = set()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                d = min(lcp[i:j])
                up = max([lcp[i - 1] if i else -1, lcp[j] if j < len(lcp) else -1])
                if up < d:
                    want.add((d, up, i, j))
        assert got == want


def test_empty(spark):
    assert op.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed,hot,local", [(5, 4096, 1), (6, 2, 1), (7, 1, 2)])
def test_crowded_grams_against_brute_force(spark, seed, hot, local):
    rows = corpus(seed)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    common = "one passage that stands in a third of all documents, each time before and after other words"
    rows += [(5000 + k, f"{word()} {word()}{common}{word()} {word()} " + " " * r.randint(0, 90) + word()) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, op.deduplicate(df, hot=hot, block=6000, local=local).collect()), key=str) == brute(rows)


def test_units_are_not_shuffled(spark):
    texts = op.units(spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string").repartition(3), 100)
    said = spark.createDataFrame([], "part long, unit long, kind int, data binary")
    both = texts.groupBy("part").cogroup(said.groupBy("part")).applyInPandas(op._cut(False), op.OUT)
    plan = both._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("FileScan") - 400 : plan.index("FileScan")]
    assert "Exchange" not in left and plan.count("Exchange hashpartitioning") == 1 and both.count() == 50
    op.drop(texts)


def test_a_very_long_text(spark):
    r = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(400)]
    long = " ".join(words[k] for k in r.integers(0, 400, 700_000))
    rows = [(1, long), (2, "x" + long[1_000_000:3_000_000] + "y")]
    got = {x["doc_id"]: x for x in op.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["n_bytes"] == len(long)
    assert got[2]["n_spans"] == 1 and got[2]["n_removed"] == 2_000_000


def test_units_come_one_at_a_time(spark, monkeypatch):
    texts = op.units(spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string").repartition(3), 100)
    said = spark.createDataFrame([tuple(r) for r in texts.select("part", "unit").collect()], "part long, unit long")
    seen, cut = [], op.written
    monkeypatch.setattr(op, "written", lambda df, *a: (seen.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, *a))[1])
    got = op.each_unit(texts, said, lambda key, rows, own: pd.DataFrame({"n": [len(rows)], "own": [len(own)]}), "n long, own long", "sizes").collect()
    assert len(got) == texts.count() > 3 and {tuple(r) for r in got} == {(1, 1)}
    left = seen[0][seen[0].index("FileScan") - 400 : seen[0].index("FileScan")]
    assert "Exchange" not in left and seen[0].count("Exchange hashpartitioning") == 1
    op.drop(texts)


def test_a_bucket_takes_little_memory():
    """A bucket whose every leaf is sent, as in a large corpus, is solved a part of its grams at a time."""
    r, rows, n, units = np.random.default_rng(4), [], 4000, 60
    text = r.integers(97, 101, (n, op.LEFT + op.LENGTH), np.uint8)
    for unit in range(units):
        near = text.copy()
        near[np.arange(n), r.integers(0, 20, n)] = 32  # contexts differ, grams don't
        h = np.arange(n, dtype=np.uint64) * 7919
        x = op.Leaves.__new__(op.Leaves)
        x.h, x.doc, x.at = h, np.full(n, unit), np.arange(n) * 84 + op.LEFT
        x.left, x.right = np.full(n, op.LEFT, np.uint8), np.full(n, op.LENGTH, np.uint8)
        rows.append((0, 0, unit, n, op._payload(x, np.append(near.ravel(), np.zeros(84, np.uint8)), np.arange(n))))
    pdf = pd.DataFrame(rows, columns=["bucket", "part", "unit", "n", "data"])
    tracemalloc.start()
    try:
        (out,) = op._buckets(iter([pdf]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(out["unit"]) == list(range(1, units)) and peak < 100e6
