import random

import pytest

from tidelog.llm import minhash_join as op


def brute(rows, width, percent):
    sets, up = [], {}
    for d, t in rows:
        w = bytes((t or ""), "utf8").lower().split()
        s = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        sets.append(s)
        up.setdefault(d, d)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and None not in (rows[i][0], rows[j][0]) and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                up[b] = a
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=str)


def corpus(seed, n=300):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(1, 60))] for _ in range(20)]
    rows = []
    for d in range(n):
        w = list(r.choice(base)) if r.random() < 0.7 else [r.choice(words) for _ in range(r.randint(0, 40))]
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            if w:
                w[r.randrange(len(w))] = r.choice(words)
        rows.append((d, " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "É x"), (5004, "é X"), (5005, "É X"), (7, "w1 w2 w3"), (5006, "W1 W2 W3"), (None, "w1 w2 w3"), (3, rows[3][1])]


def got(spark, rows, width, percent=80):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string").repartition(3)
    found = op.near_duplicates(df, width, percent).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rows = corpus(width)
    assert got(spark, rows, width) == brute(rows, width, 80)


@pytest.mark.parametrize("stray,small,group,hubs", [(0, 0, 2, 1), (3, 1 << 17, 5, 2), (1024, 1 << 17, 3, 2)])
def test_large_nodes_and_tiles(spark, monkeypatch, stray, small, group, hubs):
    """With tiny leaves every path runs: stars, strays, branching, tiles, hubs; and both ways to label components."""
    monkeypatch.setattr(op, "GROUP", group)
    monkeypatch.setattr(op, "HUBS", hubs)
    monkeypatch.setattr(op, "LEAF", 4)
    monkeypatch.setattr(op, "STRAY", stray)
    monkeypatch.setattr("tidelog.llm.common.SMALL", small)
    monkeypatch.setattr(op, "DEEPEST", 3)
    r = random.Random(5)
    chain = [[f"c{i}" for i in range(k, k + 40)] for k in range(60)]  # each is near its neighbours only
    rows = corpus(9, 120) + [(900 + k, " ".join(w)) for k, w in enumerate(chain)]
    r.shuffle(rows)
    assert got(spark, rows, 2) == brute(rows, 2, 80)


def test_empty_table(spark):
    assert got(spark, [], 2) == []


def test_a_very_long_text(spark):
    words = [f"v{i}" for i in range(250_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[20_000:])), (3, " ".join(words[:100_000])), (4, "v1 v2 v3")]
    assert got(spark, rows, 5) == [(1, 249_996, 1), (2, 229_996, 1), (3, 99_996, 3), (4, 1, 4)]


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(k % 700, str(k), k) for k in range(1000)] + [(None, "x", 1)], "doc_id long, text string, gone int").repartition(3)
    ids = spark.createDataFrame([(k,) for k in range(0, 700, 3)], "id long")
    want = sorted([(k % 700, str(k), k) for k in range(1000) if k % 700 % 3] + [(None, "x", 1)], key=str)
    for few in (None, 10):
        out = op.without(docs, ids, few)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == want
