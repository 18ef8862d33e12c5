import zlib

import numpy as np

from tidelog.llm import quality_rules as op

DATA = "/root/testdata/sf0.01"


def test_compiled_rules_equal_the_matrix(spark):
    r = np.random.default_rng(0)
    x = r.random((500, len(op.NAMES)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] < 0.7)).astype(float)
    model = op.fit_rows(x, y)
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{n} double" for n in op.NAMES))
    got = np.array([v["s"] for v in df.select(op.compiled(model).alias("s")).collect()])
    z = model["bias"] + op.holds([rule for _, rule in model["rules"]], x) @ np.array([w for w, _ in model["rules"]])
    assert np.abs(got - 1 / (1 + np.exp(-z))).max() < 1e-5
    assert ((got >= 0.5) == y).mean() > 0.97 and 0 < len(model["rules"]) < 200


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in op.op7_quality_rules(spark, DATA).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())
    labels = [r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in labels]) > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "a b", 1.0), (4, "w " * 50000, 1.0), (1, None, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = op.score(docs, op.fit(docs, labels), ["doc_id"]).collect()
    assert [r["score"] for r in rows] == [0.5] * 5 and [r["predicted"] for r in rows] == [1] * 5
    one = spark.createDataFrame([(4, 0), (2, None), (7, 1)], "doc_id long, quality int")
    assert {round(r["score"], 6) for r in op.score(docs, op.fit(docs, one), ["doc_id"]).collect()} == {round(1 / 3, 6)}
    assert op.score(docs.limit(0), op.fit(docs.limit(0), labels), ["doc_id"]).count() == 0


def test_statistics_against_plain_code():
    import math
    import random

    def plain(t):
        t = t or ""
        n = lambda f: sum(1 for c in t if f(c))
        over = lambda a, b: a / b if b else 0.0
        words, lines = t.split(), t.split("\n")
        w = len(words)
        return (math.log(1 + len(t)), over(n(str.isalpha), len(t)), over(n(str.isupper), n(str.isalpha)), over(n(lambda c: c in "0123456789"), len(t)), over(n(lambda c: c in "#$%&*@^~<>{}[]\\_+="), w), over(t.count("|"), w), over(t.count("!") + t.count("?"), w), over(n(lambda c: c in ".,;:"), w), over(len(t) - w, w), over(len({*words}), w), over(len({*lines}), len(lines)), over(w, len(lines)))

    r = random.Random(4)
    for text in [None, "", " ", "\n", *("".join(r.choice("aBé ñ1|!?.,#_ \n\t日😀ǅ²") for _ in range(r.randrange(200))) for _ in range(300))]:
        assert np.allclose(op.measure(text), plain(text), rtol=0, atol=1e-12), text


def test_a_tree_splits_where_the_gain_is_greatest(monkeypatch):
    """One tree, against sums over every row for every threshold of every statistic that it may look at."""
    monkeypatch.setattr(op, "TREES", 1)
    monkeypatch.setattr(op, "BINS", 8)
    for seed in range(4):
        r = np.random.default_rng(seed)
        x = np.round(r.random((120, 5)), 1)
        y = (r.random(120) < 0.2 + 0.6 * (x[:, seed] > 0.5)).astype(float)
        rules = set(op.grow(x, y))
        dice = np.random.default_rng(op.SEED)
        p = y.mean()
        g, h = y - 1 / (1 + np.exp(-np.log((p + 1e-9) / (1 - p + 1e-9)))), p * (1 - p) + 1e-6
        work, want = [(sorted(dice.choice(120, 60, replace=False)), ())], set()
        while work:
            own, path = work.pop()
            best, found = 1e-3, None
            gain = lambda rows: sum(g[i] for i in rows) ** 2 / (len(rows) * h + 1)
            if len(path) < op.DEPTH and len(own) >= 20:
                for j in sorted(dice.choice(5, 3, replace=False)):
                    for cut in sorted(set(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1]))):
                        sides = [[i for i in own if x[i, j] <= cut], [i for i in own if x[i, j] > cut]]
                        value = gain(sides[0]) + gain(sides[1]) - gain(own)
                        if value > best + 1e-12:
                            best, found = value, (int(j), float(cut), sides)
            if found:
                for over in (False, True):
                    step = tuple(sorted({*path, (found[0], over, found[1])}))
                    want.add(step)
                    work.append((found[2][over], step))
        assert rules == want and rules


def test_lasso_is_at_its_optimum():
    r = np.random.default_rng(1)
    m = (r.random((400, 30)) < 0.4).astype(np.float32)
    y = (r.random(400) < 1 / (1 + np.exp(-(2 * m[:, 0] - 3 * m[:, 1])))).astype(float)
    for penalty in (0.02, 0.005):
        w, b = op.lasso(m, y, penalty, steps=4000)
        e = (1 / (1 + np.exp(-(m @ w + b))) - y) / len(y)
        slope = m.T @ e
        assert abs(e.sum()) < 1e-3 and (np.abs(slope[w == 0]) <= penalty + 1e-3).all()
        assert np.abs(slope[w != 0] + penalty * np.sign(w[w != 0])).max() < 1e-3
        assert 2 <= (w != 0).sum() < 30


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "A text.", 5.0, 1, 2, "z")], "doc_id long, text string, log_chars double, stats int, value int, `__text` string")
    keep = [c for c in docs.columns if c != "text"]
    model = {"bias": 0.0, "rules": [(1.0, ((0, True, 100.0),))]}
    assert [tuple(r) for r in op.score(docs, model, keep).collect()] == [(1, 5.0, 1, 2, "z", 0.5, 1)]
