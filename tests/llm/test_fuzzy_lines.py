import hashlib
import random

import pytest

from tidelog.llm import fuzzy_lines as op


def sets(line):
    return {line[k : k + 5] for k in range(max(1, len(line) - 4))}


def brute(rows):
    places = sorted({(d, k, x) for d, t in rows if d is not None and t for k, x in enumerate(t.split("\n")) if x.strip()})
    lines = sorted({x for _, _, x in places})
    up = {x: x for x in lines}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    s = {x: sets(x) for x in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                up[find(a)] = find(b)
    best = {}
    for d, k, x in places:
        best.setdefault(find(x), (d, k))
    out = []
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(lines) if d is None or not x.strip() or best[find(x)] == (d, k)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: " ".join("".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8))) for _ in range(n))
    base = [text(r.randint(4, 30)) for _ in range(30)] + ["Les.", "a", "ab"]
    rows = []
    for d in r.sample(range(500), 120):
        lines = []
        for _ in range(r.randint(0, 8)):
            x = list(r.choice(base)) if r.random() < 0.7 else list(text(6))
            for _ in range(r.choice([0, 0, 1, 2])):
                x[r.randrange(len(x))] = r.choice("xyz")
            lines.append("".join(x))
        rows.append((d, "\n".join(lines)))
    wide = text(3000)
    return rows + [(900, None), (901, ""), (902, " \n\n"), (None, rows[0][1]), (903, wide + "\n" + base[0] + "\n" + base[0]), (904, wide + "!"), (7, rows[1][1]), (rows[2][0], rows[2][1])]


@pytest.mark.parametrize("leaf,block", [(256, 4 << 20), (3, 3000)])
def test_against_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(op, "LEAF", leaf)
    monkeypatch.setattr("tidelog.llm.minhash_join.LEAF", leaf)
    rows = corpus(leaf)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, line string").repartition(3)
    assert sorted(map(tuple, op.deduplicate(df, with_text=True, block=block).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert op.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_agree_as_sets_do():
    """A bin of two sets' sketches is equal with probability their similarity, whatever their size."""
    import numpy as np

    r = np.random.default_rng(2)
    for n in (5, 30, 200, 1500):
        rate = []
        for _ in range(40):
            h = r.integers(0, 1 << 32, n + n // 5, dtype=np.uint32)
            a, b = h[: n + n // 10], np.concatenate([h[: n - n // 10], h[n + n // 10 :]])
            both = op.sketch(np.concatenate([a, b, b[::-1]]), np.repeat([0, 1, 2], [len(a), len(b), len(b)]), 3)
            assert (both[1] == both[2]).all()
            rate.append((both[0] == both[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(rate)) < 0.03


def test_recall_of_bands():
    r = random.Random(3)
    lines = []
    for _ in range(600):
        x = [r.choice("abcdefgh ") for _ in range(r.choice([60, 150, 400]))]
        y = list(x)
        while len(sets("".join(x)) & sets("".join(y))) > 0.82 * len(sets("".join(x)) | sets("".join(y))):
            y[r.randrange(len(y))] = r.choice("xyz")
        if len(sets("".join(x)) & sets("".join(y))) >= 0.8 * len(sets("".join(x)) | sets("".join(y))):
            lines += ["".join(x), "".join(y)]
    keys = op.bands(lines)
    shared = [len({*a.tolist()} & {*b.tolist()}) for a, b in zip(keys[::2], keys[1::2])]
    assert len(shared) > 200 and sum(n > 0 for n in shared) >= 0.995 * len(shared)
    far = [len({*a.tolist()} & {*b.tolist()}) for a, b in zip(keys[:-2], keys[2:])]
    assert sum(far[::2]) <= 2
    n, s1, s2 = next(op.described([lines[0]]))
    assert n == len(op.shingles(lines[0]))


def test_a_very_long_line_and_a_very_common_one(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2_000_000))
    rows = [(1, long + "\nsame line in all of them"), (2, long[:-50_000]), (3, long[: 1_000_000])] + [(10 + k, "same line in all of them\nsame line in all of them!") for k in range(200)]
    got = {x["doc_id"]: x["n_removed"] for x in op.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, **{10 + k: 2 for k in range(200)}}


def test_bands_with_the_same_members_are_compared_once(spark, monkeypatch):
    seen, small = [], op._small
    monkeypatch.setattr(op, "_small", lambda members, percent: (seen.append(members.count()), small(members, percent))[1])
    lines = [f"line {k} of the text, with some words of its own: {hashlib.sha256(bytes([k])).hexdigest()}" for k in range(6)]
    text = [x + end for x in lines for end in ("", " a")]
    text += ["ab", "abc"]
    n, s1, s2 = zip(*op.described(text))
    rows = [(k, n[k], s1[k], s2[k], keys.view("<i8").tolist(), text[k]) for k, keys in enumerate(op.bands(text))]
    got = op.line_components(spark.createDataFrame(rows, "id long, n int, s1 long, s2 long, keys array<long>, text string"), 80)
    assert sorted(map(tuple, got.collect())) == sorted((k, k - k % 2) for k in range(12)) and seen == [12]
    assert all((a == op.shingles(x)).all() for a, x in zip(op._read([x.encode() for x in text]), text))
