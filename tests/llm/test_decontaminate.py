import random

import numpy as np
import pytest

from tidelog.llm import decontaminate as op


def brute_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(0, 20))
        score, end = op.align(a, b)
        assert score == brute_align(a, b)
        assert not score or brute_align(a, b[: end + 1]) == score


def test_against_all_alignments(spark):
    r = random.Random(3)
    vocab = [f"word{i}" for i in range(300)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(20, 40)))) for i in range(12)]
    docs = []
    for d in range(150):
        w = [r.choice(vocab) for _ in range(r.randint(0, 150))]
        if d % 3 == 0:
            copy = r.choice(items)[1].split()
            for _ in range(d % 7):
                k = r.randrange(len(copy))
                copy[k : k + 1] = r.choice([[], ["edit"], [copy[k], "more"]])
            w[len(w) // 2 : len(w) // 2] = copy
        docs.append((d, " ".join(w).title() + "."))
    docs += [(900, None), (901, ""), (902, items[0][1] + " x " + items[0][1]), (None, items[1][1]), (900, items[2][1])]
    items += [(77, None), (78, ""), (79, "the of and"), (0, items[0][1])]
    df = spark.createDataFrame([(d, t, "en") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    want = sorted(
        (str(d), i, round(s, 6))
        for d, t in docs
        for i, it in items
        if len(op.words(it)) >= op.MIN_WORDS and (s := brute_align(op.words(it), op.words(t)) / (2 * len(op.words(it)))) >= op.SCORE
    )
    got = op.contaminated(df, bench).collect()
    assert sorted((str(x["doc_id"]), x["item_id"], round(x["score"], 6)) for x in got) == want and len(want) > 40
    dirty = {x[0] for x in want}
    kept = op.clean(df, bench).collect()
    assert sorted(str(x["doc_id"]) for x in kept) == sorted(str(d) for d, t in docs if str(d) not in dirty or (d == 900 and not t))
    assert op.contaminated(df.limit(0), bench).count() == op.contaminated(df, bench.limit(0)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i}") for i in range(6)]
    df = spark.createDataFrame([(i, f"x y {t} z") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, op.contaminated(df, bench).collect()))
    monkeypatch.setattr(op, "BLOCK", 50)
    assert sorted(map(tuple, op.contaminated(df, bench).collect())) == whole and len(whole) == 6
    assert op.clean(df, bench).count() == 0


def test_passages_of_long_items_and_phrases_of_short_ones(spark):
    long = " ".join(f"w{i}" for i in range(200))
    items = [(1, long), (5, "where do the herons nest"), (6, "what is the capital of france"), (8, "one two three four five six seven eight")]
    docs = [
        (1, "a b c " + " ".join(f"w{i}" for i in range(60, 150)) + " d e f", [1]),
        (2, " ".join(f"w{i}" if i % 9 else "edit" for i in range(100, 160)), [1]),
        (3, " ".join(f"w{i}" for i in range(60, 80)), []),
        (4, "nobody knows where do the swans sleep", []),
        (5, "so where do the old herons nest now", [5]),
        (6, "what is the time in this town", []),
        (7, "What is the capital of Spain?", [6]),
        (8, "is the capital of norway", []),
        (9, "one two three four 5 6 7 8", []),
        (10, "one two 3 four five six 7 eight", [8]),
    ]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op.contaminated(df, bench).collect()
    assert sorted((x["doc_id"], x["item_id"]) for x in got) == [(d, i) for d, _, own in docs for i in own]
    assert {x["doc_id"]: (x["first_word"], x["last_word"]) for x in got}[1] == (3, 92)
    assert sorted(x["doc_id"] for x in op.clean(df, bench).collect()) == [d for d, _, own in docs if not own]


def test_scripts_without_spaces_and_short_items(spark):
    zh, th, ja = "法国的首都是哪一座城市，它有多少人口？", "เมืองหลวงของประเทศฝรั่งเศสคือเมืองอะไร", "フランスの首都はどこですか。人口は何人ですか。"
    items = [(1, zh), (2, th), (3, ja), (4, "forty two"), (5, "巴黎"), (6, "?!"), (7, "a\u00a0narrow\u2003river crosses\u3000the plain")]
    docs = [
        (1, f"前言。{zh}后记。", [1]), (2, f"abc {th[3:]} xyz", [2]), (3, ja.replace("。", "\n"), [3]),
        (4, "Forty-two.", [4]), (5, "forty two people came", []), (6, "「巴黎」", [5]), (7, "巴黎很美", []),
        (8, "法国的首都很美丽", []), (9, "... !", []), (10, "so a narrow river crosses the plain here", [7]),
    ]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op.contaminated(df, bench).collect()
    assert sorted((x["doc_id"], x["item_id"]) for x in got) == [(d, i) for d, _, own in docs for i in own]
    assert sorted(x["doc_id"] for x in op.clean(df, bench).collect()) == [d for d, _, own in docs if not own]


@pytest.mark.parametrize("block", [8 << 20, 50])
def test_long_texts_repeats_and_extra_columns(spark, monkeypatch, block):
    """As one index, and with seeds as a table."""
    monkeypatch.setattr(op, "BLOCK", block)
    item = " ".join(f"alpha{i}" for i in range(25))
    long = "filler words of no interest " * 60_000
    rows = [(1, long + item + " " + long), (2, long), (3, None), (4, ""), (None, item), (5, item), (5, item), (6, "Forty two!")]
    bench = spark.createDataFrame([(1, item), (2, item), (None, "forty two"), (3, None), (4, "")], "item_id long, text string")
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, rid int, k int, item_id string").repartition(3)
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["score"], r["first_word"], r["last_word"]) for r in op.contaminated(df, bench).collect())
    places = {"1": 300_000, "None": 0, "5": 0}
    assert got == sorted([(d, i, 1.0, places[d], places[d] + 24) for d in ("1", "None", "5", "5") for i in "12"] + [("6", "None", 1.0, 0, 1)])
    kept = op.clean(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert op.clean(df.limit(0), bench).count() == 0 and op.clean(df, bench.limit(0)).count() == len(rows)


def test_many_seeds_as_a_table_equal_one_index(spark, monkeypatch):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(200)]
    items = [(i % 25, " ".join(r.choice(vocab) for _ in range(r.choice([2, 4, 6, 30, 120])))) for i in range(40)]
    docs = []
    for d in range(200):
        w = [r.choice(vocab) for _ in range(r.randrange(60))]
        if d % 2:
            own = r.choice(items)[1].split()
            k = r.randrange(len(own))
            own[k : k + r.randrange(2)] = ["edit"] * r.randrange(2)
            w = own if d % 7 == 0 else w[:20] + own + w[20:]
        docs.append((d % 180, " ".join(w)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted((x["doc_id"], x["item_id"], round(x["score"], 9)) for x in rows)
    one, left = key(op.contaminated(df, bench).collect()), sorted(map(tuple, op.clean(df, bench).collect()))
    monkeypatch.setattr(op, "BLOCK", 50)
    assert key(op.contaminated(df, bench).collect()) == one and len(one) > 40
    assert sorted(map(tuple, op.clean(df, bench).collect())) == left
