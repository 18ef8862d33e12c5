import random
import zlib

import numpy as np

from tidelog.llm import language_id as op

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_calibration(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op.op8_language_id(spark, DATA).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    tested = [(r["lang_pred"] == truth[r["doc_id"]], r["score"]) for r in got if r["held_out"]]
    right = np.mean([a for a, _ in tested])
    assert right > 0.98 and abs(np.mean([s for _, s in tested]) - right) < 0.03


def test_weights_are_sparse_and_temperature_is_fitted():
    r = np.random.default_rng(0)
    xs = [(np.array([y, 10 + r.integers(50)]), np.array([0.8, 0.6])) for y in (0, 1) * 100]
    w = op.ftrl(xs, np.array([0, 1] * 100), 2, l1=0.5, l2=0.01)
    assert w[0, 0] > 0 > w[0, 1] and (w != 0).sum() < 40
    logits = np.tile([[4.0, 0.0]], (100, 1))
    assert abs(op._temperature(logits, np.array([0] * 75 + [1] * 25)) - 4 / np.log(3)) < 0.05


def test_odd_rows(spark):
    r = random.Random(1)
    say = lambda words: " ".join(r.choice(words) for _ in range(12))
    rows = [(i, say(["the", "and", "thing"]), "en", 0.5) for i in range(40)] + [(100 + i, say(["der", "und", "größe"]), "de", 0.5) for i in range(40)]
    rows += [(900, None, "en", 0.5), (901, "", "de", 0.5), (902, "123 \n !?", "en", 0.5), (None, "the and thing", None, 0.5), (903, "der und " * 20000, None, 0.5), (1, "the and", "en", 0.5), (904, "x", None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    got = op.predict(docs, op.fit(docs), ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    by = {x["doc_id"]: x["lang_pred"] for x in got}
    assert [by[900], by[901], by[902], by[None], by[903]] == ["und", "und", "und", "en", "de"]
    assert {x["lang_pred"] for x in op.predict(docs, op.fit(docs.where("lang is null")), ["doc_id"]).collect()} == {"und"}
    one = op.predict(docs, op.fit(docs.where("lang = 'de'")), ["doc_id"]).collect()
    assert {x["lang_pred"] for x in one} == {"und", "de"}
    assert op.predict(docs.limit(0), op.fit(docs.limit(0)), ["doc_id"]).count() == 0


def test_every_language_is_learnt_and_samples_repeat(spark):
    n = 300
    say = lambda i, r: " ".join("".join(chr(0x4E00 + 3 * i + r.randrange(3)) for _ in range(4)) for _ in range(6))
    r = random.Random(2)
    rows = [(say(i, r), f"l{i:03}") for i in range(n) for _ in range(3)] + [("copy of one text", "l000")] * 400
    docs = spark.createDataFrame(rows, "text string, lang string")
    models = [op.fit(docs.repartition(k), per_class=3) for k in (3, 5)]
    assert models[0]["langs"] == sorted({x for _, x in rows}) and len(models[0]["langs"]) == n
    assert (models[0]["w"] == models[1]["w"]).all()
    got = op.predict(docs.where("text not like 'copy%'"), models[0], ["lang"]).collect()
    assert np.mean([x["lang"] == x["lang_pred"] for x in got]) > 0.9


def test_grams_and_frequencies_against_plain_code():
    import collections

    import pandas as pd

    word = (1 << 32) - 1

    def plain(text):
        c = [ord(x) if ord(x) >= 128 or x.isalpha() else 32 for x in text.lower()]
        c = [x for k, x in enumerate(c) if x != 32 or k and c[k - 1] != 32]
        out = [x * 2654435761 for x in c]
        out += [(a * 2246822519 & word ^ b) * 3266489917 for a, b in zip(c, c[1:])]
        out += [((a * 668265263 & word ^ b) * 374761393 & word ^ d) * 2654435761 for a, b, d in zip(c, c[1:], c[2:])]
        return collections.Counter((x & word) >> (32 - op.BITS) for x in out)

    r = random.Random(9)
    texts = ["", "a", " ", "Ab", *("".join(r.choice("abcé ñ1.,\n日İ😀") for _ in range(r.randrange(80))) for _ in range(120))]
    for t in texts:
        at, n = op._grams(t)
        assert dict(zip(at.tolist(), n.tolist())) == plain(t), t
    total = collections.Counter(b for t in texts if t for b in plain(t))
    total[-1] = sum(map(bool, texts))
    got = list(op._document_frequency([pd.DataFrame({"text": texts[:50]}), pd.DataFrame({"text": texts[50:]})]))[0]
    assert dict(zip(got["bucket"].tolist(), got["n"].tolist())) == total


def test_ftrl_against_one_weight_at_a_time():
    r = np.random.default_rng(3)
    xs = [(np.sort(r.choice(12, 4, replace=False)), r.random(4)) for _ in range(30)]
    ys, l1, l2, alpha, beta = r.integers(0, 3, 30), 0.05, 0.1, 0.5, 1.0
    z, n = {}, {}

    def weight(i, c):
        a = z.get((i, c), 0.0)
        return 0.0 if abs(a) <= l1 else (np.sign(a) * l1 - a) / ((beta + n.get((i, c), 0.0) ** 0.5) / alpha + l2)

    for e in range(3):
        for k in np.random.default_rng(e).permutation(30):
            at, v = xs[k]
            w = {(i, c): weight(i, c) for i in at for c in range(3)}
            s = [sum(x * w[i, c] for i, x in zip(at, v)) for c in range(3)]
            p = np.exp(s) / np.exp(s).sum()
            for i, x in zip(at, v):
                for c in range(3):
                    g = x * (p[c] - (ys[k] == c))
                    step = ((n.get((i, c), 0) + g * g) ** 0.5 - n.get((i, c), 0) ** 0.5) / alpha
                    z[i, c] = z.get((i, c), 0) + g - step * w[i, c]
                    n[i, c] = n.get((i, c), 0) + g * g
    got = op.ftrl(xs, ys, 3, l1, l2, alpha, beta)
    assert np.abs(got[:12] - [[weight(i, c) for c in range(3)] for i in range(12)]).max() < 1e-9 and not got[12:].any()


def test_ties_and_names_that_clash(spark):
    docs = spark.createDataFrame([("same words here", x) for x in ("b", "a")] * 30, "text string, lang string")
    model = op.fit(docs)
    assert model["langs"] == ["a", "b"]
    model["w"][:] = 0
    odd = docs.selectExpr("text", "lang as `__text`", "lang as answer", "1 as score_").limit(3)
    assert {(r["lang_pred"], r["score"]) for r in op.predict(odd, model, ["__text", "answer"]).collect()} == {("a", 0.5)}
