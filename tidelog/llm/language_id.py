"""Operator 8, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained with follow-the-regularised-leader (FTRL-proximal) and elastic-net penalties on a
bounded, documented sample (`per_class` texts a language); document frequencies come from every training
document. A temperature fitted on a fifth of the sample calibrates the scores.

Defined results: a null text or one without a letter gives `und` with score 0; so does every text when
there is nothing to learn from. Null languages are never learned from. Repeated rows get a row each; extra
columns are ignored, whatever their names; an empty table gives no rows. Ties between languages go to the first
in name order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import free, held_out, table

BITS = 15
MANY = 256  # languages from which weights are single precision
UND = "und"

_ASCII = np.full(128, 32, np.uint32)
_ASCII[97:123] = np.arange(97, 123)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the 1- to 3-grams of the lower-cased text; ASCII non-letters are one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    small = c < 128
    c = np.where(small, _ASCII[np.minimum(c, 127)], c)
    blank = c == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    c = c[keep]
    one = c * np.uint32(2654435761)
    two = (c[:-1] * np.uint32(2246822519) ^ c[1:]) * np.uint32(3266489917)
    three = ((c[:-2] * np.uint32(668265263) ^ c[1:-1]) * np.uint32(374761393) ^ c[2:]) * np.uint32(2654435761)
    shift = np.uint32(32 - BITS)
    n = np.bincount(np.concatenate([one, two, three]) >> shift, minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = _grams(text)
    v = (1 + np.log(n)) * idf[at]
    return at, v / max(np.sqrt((v * v).sum()), 1e-12)


def _document_frequency(batches):
    total, docs = np.zeros(1 << BITS, np.int64), 0
    for pdf in batches:
        for t in pdf["text"]:
            if t:
                total[_grams(t)[0]] += 1
                docs += 1
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], docs)})


def ftrl(xs, ys, classes: int, l1: float, l2: float, alpha: float = 0.5, beta: float = 1.0, epochs: int = 3) -> np.ndarray:
    """Weights (bucket, class) of the softmax model; zero wherever the L1 penalty holds."""
    z = np.zeros((1 << BITS, classes), np.float32 if classes > MANY else np.float64)
    n = np.zeros_like(z)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for e in range(epochs):
        for i in np.random.default_rng(e).permutation(len(xs)):
            at, v = xs[i]
            w = weights(at)
            p = v @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[ys[i]] -= 1
            g = v[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    out = np.empty_like(z)
    for i in range(0, len(z), 1024):
        out[i : i + 1024] = weights(slice(i, i + 1024))
    return out


def _temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""

    def loss(t):
        s = logits / np.exp(t)
        m = s.max(1)
        return (m + np.log(np.exp(s - m[:, None]).sum(1)) - s[np.arange(len(ys)), ys]).mean()

    lo, hi, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(train: DataFrame, per_class: int = 1000, l1: float = 0.002, l2: float = 0.01) -> dict | None:
    """Learn every language from (text, lang), each from about per_class distinct texts."""
    spark = train.sparkSession
    train = train.select("text", "lang").where("lang is not null and text is not null")
    counts = sorted((r["lang"], r["n"]) for r in train.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return None
    df = {r["bucket"]: r["n"] for r in train.mapInPandas(_document_frequency, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    docs = df.pop(-1, 0)
    idf = np.zeros(1 << BITS)
    at = np.fromiter(df, np.int64, len(df))
    idf[at] = np.log((1 + docs) / (1 + np.fromiter(df.values(), np.float64, len(df)))) + 1
    h = F.xxhash64("text", "lang")
    rows = train.join(F.broadcast(spark.createDataFrame([(x, min(1.0, per_class / n)) for x, n in counts], "__lang string, __share double")), F.col("lang") == F.col("__lang"))
    rows = rows.where(F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < F.col("__share")).select("text", "lang").distinct()
    rows = rows.orderBy(h, "text", "lang").limit(4 * per_class * len(counts)).collect()
    langs = [lang for lang, _ in counts]
    rows = sorted((r["text"], r["lang"]) for r in rows)
    at = {x: i for i, x in enumerate(langs)}
    xs, ys = [_vector(t, idf) for t, _ in rows], np.array([at[x] for _, x in rows])
    if not xs:
        return None
    test = np.arange(len(xs)) % 5 == 4
    if test.sum() >= 20:
        w = ftrl([x for x, t in zip(xs, test) if not t], ys[~test], len(langs), l1, l2)
        heat = _temperature(np.stack([v @ w[at] for (at, v), t in zip(xs, test) if t]), ys[test])
    else:
        heat = 1.0
    w = ftrl(xs, ys, len(langs), l1, l2)
    return {"langs": langs, "idf": idf.astype(np.float32), "w": (w / heat).astype(np.float32), "temperature": heat}


def predict(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """The columns `keep` with lang_pred and score; texts are read whole. Only they go to Python, and no text comes back."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS x languages floats

    @pandas_udf("lang_pred string, score double")
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            langs, scores = [], []
            for t in texts:
                if m is None or not t or not any(map(str.isalpha, t)):
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                at, v = _vector(t, m["idf"])
                s = v.astype(np.float64) @ m["w"][at]
                s = np.exp(s - s.max())
                k = int(s.argmax())
                langs.append(m["langs"][k])
                scores.append(float(s[k] / s.sum()))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    (answer,) = free(docs, "answer")
    out = docs.withColumn(answer, said.asNondeterministic()("text"))  # else a filter on it would ask twice
    return out.select(*keep, f"{answer}.lang_pred", f"{answer}.score")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return predict(docs, fit(docs.where("not held_out")), ["doc_id", "held_out"])


def stage(spark, docs: DataFrame, sf_dir: str, min_score: float = 0.3) -> DataFrame:
    """Documents whose language is known with a score of min_score or more; the columns of documents."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    model = fit(docs.where(~held_out()))
    return predict(docs, model, cols).where(f"lang_pred <> '{UND}' and score >= {min_score}").select(*cols)
