"""Operator 7, quality classifier: a sparse rule ensemble.

Statistics of whole texts become a column, in one pass over Arrow batches. Boosted shallow trees are grown on a
bounded sample of labelled rows (about SAMPLE of them, taken by a hash); every path from a root to a node is a
rule, a conjunction of thresholds. A logistic regression with an L1 penalty weighs the rules, most of them to
zero, and the rest are compiled into one Spark column expression over the statistics.

Defined results: null and empty texts have all statistics 0 and are scored by them. Without labels every
score is 0.5; with labels of one class only it is their smoothed mean. Null labels are not learned from;
a document with several labels counts once for each. Repeated rows get a row each; extra columns are ignored,
whatever their names; an empty table gives no rows. Of equally good splits of a tree the first statistic's and
the least threshold is taken; documents of equal texts have equal scores.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free, held_out, table

SAMPLE, TREES, DEPTH, BINS, RATE, SEED = 20_000, 40, 3, 32, 0.3, 11


NAMES = ["log_chars", "letter_share", "upper_share", "digit_share", "symbols_a_word", "bars_a_word", "shouts_a_word", "stops_a_word", "word_length", "distinct_words", "distinct_lines", "words_a_line"]


@functools.cache
def _kind(code: int) -> tuple[bool, ...]:
    """Letter, capital, digit, symbol, bar, shout, stop."""
    c = chr(code)
    return c.isalpha(), c.isupper(), c in "0123456789", c in "#$%&*@^~<>{}[]\\_+=", c == "|", c in "!?", c in ".,;:"


def measure(text: str | None) -> tuple[float, ...]:
    """The statistics of a text, in the order of NAMES."""
    t = text or ""
    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() > 0xFFFF:
        seen, times = np.unique(codes, return_counts=True)
    else:
        times = np.bincount(codes.astype(np.int64))
        seen = np.flatnonzero(times)
        times = times[seen]
    sums = [0] * 7
    for code, n in zip(seen.tolist(), times.tolist()):
        for k, yes in enumerate(_kind(code)):
            if yes:
                sums[k] += n
    letters, upper, digits, symbols, bars, shouts, stops = sums
    words, lines, n = t.split(), t.split("\n"), len(t)
    share = lambda x, of: x / of if of else 0.0
    w = len(words)
    return (math.log1p(n), share(letters, n), share(upper, letters), share(digits, n), share(symbols, w), share(bars, w), share(shouts, w), share(stops, w), share(n - w, w), share(len(set(words)), w), share(len(set(lines)), len(lines)), share(w, len(lines)))


@pandas_udf(StructType([StructField(n, DoubleType()) for n in NAMES]))
def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=NAMES, dtype=float)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """The rules of boosted trees: sorted tuples of (statistic, over, threshold), without repeats."""
    r = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1)  # over cut k: bin > k
    f, rules = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), {}
    for _ in range(TREES):
        p = _sigmoid(f)
        g, h = y - p, p * (1 - p) + 1e-6
        work = [(np.sort(r.choice(len(y), max(1, len(y) // 2), replace=False)), np.arange(len(y)), ())]
        while work:
            own, everyone, path = work.pop()
            best = (1e-3, None, None)
            if len(path) < DEPTH and len(own) >= 20:
                whole = g[own].sum() ** 2 / (h[own].sum() + 1)
                for j in sorted(r.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False)):
                    if len(cuts[j]):
                        a = np.bincount(bins[own, j], g[own], len(cuts[j]) + 1).cumsum()
                        b = np.bincount(bins[own, j], h[own], len(cuts[j]) + 1).cumsum()
                        gain = a[:-1] ** 2 / (b[:-1] + 1) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + 1) - whole
                        if gain.max() > best[0]:
                            best = float(gain.max()), j, int(gain.argmax())
            _, j, k = best
            if j is None:
                f[everyone] += RATE * g[own].sum() / (h[own].sum() + 1) if len(own) else 0
                continue
            for over in (False, True):
                step = tuple(sorted({*path, (int(j), over, float(cuts[j][k]))}))
                rules[step] = None
                work.append((own[(bins[own, j] > k) == over], everyone[(bins[everyone, j] > k) == over], step))
    return list(rules)


def holds(rules: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for i, rule in enumerate(rules):
        for j, over, cut in rule:
            out[:, i] *= (x[:, j] > cut) == over
    return out


def lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights and a free intercept, by accelerated proximal gradient."""
    w, b = np.zeros(m.shape[1], np.float32), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    v, c, t = w.copy(), b, 1.0
    x = np.ones(m.shape[1], np.float32)
    for _ in range(15):  # the largest curvature, by power iteration
        x = m.T @ (m @ x)
        x /= max(np.linalg.norm(x), 1e-9)
    rate = 4 * len(y) / (float(np.linalg.norm(m @ x)) ** 2 + len(y))
    for _ in range(steps):
        e = (_sigmoid(m @ v + c) - y) / len(y)
        w2 = v - rate * (m.T @ e)
        w2 = (np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)).astype(np.float32)
        b2, t2 = c - rate * float(e.sum()), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + np.float32((t - 1) / t2) * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit_rows(x: np.ndarray, y: np.ndarray) -> dict:
    """{"bias": b, "rules": [(weight, rule)]}; the penalty with the least loss on a fifth of the rows."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return {"bias": float(np.log(p / (1 - p))), "rules": []}
    test = np.random.default_rng(SEED).permutation(len(y)) % 5 == 4
    rules = grow(x[~test], y[~test])
    m, best = holds(rules, x), (np.inf, 0.001)
    if test.any() and not test.all():
        for penalty in (0.01, 0.003, 0.001, 0.0003):
            w, b = lasso(m[~test], y[~test], penalty)
            p = np.clip(_sigmoid(m[test] @ w + b), 1e-6, 1 - 1e-6)
            best = min(best, (float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()), penalty))
    w, b = lasso(m, y, best[1])
    return {"bias": b, "rules": [(float(a), r) for a, r in zip(w, rules) if a]}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    labels = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("label_id"), "quality")
    n = labels.count()
    u = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) / float(1 << 30)
    some = labels.where(u < min(1.0, sample / max(n, 1))).limit(2 * sample)  # at most 2 x sample rows of 12 bytes
    labelled = docs.join(F.broadcast(some), docs["doc_id"] == F.col("label_id"))
    rows = sorted((*r[1], r[0]) for r in labelled.select("quality", _measured("text")).limit(4 * sample).collect())
    return fit_rows(np.array([r[:-1] for r in rows], float).reshape(len(rows), len(NAMES)), np.array([r[-1] for r in rows], float))


def compiled(model: dict, of: str = "") -> Column:
    """The model as one column over the statistics; of: the struct's name and a dot."""
    z, col = F.lit(model["bias"]), [F.col(of + n) for n in NAMES]
    for weight, rule in model["rules"]:
        terms = [col[j] > cut if over else col[j] <= cut for j, over, cut in rule]
        every = terms[0]
        for t in terms[1:]:
            every = every & t
        z = z + F.when(every, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns `keep` with score and predicted. Only texts go to Python, and only statistics come back."""
    stats, value = free(docs, "stats", "value")
    out = docs.withColumn(stats, _measured.asNondeterministic()("text")).withColumn(value, compiled(model, f"{stats}."))
    return out.select(*keep, F.col(value).alias("score"), (F.col(value) >= 0.5).cast("int").alias("predicted"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return score(docs, fit(docs.where("not held_out"), labels), ["doc_id", "held_out"])
