"""Operator 10, benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased and stripped of ASCII, general and CJK punctuation; each character of a script without
spaces (Chinese, Japanese, Thai, Lao, Tibetan, Burmese, Khmer) is a word, and two of them count as one. A first
pass counts, over all documents, in how many each word 3-gram of the benchmark occurs. An item's seeds are its
rarer 3-grams (the RARE share by that count, ties included), so a passage that leaked into many documents keeps
seeds. Seeds join passages of whole texts to items, and the item is aligned with the words around them; edited
and paraphrased copies keep enough 3-grams to be seeded, and the alignment scores what edits left: matches +2,
mismatches and gaps -1, as a share of the item's own score. An alignment counts from a share of SCORE on, or
from the score of PASSAGE words on, so that passages of long items count too; and it must match WORDS words, or 4
in 5 of a shorter item's, so that a phrase alone is no copy of a short item.

A benchmark of at most BLOCK bytes of text is one broadcast index, and documents are never shuffled. Beyond
that, seeds are a table: one pass over the documents keeps the places whose 3-gram a bitmap of fixed size (BITMAP
bits at most) may hold, these join the seeds by hash, and the passages that result join the items. Both give the
same rows; benchmark and index are nowhere in one place then.

Defined results: null and empty texts match nothing; items under MIN_WORDS words, which show nothing in running
text, match only a document that is the item and nothing else. Repeated documents and repeated items give a row
for each pair of rows. Extra columns are ignored (clean() returns them); an empty table gives no rows. Of
equally good alignments any one gives the place.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import drop, free, table, written

N, RARE, MIN_WORDS, SCORE, BLOCK = 3, 0.75, 5, 0.5, 8 << 20
PASSAGE, WORDS = 30, 5
MATCH, MISS, GAP = 2, 1, 1
BITMAP = 1 << 30
_PACK = 1 << 20  # a score times this, plus the words matched
_APART = re.compile("[\x85\xa0\xab\xbb\u1680\u2000-\u206f\u3000-\u3004\u3008-\u303f\ufe30-\ufe4f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_ALONE = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii():
        text = _ALONE.sub(r" \g<0> ", _APART.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def size(ws: list[bytes]) -> float:
    """Words, of which two characters of a script without spaces make one."""
    return sum(0.5 if w[0] > 127 and _ALONE.fullmatch(w.decode("utf-8", "surrogatepass")) else 1.0 for w in ws)


class Index:
    """A block of items: a vocabulary, and the 3-grams as numbers with their (item, place)."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]):
        self.names = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], np.int64) for _, ws in items]
        sizes = [size(ws) for _, ws in items]
        self.scale = [len(x) / n if n else 1.0 for x, n in zip(self.items, sizes)]
        self.whole: dict[tuple, list[int]] = {}
        for k, (x, n) in enumerate(zip(self.items, sizes)):
            if n < MIN_WORDS:
                self.whole.setdefault(tuple(x.tolist()), []).append(k)
        at = [(k, p) for k, x in enumerate(self.items) if sizes[k] >= MIN_WORDS for p in range(len(x) - N + 1)]
        grams = np.array([self._code(self.items[k][p : p + N]) for k, p in at], np.int64)
        order = np.argsort(grams, kind="stable")
        self.at = np.array(at, np.int64).reshape(-1, 2)[order]
        self.grams = grams[order]
        self.seed = np.ones(len(at), bool)

    def _code(self, x):
        v, out = len(self.vocabulary), 0
        for k in range(N):
            out = out * v + x[..., k]
        return out

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text as vocabulary numbers (-1: none); where its 3-grams of the block stand, and their codes."""
        get = self.vocabulary.get
        x = np.array([get(w, -1) for w in words(text)], np.int64)
        if len(x) < N or not len(self.grams):
            return x, np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = x >= 0
        p = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        codes = self._code(x[p[:, None] + np.arange(N)])
        k = np.searchsorted(self.grams, codes)
        ok = self.grams[np.minimum(k, len(self.grams) - 1)] == codes
        return x, p[ok], codes[ok]

    def choose(self, seen: dict[int, int]) -> None:
        """Mark the seeds, given each 3-gram's number of documents."""
        n = np.array([seen.get(g, 0) for g in self.grams.tolist()], np.int64)
        order = np.lexsort((n, self.at[:, 0]))
        item, n = self.at[order, 0], n[order]
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(item)))
        least = n[first + np.ceil(RARE * size).astype(np.int64) - 1] if len(first) else n
        self.seed[order] = n <= np.repeat(least, size)

    def hits(self, text: str | None):
        """(item number, score, first word, last word) for each item that the text has a copy of."""
        x, p, codes = self.read(text)
        if 0 < len(x) < 2 * MIN_WORDS:
            yield from ((k, 1.0, 0, len(x) - 1) for k in self.whole.get(tuple(x.tolist()), []))
        near: dict[int, list[int]] = {}
        for place, lo, hi in zip(p.tolist(), np.searchsorted(self.grams, codes).tolist(), np.searchsorted(self.grams, codes, "right").tolist()):
            for j in range(lo, hi):
                if self.seed[j]:
                    k, at = self.at[j].tolist()
                    near.setdefault(k, []).append(place - at)
        for k, starts in sorted(near.items()):
            item = self.items[k]
            found = best(item, self.scale[k], [(lo, x[lo:hi]) for lo, hi in spans(starts, len(item), len(x))])
            if found:
                yield k, *found


def spans(starts: list[int], size: int, words: int) -> list[list[int]]:
    """The stretches of a text's words in which an item of this size may lie, if its copies start about there."""
    out: list[list[int]] = []
    slack = size // 2 + 2
    for s in sorted(set(starts)):
        lo, hi = max(0, s - slack), min(words, s + size + slack)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return out


def best(item: np.ndarray, scale: float, pieces: list[tuple[int, np.ndarray]]) -> tuple[float, int, int] | None:
    """Score, first and last word of the item's best alignment that counts; pieces: (place of the first word, words)."""
    short = SCORE * len(item) < WORDS * scale  # longer items match as many words by their score
    pack = _PACK if short else 1
    weights = (MATCH * pack + short, MISS * pack, GAP * pack)
    least, found = MATCH * min(SCORE * len(item), PASSAGE * scale), None
    for lo, x in pieces:
        both, end = align(item, x, *weights)
        score, matched = both // pack, both % pack
        if score > (found[0] if found else 0) and score >= least and not (short and matched < min(WORDS * scale, 0.8 * len(item))):
            found = score, lo, end, x
    if found is None:
        return None
    score, lo, end, x = found
    _, back = align(item[::-1], x[: end + 1][::-1], *weights)
    return score / (MATCH * len(item)), lo + end - back, lo + end


def align(a: np.ndarray, b: np.ndarray, match: int = MATCH, miss: int = MISS, gap: int = GAP) -> tuple[int, int]:
    """The best local alignment's score, and where in b one that has it ends."""
    j = np.arange(len(b) + 1) * gap
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for w in a:
        new = np.maximum(row - gap, 0)
        np.maximum(new[1:], row[:-1] + np.where(b == w, match, -miss), out=new[1:])
        row = np.maximum.accumulate(new + j) - j
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top - 1
    return best, end


HIT = "doc_id long, item_id long, score double, first_word long, last_word long"


def _index(docs: DataFrame, benchmark: DataFrame):
    """A broadcast index with seeds chosen by counts over all documents; None if the benchmark is over BLOCK."""
    spark, items = docs.sparkSession, benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BLOCK:
        return None
    index = Index([(r["item_id"], ws) for r in items.orderBy("item_id", "text").collect() if (ws := words(r["text"]))])
    sent = spark.sparkContext.broadcast(index)

    def count(batches):
        ix, total = sent.value, {}
        for pdf in batches:
            for t in pdf["text"]:
                for c in np.unique(ix.read(t)[2]).tolist():
                    total[c] = total.get(c, 0) + 1
        yield pd.DataFrame({"gram": np.array(list(total), "int64"), "n": np.array(list(total.values()), "int64")})

    if len(index.grams):
        seen = docs.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        index.choose({r["gram"]: r["n"] for r in seen.collect()})  # the benchmark's 3-grams at most
    return spark.sparkContext.broadcast(index)


U = np.uint64
_WORD = np.random.default_rng(20240604).integers(1, 1 << 62, N, dtype=np.uint64) * U(2) + U(1)


def _hashed(ws: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Hashes of the 3-grams of the words."""
    if len(ws) < N:
        return np.zeros(0, np.int64)
    if len(known) > 1_000_000:
        known.clear()
    for w in set(ws).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h, x = np.array([known[w] for w in ws], U), 0
    for k in range(N):
        x = (x ^ h[k : len(h) - N + 1 + k]) * _WORD[k]
        x ^= x >> U(31)
    return x.view(np.int64)


def _entire(ws: list[bytes]) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(ws), 1)).view(np.int64))


def _seedable(batches):
    """The 3-grams of each item (k), of n words; place -1: the item is short, and g its whole."""
    known: dict[bytes, int] = {}
    for pdf in batches:
        for k, t in zip(pdf["k"].tolist(), pdf["text"]):
            ws = words(t)
            g = _hashed(ws, known) if size(ws) >= MIN_WORDS else np.array([_entire(ws)] if ws else [], np.int64)
            yield pd.DataFrame({"k": k, "n": len(ws), "place": np.arange(len(g)) if size(ws) >= MIN_WORDS else np.full(len(g), -1), "g": g})


def _slot(g: np.ndarray, bits: int) -> np.ndarray:
    return (g.view(U) >> U(20)).astype(np.int64) % bits


def _bitmap(grams: DataFrame) -> tuple[np.ndarray, int]:
    bits = 1 << min(BITMAP.bit_length() - 1, max(15, (16 * grams.count()).bit_length()))
    slot = F.shiftrightunsigned("g", 20) % bits
    marks = np.zeros(bits // 8, np.uint8)
    rows = grams.select((slot / 32768).cast("int").alias("k"), (slot % 32768).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m"))
    for r in rows.toLocalIterator():  # BITMAP bits at most
        marks[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["m"], np.uint8)
    return marks, bits


def _by_seeds(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(rid, k, item_id, score, first_word, last_word) of every copy, by joins; docs: rid, text, stored."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    items = written(items.withColumn("k", F.monotonically_increasing_id()), "items")
    grams = written(items.mapInPandas(_seedable, "k long, n int, place int, g long"), "grams")
    marks, bits = _bitmap(grams)
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def places(batches):
        known: dict[bytes, int] = {}
        for pdf in batches:
            for rid, t in zip(pdf["rid"].tolist(), pdf["text"]):
                ws = words(t)
                g = _hashed(ws, known)
                at = np.arange(len(g))
                if 0 < len(ws) < 2 * MIN_WORDS:
                    g, at = np.append(g, _entire(ws)), np.append(at, -1)
                slot = _slot(g, bits)
                on = (sent.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                g, at = g[on], at[on]
                if len(g):
                    new = np.zeros(len(g), bool)
                    new[np.unique(g, return_index=True)[1]] = True
                    yield pd.DataFrame({"rid": rid, "at": at, "g": g, "new": new})

    hits = written(docs.select("rid", "text").mapInPandas(places, "rid long, at int, g long, new boolean"), "places")
    seen = hits.where("new").groupBy("g").agg(F.count(F.lit(1)).alias("docs"))
    own = Window.partitionBy("k")
    seeds = grams.where("place >= 0").join(seen, "g", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    seeds = seeds.withColumn("rank", F.rank().over(own.orderBy("docs"))).withColumn("all", F.count(F.lit(1)).over(own))
    seeds = seeds.where(F.col("rank") <= F.ceil(F.col("all") * RARE)).select("k", "n", "place", "g").union(grams.where("place < 0"))
    near = hits.select("rid", "at", "g").join(seeds, "g").where("(at < 0) = (place < 0)")
    near = near.groupBy("rid", "k", "n").agg(F.collect_set(F.col("at") - F.col("place")).alias("starts"), F.min("place").alias("whole"))
    near = near.groupBy("rid").agg(F.collect_list(F.struct("k", "n", "starts", "whole")).alias("near"))

    def passages(batches):
        for pdf in batches:
            rows = []
            for rid, t, near in zip(pdf["rid"].tolist(), pdf["text"], pdf["near"]):
                ws = words(t)
                for r in near:
                    for lo, hi in [[0, len(ws)]] if r["whole"] < 0 else spans(list(r["starts"]), r["n"], len(ws)):
                        rows.append((rid, r["k"], lo, b" ".join(ws[lo:hi]).decode("utf-8", "surrogateescape"), r["whole"] < 0))
            yield pd.DataFrame(rows, columns=["rid", "k", "lo", "passage", "whole"])

    def judge(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                ws, x = words(r.text), r.passage.encode("utf-8", "surrogateescape").split(b" ")
                if r.whole:
                    found = (1.0, 0, len(x) - 1) if ws == x else None
                else:
                    number: dict[bytes, int] = {}
                    item = np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
                    found = best(item, len(ws) / size(ws), [(r.lo, np.array([number.get(w, -1) for w in x], np.int64))])
                if found:
                    rows.append((r.rid, r.k, r.item_id, *found))
            yield pd.DataFrame(rows, columns=["rid", "k", "item_id", "score", "first_word", "last_word"]).astype({"item_id": "Int64", "score": "float64"})

    pieces = docs.select("rid", "text").join(near, "rid").mapInPandas(passages, "rid long, k long, lo int, passage string, whole boolean")
    found = pieces.join(items, "k").select("rid", "k", "item_id", "lo", "passage", "whole", "text").mapInPandas(judge, "rid long, k long, item_id long, score double, first_word long, last_word long")
    first = F.max_by(F.struct("item_id", "score", "first_word", "last_word"), F.struct("score", -F.col("first_word")))
    found = written(found.groupBy("rid", "k").agg(first.alias("r")).select("rid", "k", "r.*"), "copies")
    drop(items, grams, hits)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score (0 to 1), first_word, last_word of every copy of an item in a document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = _index(slim, benchmark)
    if sent is None:
        slim = written(slim.where("text is not null").withColumn("rid", F.monotonically_increasing_id()), "texts")
        return _by_seeds(slim, benchmark).join(slim.select("rid", "doc_id"), "rid").select("doc_id", "item_id", "score", "first_word", "last_word")

    def find(batches):
        ix = sent.value
        for pdf in batches:
            rows = [(d, ix.names[k], s, a, b) for d, t in zip(pdf["doc_id"], pdf["text"]) for k, s, a, b in ix.hits(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "first_word", "last_word"]).astype({"doc_id": "Int64", "item_id": "Int64", "score": "float64", "first_word": "int64", "last_word": "int64"})

    return slim.mapInPandas(find, HIT)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a copy of any item; all columns. Of each only the text goes to Python, and nothing back but a flag."""
    sent = _index(docs, benchmark)
    if sent is None:
        (rid,) = free(docs, "rid")
        docs = written(docs.withColumn(rid, F.monotonically_increasing_id()), "texts")
        found = _by_seeds(docs.where("text is not null").select(F.col(rid).alias("rid"), "text"), benchmark)
        return docs.join(found.select(F.col("rid").alias(rid)).distinct(), rid, "left_anti").drop(rid)

    @pandas_udf("boolean")
    def dirty(texts: pd.Series) -> pd.Series:
        ix = sent.value
        return pd.Series([next(ix.hits(t), None) is not None for t in texts], dtype=bool)

    return docs.where(~dirty("text"))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs.select("doc_id", "text", "lang", "source", "n_chars"), table(spark, sf_dir, "benchmark"))
