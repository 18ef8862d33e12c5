"""Operator 5, line dedup: fuzzy lines by MinHash, one line kept of each component.

A line is a set of character shingles of WIDTH. BANDS bands of ROWS MinHash values make candidates: two lines
at similarity 0.8 share a band with probability 0.9994, two at 0.1 with 4e-7, so that candidates stay few in a
large corpus. The values are a fast similarity sketch: shingles are thrown into BANDS x ROWS bins, round after
round, until each bin has one, and a bin holds the least hash of its first round. Two sets agree in a bin with
probability their similarity, as with as many permutations, at a small part of the work. Candidates are
confirmed by exact Jaccard similarity of the full sets, and a distributed union-find over confirmed links keeps
the first line, by (doc_id, line number), of each component.

1. Documents are packed into units of UNIT blocks of BLOCK bytes, which never move again: the distinct lines, their
   first places, and each document as line numbers.
2. A unit sends a 96-bit hash of each line and its place to buckets; a bucket answers which are the first of
   all. Others are removed wherever the component's first line is, and take no further part. So each distinct
   line is signed once in the whole corpus.
3. A unit sends its band keys (56 bits), each once, to buckets, which answer with the lines that share one with
   another unit's. Only these, and those that share one within the unit, go on as rows.
4. Links are proposed and confirmed as in the chosen-path join, with bands for nodes: forests by sketch, full
   sets once for each connected group, exact similarity in memory. No band is capped.
5. Lines that aren't first in their components go back to the units.

Defined results: lines end at "\\n"; blank lines are always kept, and so are the lines of a document with a
null id, which remove none elsewhere. A line shorter than WIDTH is one shingle. A null text has no lines and
stays null; an empty text has one blank line. Rows that share a doc_id are the same place: what one of them
keeps at a line number, the other keeps there too. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, small_batches, table, tidy, written
from .minhash_join import FEW, LEAF, _small, confirm, large_nodes, mix
from .repeat_tree import BLOCK, BUCKET, NULL

WIDTH, ROWS, BANDS, COORDS = 5, 8, 40, 128
BINS, ROUNDS = ROWS * BANDS, 64
UNIT = 4  # blocks
CHUNK = 1 << 18  # characters hashed at once
U, V = np.uint64, np.uint32
_RNG = np.random.default_rng(20240518)
_TURN = _RNG.integers(1, 1 << 31, (ROUNDS, 2), dtype=np.uint32) * V(2) + V(1)
_BIN = _RNG.integers(1, 1 << 31, BINS, dtype=np.uint32) * V(2) + V(1)
_CHAR = _RNG.integers(1, 1 << 31, WIDTH, dtype=np.uint32) * V(2) + V(1)
_ROW = _RNG.integers(1, 1 << 62, ROWS // 2, dtype=np.uint64) * U(2) + U(1)


def _hashes(c: np.ndarray, w: int) -> np.ndarray:
    h = np.full(len(c) - w + 1, w, np.uint64)
    for k in range(w):
        h = h * U(0x9E3779B97F4A7C15) + c[k : len(c) - w + 1 + k]
        h ^= h >> U(29)
    return mix(h)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def shingles(line: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    c = _codes(line)
    return np.unique(_hashes(c, min(WIDTH, len(c))))


def _thrown(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of all lines, and the number of each one's line; repeats stay."""
    c = np.frombuffer(("\n".join(lines) + "\n" * WIDTH).encode("utf-32-le", "surrogatepass"), V)
    size = np.array([len(x) for x in lines])
    h = np.zeros(len(c) - WIDTH + 1, V)
    for k in range(WIDTH):
        h += (c[k : k + len(h)] ^ (c[k : k + len(h)] >> V(5))) * _CHAR[k]
    h ^= h >> V(15)
    h *= V(0x2C1B3C6D)
    h ^= h >> V(12)
    start = np.cumsum(size + 1) - size - 1
    n = np.maximum(1, size - WIDTH + 1)  # a short line is one shingle, with line ends after it
    row = np.repeat(np.arange(len(lines)), n)
    return h[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)], row


def sketch(h: np.ndarray, row: np.ndarray, rows: int, bins: int = BINS) -> np.ndarray:
    """The values of each of the sets, of which h has the elements' hashes and row the set's number, ascending."""
    low, empty = np.full(rows * bins, 0xFFFFFFFF, V), np.ones(rows * bins, bool)
    base = (row * bins).astype(np.int32)
    for k, (a, b) in enumerate(_TURN):
        at = h * a
        at >>= V(16)
        at *= V(bins)
        at >>= V(16)
        at = at.view(np.int32)
        at += base
        if k:
            new = np.flatnonzero(empty[at])
            at, x = at[new], h[new]
            x *= b
        else:
            x = h * b
        x ^= x >> V(15)
        x *= V(0x85EBCA6B)
        np.minimum.at(low, at, x)
        empty[at] = False
        if k > 3 and k % 3 and k < ROUNDS - 1:  # what is full gets nothing more, so this need not be known each time
            continue
        left = empty.reshape(rows, bins).any(1)
        if not left.any():
            break
        on = left[row]
        if np.count_nonzero(on) < 0.8 * len(on):
            h, row, base = h[on], row[on], base[on]
    else:  # few shingles: what is still empty takes the least of all of them under its own hash
        for i in np.flatnonzero(left).tolist():
            lo, hi = np.searchsorted(row, [i, i + 1])
            at = np.flatnonzero(empty[i * bins : (i + 1) * bins])
            x = (h[lo:hi, None] + V(1)) * _BIN[at]
            low[i * bins + at] = ((x ^ (x >> V(15))) * V(0x85EBCA6B)).min(0)
    return low.reshape(rows, bins)


def _chunks(lines: list[str]):
    """The lines in groups of about CHUNK characters."""
    k = 0
    while k < len(lines):
        n, size = k, 0
        while n < len(lines) and (n == k or size + len(lines[n]) <= CHUNK):
            size += len(lines[n])
            n += 1
        yield lines[k:n]
        k = n


def bands(lines: list[str]) -> np.ndarray:
    """The BANDS band keys of each line."""
    out = [np.zeros((0, BANDS), U)]
    for own in _chunks(lines):
        low = sketch(*_thrown(own), len(own)).view("<u8").reshape(len(own), BANDS, ROWS // 2)
        key = np.tile(np.arange(1, BANDS + 1, dtype=U), (len(own), 1))
        for j in range(ROWS // 2):
            key = mix(key * U(0xD6E8FEB86659FD93) ^ (low[:, :, j] * _ROW[j]))
        out.append(key)
    return np.concatenate(out)


def described(lines: list[str]):
    """For each line: how many shingles it has, and COORDS bits of a sketch as two numbers."""
    for own in _chunks(lines):
        bits = np.packbits((mix(sketch(*_thrown(own), len(own), COORDS).astype(U)) & U(1)).astype(np.uint8), 1).view("<i8")
        c = np.concatenate([_codes("\n".join(own)), np.zeros(WIDTH, U)])
        h, at = _hashes(c, WIDTH), 0
        for x, (s1, s2) in zip(own, bits.tolist()):
            if len(x) >= WIDTH:
                v = np.sort(h[at : at + len(x) - WIDTH + 1])
                n = 1 + int(np.count_nonzero(v[1:] != v[:-1]))
            else:
                n = 1
            yield n, s1, s2
            at += len(x) + 1


UNITS = "part long, unit long, bytes long, ids binary, nulls binary, counts binary, at binary, texts binary, whole binary, doc binary, line binary"


def _pack(most: int):
    """Units of up to `most` bytes. at: the number of each line of each document; doc, line: the first place of each
    distinct line among those that count (doc NULL: none of them does); whole: their hashes."""

    def run(batches):
        part, seq, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        small = lambda v, kind: pack.compress(np.array(v, kind).tobytes())

        new = lambda: ({}, [], [], [], [], [], [], 0)
        seen, ids, nulls, counts, at, doc, line, total = new()

        def close():
            own = [x.encode("utf-8", "surrogatepass") for x in seen]
            whole = b"".join(xxhash.xxh3_128_digest(x)[:12] for x in own)
            return pd.DataFrame([(part, seq, total, small(ids, "<i8"), np.array(nulls, bool).tobytes(), small(counts, "<u4"), small(at, "<u4"), pack.compress(b"\n".join(own)), whole, small(doc, "<i8"), small(line, "<u4"))], columns=[c.split()[0] for c in UNITS.split(", ")])

        for pdf in batches:
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"]):
                d = NULL if pd.isna(d) else int(d)
                lines = (t or "").split("\n")
                ids.append(d)
                nulls.append(t is None)
                counts.append(len(lines))
                total += len(t or "") + 1
                for k, x in enumerate(lines):
                    i = seen.setdefault(x, len(seen))
                    at.append(i)
                    if i == len(doc):
                        doc.append(NULL)
                        line.append(0)
                    if d != NULL and (doc[i] == NULL or (d, k) < (doc[i], line[i])) and x.strip():
                        doc[i], line[i] = d, k
                if total >= most:
                    yield close()
                    seen, ids, nulls, counts, at, doc, line, total = new()
                    seq += 1
        if ids:
            yield close()

    return run


def _numbers(v: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(v), kind)


def _lines(r) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(r.texts).decode("utf-8", "surrogatepass").split("\n")


def _counted(r, buckets: int):
    """Of the lines that count, in the order in which buckets get them: bucket, number, hash, document, line."""
    doc, line, whole = _numbers(r.doc, "<i8"), _numbers(r.line, "<u4"), np.frombuffer(r.whole, "<u4").reshape(-1, 3)
    own = np.flatnonzero(doc != NULL)
    bucket = whole[own, 0] % buckets
    order = np.lexsort((doc[own], bucket))
    own, bucket = own[order], bucket[order]
    return bucket, own, whole[own], doc[own], line[own]


def _cuts(bucket: np.ndarray):
    """(bucket, first, end) of each run of equal numbers."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return zip(bucket[edges].tolist(), edges.tolist(), np.append(edges[1:], len(bucket)).tolist())


def _ask(buckets: int):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                bucket, _, whole, doc, line = _counted(r, buckets)
                rows = [(k, r.part, r.unit, whole[i:j].tobytes(), pack(np.diff(doc[i:j], prepend=0).astype("<i8").tobytes()), pack(line[i:j].tobytes())) for k, i, j in _cuts(bucket)]
                yield pd.DataFrame(rows, columns=["bucket", "part", "unit", "whole", "doc", "line"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which of each unit's lines are the first of all."""
    whole = np.frombuffer(b"".join(pdf["whole"]), "<u4").reshape(-1, 3)
    doc, line = (np.concatenate(v) for v in ([np.cumsum(_numbers(d, "<i8")) for d in pdf["doc"]], [_numbers(x, "<u4") for x in pdf["line"]]))
    order = np.lexsort((line, doc, *whole.T))
    w, d, k = whole[order], doc[order], line[order]
    first = np.concatenate([[True], (w[1:] != w[:-1]).any(1)])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    own = np.zeros(len(w), bool)
    own[order] = (d == d[lead]) & (k == k[lead])
    ends = np.cumsum([len(x) // 12 for x in pdf["whole"]])
    return pdf[["part", "unit", "bucket"]].assign(own=[np.packbits(x).tobytes() for x in np.split(own, ends[:-1])])


def _first(r, buckets: int, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the unit's lines that count, and whether each is the first of all."""
    bits = dict(zip(answers["bucket"], answers["own"]))
    bucket, own, *_ = _counted(r, buckets)
    is_first = [np.unpackbits(np.frombuffer(bits[k], np.uint8), count=j - i).astype(bool) for k, i, j in _cuts(bucket)]
    return own, np.concatenate([np.zeros(0, bool), *is_first])


KEYS = "bucket int, part long, unit long, keys binary, lines binary"


def _seven(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _eight(data: list[bytes]) -> np.ndarray:
    out = np.zeros((sum(map(len, data)) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Where keys stand that stand more than once."""
    sort = np.sort(keys)
    again = np.unique(sort[1:][sort[1:] == sort[:-1]])
    if not len(again):
        return np.zeros(0, np.int64)
    maybe, low = np.zeros(1 << 20, bool), U((1 << 20) - 1)  # spares most keys the search
    maybe[(again & low).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(keys & low).astype(np.int64)])
    return at[again[np.minimum(np.searchsorted(again, keys[at]), len(again) - 1)] == keys[at]]


def _sign(buckets: int, others: int):
    """The units' band keys, each once. Those that stand in several of a unit's lines go on anyhow, in rows of buckets under 0."""

    def run(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out, said, pack = [], dict(iter(answers.groupby("unit"))), zstandard.ZstdCompressor(level=1).compress
        for r in rows.itertuples(index=False):
            own, is_first = _first(r, buckets, said.get(r.unit, answers.iloc[:0]))
            own = np.sort(own[is_first])
            if not len(own):
                continue
            lines = _lines(r)
            keys = bands([lines[i] for i in own.tolist()]).ravel() >> U(8)
            line = np.repeat(own, BANDS).astype("<u4")
            near = _repeated(keys)
            if len(near):
                out.append((-1 - (r.part + r.unit) % others, r.part, r.unit, _seven(keys[near]), pack(line[near].tobytes())))
                one = np.ones(len(keys), bool)
                one[near] = False
                one[near[np.unique(keys[near], return_index=True)[1]]] = True
                keys, line = keys[one], line[one]
            bucket = (keys % U(others)).astype(np.uint16 if others < 1 << 16 else np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, line = keys[order], line[order]
            for k, i, j in _cuts(bucket[order]):
                out.append((k, r.part, r.unit, _seven(keys[i:j]), pack(np.diff(line[i:j], prepend=np.uint32(0)).astype("<u4").tobytes())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in KEYS.split(", ")])

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """The band keys that several units have, or several lines of one, with each unit's lines."""
    if pdf["bucket"].iloc[0] < 0:
        return pdf[["part", "unit", "keys", "lines"]]
    keys = _eight(pdf["keys"].tolist())
    at, near = 0, _repeated(keys)
    rows, pack = [], zstandard.ZstdCompressor(level=1).compress
    for part, unit, own, lines in zip(pdf["part"], pdf["unit"], pdf["keys"], pdf["lines"]) if len(near) else ():
        lo, hi = np.searchsorted(near, [at, at + len(own) // 7])
        if hi > lo:
            line = np.cumsum(_numbers(lines, "<u4"), dtype=np.uint32)[near[lo:hi] - at]
            rows.append((part, unit, _seven(keys[near[lo:hi]]), pack(line.astype("<u4").tobytes())))
        at += len(own) // 7
    return pd.DataFrame(rows, columns=["part", "unit", "keys", "lines"])


LINE = "part long, unit long, at int, doc long, line int, n int, s1 long, s2 long, keys array<long>, text string"


def _describe(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The lines that go on, with those of their band keys that other lines have too."""
    out, said = [], dict(iter(answers.groupby("unit")))
    for r in rows.itertuples(index=False):
        if r.unit not in said:
            continue
        keys = _eight(said[r.unit]["keys"].tolist())
        line = np.concatenate([_numbers(v, "<u4") for v in said[r.unit]["lines"]])
        order = np.lexsort((keys, line))
        keys, line = keys[order], line[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])])
        keys, line = keys[new].view(np.int64), line[new]
        lines, doc, place = _lines(r), _numbers(r.doc, "<i8"), _numbers(r.line, "<u4")
        near = [(i, keys[a:b]) for i, a, b in _cuts(line)]
        for (i, own), what in zip(near, described([lines[i] for i, _ in near])):
            out.append((r.part, r.unit, i, int(doc[i]), int(place[i]), *what, own, lines[i]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in LINE.split(", ")])


def _read(rows: list[bytes]) -> list[np.ndarray]:
    """The shingles of each line, hashed many lines at once."""
    out = []
    for own in _chunks([x.decode("utf-8", "surrogatepass") for x in rows]):
        h, at = _hashes(np.concatenate([_codes("\n".join(own)), np.zeros(WIDTH, U)]), WIDTH), 0
        for x in own:
            if len(x) >= WIDTH:
                v = np.sort(h[at : at + len(x) - WIDTH + 1])
                out.append(v[np.concatenate([[True], v[1:] != v[:-1]])])
            else:
                out.append(shingles(x))
            at += len(x) + 1
    return out


def line_components(reps: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the classes on confirmed links; reps: id, n, s1, s2, keys, text.

    Bands with the same members (by 128 bits of hashes) propose the same, so one of them is enough."""
    members = reps.select(F.explode("keys").alias("node"), "id", "n", "s1", "s2", F.col("id").alias("label"))
    whose = F.bit_xor(F.xxhash64("id")).alias("w1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("w2")
    crowded = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"), *whose).where("size > 1")
    crowded = written(crowded.groupBy("size", "least", "w1", "w2").agg(F.min("node").alias("node")), "bands")
    found = _small(members.join(crowded.where(F.col("size") <= LEAF).select("node"), "node", "left_semi"), percent)
    large = crowded.where(F.col("size") > LEAF)
    known = large.count()
    if known:
        large = written(large.select("node", "least").join(reps.select(F.col("id").alias("least"), F.struct("id", "n", "s1", "s2").alias("p")), "least"), "large")
        for x in large_nodes(members, F.broadcast(large) if known <= FEW else large, percent, None):
            found = found.union(x)
    proposed = written(found.distinct(), "proposed")
    groups = components(proposed)
    texts = reps.select("id", F.col("text").cast("binary").alias("s"))  # an eighth of the sets' bytes
    with small_batches(reps.sparkSession, 2000):
        return components(confirm(texts, groups, percent, _read))


OUT = "doc_id long, n_lines long, n_removed long, kept_sha256 string, text string"


def _later(batches):
    """Numbers of removed lines by unit."""
    for pdf in batches:
        rows = [(part, unit, -1, own["at"].to_numpy("<u4").tobytes()) for (part, unit), own in pdf.groupby(["part", "unit"])]
        yield pd.DataFrame(rows, columns=["part", "unit", "bucket", "own"])


def _cut(buckets: int, with_text: bool):
    def run(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out, said = [], dict(iter(answers.groupby("unit")))
        for r in rows.itertuples(index=False):
            own = said.get(r.unit, answers.iloc[:0])
            counted, is_first = _first(r, buckets, own[own["bucket"] >= 0])
            lines, doc, line = _lines(r), _numbers(r.doc, "<i8"), _numbers(r.line, "<u4")
            lost = np.zeros(len(doc), bool)
            lost[counted[~is_first]] = True
            for v in own["own"][own["bucket"] < 0]:
                lost[np.frombuffer(v, "<u4")] = True
            ids, counts, at = _numbers(r.ids, "<i8"), _numbers(r.counts, "<u4").astype(np.int64), _numbers(r.at, "<u4")
            ends = np.cumsum(counts)
            whose, place = np.repeat(ids, counts), np.arange(len(at)) - np.repeat(ends - counts, counts)
            keep = (whose == NULL) | (doc[at] == NULL) | (~lost[at] & (doc[at] == whose) & (line[at] == place))
            blank = np.array([not x.strip() for x in lines])
            keep |= blank[at]
            null = np.frombuffer(r.nulls, bool).tolist()
            at, keep = at.tolist(), keep.tolist()
            for k, (d, hi, n) in enumerate(zip(ids.tolist(), ends.tolist(), counts.tolist())):
                kept = [lines[i] for i, x in zip(at[hi - n : hi], keep[hi - n : hi]) if x]
                text = "\n".join(kept)
                out.append((None if d == NULL else d, 0 if null[k] else n, 0 if null[k] else n - len(kept), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), text if with_text and not null[k] else None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"doc_id": "Int64"})

    return run


@tidy
def deduplicate(docs: DataFrame, percent: int = 80, with_text: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and, if asked for, the text that remains."""
    spark, slim = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(spark, 2000):
        texts = written(slim.mapInPandas(_pack(UNIT * block), UNITS), "units", "part")
    total = texts.agg(F.sum(F.length("whole")).alias("n")).first()["n"] or 0
    buckets, others = max(16, total // BUCKET + 1), max(16, total // 12 * BANDS * 8 // BUCKET + 1)
    with small_batches(spark, 1):
        asked = texts.select("part", "unit", "whole", "doc", "line").mapInPandas(_ask(buckets), "bucket int, part long, unit long, whole binary, doc binary, line binary")
        answers = written(asked.groupBy("bucket").applyInPandas(_answer, "part long, unit long, bucket int, own binary"), "first")
    signed = texts.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_sign(buckets, others), KEYS)
    shared = written(signed.groupBy("bucket").applyInPandas(_shared, "part long, unit long, keys binary, lines binary"), "shared")
    lines = texts.groupBy("part").cogroup(shared.groupBy("part")).applyInPandas(_describe, LINE)
    lines = written(lines.withColumn("id", F.monotonically_increasing_id()), "lines")
    drop(shared)
    comps = line_components(lines.select("id", "n", "s1", "s2", "keys", "text"), percent)
    linked = lines.select("id", "part", "unit", "at", F.struct("doc", "line").alias("place")).join(comps, "id")
    best = written(linked.groupBy("component").agg(F.min("place").alias("best")), "best")  # apart from the join, so that a hot component's part is split
    later = linked.join(best, "component").where("place <> best").select("part", "unit", "at").mapInPandas(_later, "part long, unit long, bucket int, own binary")
    later = written(later, "later")
    drop(lines)
    out = texts.groupBy("part").cogroup(answers.union(later).groupBy("part")).applyInPandas(_cut(buckets, with_text), OUT)
    return out if with_text else out.drop("text")


def op5_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
