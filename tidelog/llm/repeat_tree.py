"""Operator 6, suffix-array dedup: the common-prefix interval tree of an enhanced suffix array.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller id.

The suffix array is sparse and distributed. Every LENGTH-byte string picks one of its GRAM-byte grams, the
one with the least hash (the leftmost of equals), so equal strings pick the same gram at the same place. Only
suffixes that start at picked grams are sorted, each with the bytes before it. The strings that pick a gram at
one place in a text start one after another; the bytes that they cover are its context.

1. Documents are packed into units of UNIT blocks, which never move again. Picked grams with equal
   contexts are equal suffixes: one leaf of the tree, with the least of its documents. A unit sends the hash of
   the gram and of the context (48 bits each) of each of its leaves to buckets, with the least document. A
   bucket answers with three bits: another unit has the leaf in a smaller document (then all strings of it are
   removed here); the gram stands in different contexts; it does so too often for one bucket.
2. Of grams in different contexts, the unit with a leaf's least document sends the suffix and its left context,
   once. A bucket sorts them, takes the common prefixes of neighbours, and scans them with a stack into the
   interval tree. In each interval the left contexts are sorted and scanned the same way: where they differ,
   the interval is left-diverse, and each node of that second tree is a maximal repeat with all its leaves,
   not just neighbours. All but those in its smallest document are removed.
3. A gram with over HOT contexts, or over LOCAL in one unit (of which the bucket gets one mark instead), is split
   by longer grams: its strings pick again, among their grams of LONGER bytes. These suffixes are rows; equal
   contexts are aggregated before they are shuffled, and each longer gram has a tree. One that still has over
   HOT contexts is split by its whole strings, of which each is one leaf, again aggregated before the shuffle.
   So no bucket, tree or task holds an unbounded group.
4. Removed runs go to the units.

Defined results: a null or empty text has no bytes, none removed, and the SHA-256 of nothing. A document with
a null id keeps all its bytes and removes none elsewhere. Rows that share a doc_id don't remove from one
another, as neither id is smaller. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, settings, small_batches, table, tidy, whole, written

LENGTH, GRAM, LONGER, HOT, LOCAL = 50, 16, 32, 4096, 16
LEFT = LENGTH - GRAM  # the bytes before a picked gram that a string may have
SLICE = 1 << 18  # strings whose numbers are in memory at once, about 60 bytes each
BLOCK = 4 << 20  # of text, unpacked at once
UNIT = 2  # blocks
BUCKET = 8 << 20  # bytes of hashes a bucket gets, about
TREES = 1 << 16  # suffixes whose trees are in memory at once, about 600 bytes each
WIDE = 1 << 12  # suffixes at crowded grams whose strings are in memory at once
NULL = -(1 << 63)
U = np.uint64
LOW48 = U((1 << 48) - 1)
MARK = LOW48  # instead of a context's hash: there are more than LOCAL


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _words(x: np.ndarray, step: int = 0) -> np.ndarray:
    """The eight bytes from each position on, as numbers; x has spare bytes at its end."""
    return np.ndarray((len(x) - 7 - step,), "<u8", x.data, step, (1,))


def _part(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bytes of 8-byte numbers, for n from 0 to 8."""
    return w & _MASK[n]


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def _least(m: np.ndarray, places: int) -> np.ndarray:
    """The least of each `places` numbers in a row, along the last axis."""
    step = 1
    while 2 * step <= places:
        m = np.minimum(m[..., :-step], m[..., step:])
        step *= 2
    n = m.shape[-1] - (places - step)
    return np.minimum(m[..., :n], m[..., places - step :])


class Block:
    """Documents one after another, and the picked grams."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes):
        self.ids, self.sizes = ids, sizes
        self.ends = np.cumsum(sizes)
        self.n = len(data)
        self.x = np.frombuffer(data + bytes(2 * LENGTH + 16), np.uint8)

    def pick(self) -> None:
        """For each picked gram: at, where it starts; left and right, how far its context reaches from there;
        doc, whose it is; h and c, hashes of the gram and of its context, of 48 bits."""
        w = _words(self.x)
        n = max(0, self.n - LENGTH + 1)
        starts = self.ends - self.sizes
        lo = np.maximum(self.ends - LENGTH + 1, starts)
        none = self.ids == NULL
        cuts = np.concatenate([lo, starts[none]]), np.concatenate([self.ends, lo[none]])  # where no string starts
        found = []
        for s in range(0, n, SLICE):
            m = min(SLICE, n - s)
            v = w[s : s + m + LEFT + 8]
            g = _mix(v[: m + LEFT] * U(0x9E3779B97F4A7C15) ^ _mix(v[8 : 8 + m + LEFT]))
            g &= ~U(0xFFFFFFFF)
            g |= np.arange(len(g), dtype=np.uint64)
            p = (_least(g, LEFT + 1) & U(0xFFFFFFFF)).astype(np.int64)
            step = np.zeros(m + 1, np.int32)
            for at, sign in zip(cuts, (1, -1)):
                np.add.at(step, np.clip(at - s, 0, m), sign)
            win = np.flatnonzero(np.cumsum(step[:-1]) == 0)
            if len(win):
                p = p[win]
                first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (win[1:] != win[:-1] + 1)]))
                found.append(np.stack([p[first], win[first], win[np.append(first[1:], len(p)) - 1]]) + s)
        at, lo, hi = np.concatenate([np.zeros((3, 0), np.int64), *found], 1)
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (lo[1:] != hi[:-1] + 1)])[: len(at)]  # a slice's end is no end
        first = np.flatnonzero(new)
        at, lo, hi = at[first], lo[first], hi[np.append(first[1:], len(at)) - 1] if len(at) else hi
        self.at, self.left, self.right = at, (at - lo).astype(np.uint8), (hi + LENGTH - at).astype(np.uint8)
        self.doc = np.searchsorted(self.ends, at, "right")
        self.h = _mix(w[at] * U(0x9E3779B97F4A7C15) ^ _mix(w[at + 8])) & LOW48
        size = hi + LENGTH - lo
        c = _mix((at - lo).astype(U) * U(0x9E3779B97F4A7C15) + size.astype(U))
        for k in range(0, LENGTH + LEFT, 8):
            on = np.flatnonzero(size > k)
            c[on] = _mix(c[on] * U(0x9E3779B97F4A7C15) ^ _part(w[lo[on] + k], np.minimum(size[on] - k, 8)))
        self.c = c & LOW48
        self.c[self.c == MARK] = 0


def _pack(most: int):
    """Units of UNIT blocks of about `most` bytes."""

    def run(batches):
        part, seq, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        ids, texts, nulls, size, have, total = [], [], [], 0, [], 0

        def block():
            nonlocal ids, texts, nulls, size
            have.append((size, np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), np.array(nulls, bool).tobytes(), pack.compress(b"".join(texts))))
            ids, texts, nulls, size = [], [], [], 0

        def close():
            nonlocal have, total, seq
            out = pd.DataFrame([(part, seq, total, *map(list, zip(*have)))], columns=[c.split()[0] for c in UNITS.split(", ")])
            have, total, seq = [], 0, seq + 1
            return out

        for pdf in batches:
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"]):
                ids.append(NULL if pd.isna(d) else int(d))
                nulls.append(t is None)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                size, total = size + len(texts[-1]), total + len(texts[-1])
                if size >= most or len(ids) >= max(1, most // 64):
                    block()
                    if total >= UNIT * most:
                        yield close()
        if ids:
            block()
        if have:
            yield close()

    return run


UNITS = "part long, unit long, bytes long, sizes array<long>, ids array<binary>, lengths array<binary>, nulls array<binary>, data array<binary>"


def units(docs: DataFrame, block: int) -> DataFrame:
    """The documents (doc_id, text) in units, which lie in buckets by part."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession, 2000):
        return written(slim.mapInPandas(_pack(block), UNITS), "units", "part")


def each_unit(texts: DataFrame, answers: DataFrame, f, schema: str, name: str, *columns: str) -> DataFrame:
    """What f gives for each unit and its answers, or these columns of it, written. Units come to Python one at a time,
    however many a part has; they stay in their part's bucket, and only the answers move."""
    with settings(texts.sparkSession, spark__sql__requireAllClusterKeysForCoPartition="false"):
        out = texts.groupBy("part", "unit").cogroup(answers.groupBy("part", "unit")).applyInPandas(f, schema)
        return written(out.select(*columns) if columns else out, name)


def _open(r):
    """A unit's blocks, one at a time, with the place of each in the unit and its documents' nulls."""
    at = 0
    for size, ids, lengths, nulls, data in zip(r.sizes, r.ids, r.lengths, r.nulls, r.data):
        yield at, Block(np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64), zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(size)))), np.frombuffer(nulls, bool)
        at += int(size)


class Leaves:
    """A unit's picked grams, grouped by gram and context: leaf k has rows first[k] to first[k + 1].

    sent: the leaves, or the first of a gram's where there are over LOCAL, in the order in which buckets get them."""

    def __init__(self, r, buckets: int, local: int):
        rows = []
        for at, b, _ in _open(r):
            b.pick()
            rows.append((b.at + at, b.left, b.right, b.ids[b.doc], b.h, b.c))
        self.at, self.left, self.right, self.doc, self.h, self.c = (np.concatenate(v) for v in zip(*rows))
        del rows, b
        order = np.lexsort((self.doc, self.c, self.h))
        for k in ("at", "left", "right", "doc", "h", "c"):
            setattr(self, k, getattr(self, k)[order])
        h, c = self.h, self.c
        self.first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.zeros(0, np.int64)
        own = h[self.first]
        gram = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        several = np.diff(np.append(gram, len(own)))
        self.crowd = np.repeat(several > local, several)
        self.head = np.repeat(gram, several)
        sent = ~self.crowd
        sent[gram] = True
        sent = np.flatnonzero(sent)
        self.bucket = (own[sent] % U(buckets)).astype(np.int64)
        order = np.lexsort((self.doc[self.first[sent]], self.bucket))
        self.sent, self.bucket = sent[order], self.bucket[order]

    def rows(self):
        """For each bucket: its number, and its part of `sent`."""
        edges = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])) if len(self.sent) else np.zeros(0, np.int64)
        for i, j in zip(edges.tolist(), np.append(edges[1:], len(self.sent)).tolist()):
            yield int(self.bucket[i]), self.sent[i:j]


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _ask(buckets: int, local: int):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = Leaves(r, buckets, local)
                rows = []
                for k, own in x.rows():
                    c = np.where(x.crowd[own], MARK, x.c[x.first[own]])
                    doc = np.diff(x.doc[x.first[own]], prepend=0).astype("<i8")
                    rows.append((k, r.part, r.unit, _six(x.h[x.first[own]]), _six(c), zstandard.compress(doc.tobytes())))
                yield pd.DataFrame(rows, columns=["bucket", "part", "unit", "h", "c", "docs"])

    return run


def _answer(most: int):
    """Bits for each unit's leaves: removed, in different contexts, in too many."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hs = [_eight(h) for h in pdf["h"]]
        h, c = np.concatenate(hs), np.concatenate([_eight(x) for x in pdf["c"]])
        doc = np.concatenate([np.cumsum(np.frombuffer(zstandard.decompress(d), "<i8")) for d in pdf["docs"]])
        order = np.lexsort((doc, c, h))
        hh, cc, dd = h[order], c[order], doc[order]
        gram = np.concatenate([[True], hh[1:] != hh[:-1]])
        leaf = np.flatnonzero(gram | np.concatenate([[True], cc[1:] != cc[:-1]]))
        size = np.diff(np.append(leaf, len(hh)))
        least = np.repeat(dd[leaf], size)
        group = np.cumsum(gram) - 1
        leaves = np.bincount(group[leaf])
        edges = np.flatnonzero(gram)
        mixed = (leaves > 1) & (np.minimum.reduceat(dd, edges) != np.maximum.reduceat(dd, edges))
        hot = (leaves > most) | (np.maximum.reduceat(cc, edges) == MARK)
        gone, again, often = np.zeros((3, len(h)), bool)
        gone[order] = (dd > least) & ~hot[group]
        again[order] = (mixed & ~hot)[group] & (dd == least)
        often[order] = hot[group]
        rows, at = [], 0
        for k, (bucket, part, unit) in enumerate(zip(pdf["bucket"], pdf["part"], pdf["unit"])):
            own = slice(at, at + len(hs[k]))
            at = own.stop
            rows.append((part, unit, bucket, *(np.packbits(v[own]).tobytes() if v[own].any() else b"" for v in (gone, again, often))))
        return pd.DataFrame(rows, columns=["part", "unit", "bucket", "gone", "again", "often"])

    return run


#: kind 0: suffixes for a bucket; 1: suffixes of crowded grams; 2: removed runs; 3: places that share the fate of another.
SENT = "part long, unit long, kind int, bucket int, n int, data binary"


def _runs(*parts: np.ndarray) -> bytes:
    return zstandard.compress(np.stack(parts, 1).astype("<u4").tobytes())


def _send(buckets: int, local: int):
    def run(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out, said = [], {}
        for unit, own in answers.groupby("unit"):
            said[unit] = {k: v for k, *v in zip(own["bucket"], own["gone"], own["again"], own["often"])}
        for r in rows.itertuples(index=False):
            x = Leaves(r, buckets, local)
            gone, again, often = np.zeros((3, len(x.first)), bool)
            for k, own in x.rows():
                for into, bits in zip((gone, again, often), said.get(r.unit, {}).get(k, ())):
                    if bits:
                        into[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own))
            often |= x.crowd  # the mark's answer is for all leaves of its gram
            size = np.diff(np.append(x.first, len(x.h)))
            leaf = np.repeat(np.arange(len(x.first)), size)
            gone = gone[leaf] | (x.doc > x.doc[x.first][leaf])
            if gone.any():
                out.append((r.part, r.unit, 2, 0, 0, _runs(x.at[gone] - x.left[gone], x.at[gone] + x.right[gone])))
            ask = (again | often) & ~gone[x.first]
            twin = np.flatnonzero(ask[leaf] & ~gone)
            twin = twin[twin != x.first[leaf[twin]]]
            if len(twin):
                out.append((r.part, r.unit, 3, 0, 0, _runs(x.at[x.first[leaf[twin]]], x.at[twin])))
            text = _texts(r)
            for k, own in x.rows():
                cold = own[again[own] & ask[own]]
                if len(cold):
                    out.append((r.part, r.unit, 0, k, len(cold), _payload(x, text, x.first[cold])))
            hot = x.first[ask & often]
            for i in range(0, len(hot), 20_000):
                out.append((r.part, r.unit, 1, 0, len(hot[i : i + 20_000]), _payload(x, text, hot[i : i + 20_000])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])

    return run


def _texts(r) -> np.ndarray:
    """A unit's bytes."""
    parts = [zstandard.ZstdDecompressor().decompress(d, max_output_size=max(1, int(n))) for d, n in zip(r.data, r.sizes)]
    return np.frombuffer(b"".join([*parts, bytes(LENGTH + LEFT)]), np.uint8)


FIELDS = (("<u8", 1), ("<i8", 1), ("<u4", 1), (np.uint8, 1), (np.uint8, 1), (np.uint8, LEFT + LENGTH))


def _payload(x: Leaves, text: np.ndarray, own: np.ndarray) -> bytes:
    """Hash, document, place, the context's extent to the left and right, and the bytes around each gram."""
    at, left, right = x.at[own], x.left[own].astype(np.int64), x.right[own].astype(np.int64)
    place = np.arange(-LEFT, LENGTH)
    near = text[np.clip(at[:, None] + place, 0, len(text) - 1)]
    near[(place < -left[:, None]) | (place >= right[:, None])] = 0
    parts = [x.h[own].astype("<u8"), x.doc[own].astype("<i8"), at.astype("<u4"), left.astype(np.uint8), right.astype(np.uint8), near]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def _parse(n: int, payload: bytes):
    raw, at, out = zstandard.ZstdDecompressor().decompress(payload, max_output_size=n * (22 + LEFT + LENGTH)), 0, []
    for kind, width in FIELDS:
        size = n * width * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    out[-1] = out[-1].reshape(n, LEFT + LENGTH)
    return out


def intervals(lcp: list[int]):
    """The nodes of the interval tree over len(lcp) + 1 sorted suffixes: (depth, parent's depth, first, last).

    lcp[i] is the common prefix of suffixes i and i + 1. One scan with a stack; a node comes out when it ends.
    """
    stack = [(-1, 0)]
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack[-1][0] > depth:
            own, first = stack.pop()
            yield own, max(depth, stack[-1][0]), first, i
        if stack[-1][0] < depth:
            stack.append((depth, first))


def _common(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The common prefix of neighbouring rows, no longer than either's size."""
    same = a[1:] == a[:-1]
    n = np.where(same.all(1), a.shape[1], same.argmin(1))
    return np.minimum(n, np.minimum(size[1:], size[:-1]))


def _order(a: np.ndarray, size: np.ndarray, *before) -> np.ndarray:
    """Rows in byte order, a prefix before what it begins."""
    wide = np.zeros((len(a), -(-a.shape[1] // 8) * 8), np.uint8)
    wide[:, : a.shape[1]] = a
    wide[np.arange(wide.shape[1]) >= size[:, None]] = 0
    return np.lexsort((size, *wide.view(">u8").astype(np.uint64).T[::-1], *before))


def maximal_repeats(h: np.ndarray, doc: np.ndarray, back: np.ndarray, left: np.ndarray, ahead: np.ndarray, right: np.ndarray, gram: int = GRAM):
    """The maximal repeats of LENGTH or more that two documents share, with all occurrences:
    members (one repeat's after another's), and for each repeat its size, least place and greatest place.

    Rows are suffixes at picked grams: back has the bytes before, nearest first, ahead those from the gram on.
    A string with the gram at place o is shared by all members for every o between the two places. Trees of a
    single node, which two suffixes or suffixes in equal surroundings make, are read off together.
    """
    order = _order(ahead, right, h)
    h, doc, back, left, ahead, right = (v[order] for v in (h, doc, back, left, ahead, right))
    lcp = _common(ahead, right)
    lcp[(h[1:] != h[:-1]) | (lcp < gram)] = 0
    edges = np.concatenate([[0], np.flatnonzero(lcp == 0) + 1])
    sizes = np.diff(np.append(edges, len(h)))
    several = np.maximum.reduceat(doc, edges) != np.minimum.reduceat(doc, edges)
    edges, sizes = edges[several], sizes[several]
    if not len(edges):
        return np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 3
    inner = np.arange(sizes.sum() - len(sizes)) + np.repeat(edges - np.concatenate([[0], np.cumsum(sizes - 1)[:-1]]), sizes - 1)
    lcs = np.zeros(len(lcp), np.int64)
    same = back[inner] == back[inner + 1]
    lcs[inner] = np.minimum(np.where(same.all(1), LEFT, same.argmin(1)), np.minimum(left[inner], left[inner + 1]))
    first = np.concatenate([[0], np.cumsum(sizes - 1)[:-1]])
    flat = np.minimum.reduceat(lcp[inner], first) == np.maximum.reduceat(lcp[inner], first)
    alike = (lcs[inner] == left[inner]) & (lcs[inner] == left[inner + 1])
    plain = flat & ((sizes == 2) | np.minimum.reduceat(alike, first))
    out, n, lows, highs = [], [], [], []
    low, high = np.maximum(0, LENGTH - lcp[edges]), np.minimum(LEFT, lcs[edges])
    good = np.flatnonzero(plain & (low <= high))
    out.append(np.arange(sizes[good].sum()) + np.repeat(edges[good] - np.concatenate([[0], np.cumsum(sizes[good])[:-1]]), sizes[good]) if len(good) else np.zeros(0, np.int64))
    n += sizes[good].tolist()
    lows += low[good].tolist()
    highs += high[good].tolist()
    for lo, size in zip(edges[~plain].tolist(), sizes[~plain].tolist()):
        for depth, above, a, z in intervals(lcp[lo : lo + size - 1].tolist()):
            least, most = max(0, LENGTH - depth), min(LEFT, LENGTH - 1 - max(above, gram - 1))
            if depth < gram or least > most:
                continue
            own = np.arange(lo + a, lo + z + 1)
            d = doc[own]
            if (d == d[0]).all():
                continue
            if len(own) == 2:
                common = lcs[own[:1]]
            else:
                own = own[_order(back[own], left[own])]
                common = _common(back[own], left[own])
            for extent, over, b, y in intervals(common.tolist()):
                x, last = max(least, over + 1), min(extent, most)
                group = own[b : y + 1]
                if x <= last and (doc[group] != doc[group[0]]).any():
                    out.append(group)
                    n.append(len(group))
                    lows.append(x)
                    highs.append(last)
    return order[np.concatenate(out)], *(np.array(v, np.int64) for v in (n, lows, highs))


def _gone(h, doc, left, right, text, gram: int = GRAM):
    """Rows of which strings are removed, once each, and the places of the gram in these strings, least and greatest:
    all of a row's strings hold its gram, so what they cover is one run."""
    back, ahead = np.ascontiguousarray(text[:, :LEFT][:, ::-1]), np.ascontiguousarray(text[:, LEFT:])
    own, n, first, last = maximal_repeats(h, doc, back, left, ahead, right, gram)
    if not len(own):
        return own, own, own
    least = np.minimum.reduceat(doc[own], np.concatenate([[0], np.cumsum(n)[:-1]]))
    gone = doc[own] > np.repeat(least, n)
    low, high = np.full(len(doc), LENGTH), np.full(len(doc), -1)
    np.minimum.at(low, own[gone], np.repeat(first, n)[gone])
    np.maximum.at(high, own[gone], np.repeat(last, n)[gone])
    own = np.flatnonzero(high >= 0)
    return own, low[own], high[own]


def _packed(part: np.ndarray, unit: np.ndarray, *fields: np.ndarray) -> pd.DataFrame:
    """(place, first, last) by unit, as rows of kind 4."""
    order = np.lexsort((unit, part))
    p, u, fields = part[order], unit[order], [v[order] for v in fields]
    edges = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (u[1:] != u[:-1])])) if len(p) else np.zeros(0, np.int64)
    rows = [(int(p[i]), int(u[i]), 4, _runs(*(v[i:j] for v in fields))) for i, j in zip(edges.tolist(), np.append(edges[1:], len(p)).tolist())]
    return pd.DataFrame(rows, columns=["part", "unit", "kind", "data"])


def _apart(h: np.ndarray):
    """The rows in groups of about TREES, which part no gram: each gram's trees are its own."""
    order = np.argsort(h, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
    cuts = np.unique(edges[np.searchsorted(edges, np.arange(0, len(h), TREES), "right") - 1])
    return np.split(order, cuts[1:])


def _buckets(batches):
    """What the trees of each bucket remove, from rows sorted by bucket."""
    rest = []

    def solve(rows):
        n = [r[3] for r in rows]
        part, unit = np.repeat([r[1] for r in rows], n), np.repeat([r[2] for r in rows], n)
        fields, k = [np.empty((sum(n), width)[: 1 + (width > 1)], kind) for kind, width in FIELDS], 0
        for i, (*_, size, data) in enumerate(rows):
            for into, v in zip(fields, _parse(size, data)):
                into[k : k + size] = v
            k, rows[i] = k + size, None
        h, doc, at, left, right, text = fields
        found = []
        for own in _apart(h):
            gone, first, last = _gone(h[own], doc[own], left[own], right[own], text[own])
            found.append((own[gone], first, last))
        own, first, last = (np.concatenate(v) for v in zip(*found))
        return _packed(part[own], unit[own], at[own], first, last)

    for pdf in batches:
        for row in zip(pdf["bucket"].tolist(), pdf["part"].tolist(), pdf["unit"].tolist(), pdf["n"].tolist(), pdf["data"]):
            if rest and rest[-1][0] != row[0]:
                yield solve(rest)
                rest = []
            rest.append(row)
    if rest:
        yield solve(rest)


ROW = "part long, unit long, at long, doc long, h long, c long, shift int, lft int, rgt int, text binary"


def _wide_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of each row on."""
    wide = np.zeros((len(text), text.shape[1] + 8), np.uint8)
    wide[:, : text.shape[1]] = text
    return np.ndarray((len(wide), text.shape[1]), "<u8", wide.data, 0, (wide.shape[1], 1)) if len(wide) else np.zeros((0, text.shape[1]), "<u8")


def _longer(batches):
    """The strings of suffixes at crowded grams pick again, among their grams of LONGER bytes."""
    for pdf in batches:
        for r, k in ((r, k) for r in pdf.itertuples(index=False) for k in range(0, r.n, WIDE)):
            _, doc, at, left, right, text = (v[k : k + WIDE] for v in _parse(r.n, r.data))
            w = _wide_words(text)
            n = LEFT + LENGTH - LONGER + 1
            g = np.zeros((len(at), n), U)
            for k in range(0, LONGER, 8):
                g = _mix(g * U(0x9E3779B97F4A7C15) ^ w[:, k : k + n])
            p = (_least(g & ~U(0xFF) | np.arange(n, dtype=U), LENGTH - LONGER + 1) & U(0xFF)).astype(np.int64)
            s = np.arange(p.shape[1])
            row, s = np.nonzero((s >= LEFT - left.astype(int)[:, None]) & (s <= LEFT + right.astype(int)[:, None] - LENGTH))
            p = p[row, s]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (p[1:] != p[:-1])]))
            row, p, lo, hi = row[first], p[first], s[first], s[np.append(first[1:], len(p)) - 1]
            lft, rgt = p - lo, hi + LENGTH - p
            place = np.arange(-LEFT, LENGTH)
            own = text[row[:, None], np.clip(p[:, None] + place, 0, text.shape[1] - 1)]
            own[(place < -lft[:, None]) | (place >= rgt[:, None])] = 0
            c = _mix(lft.astype(U) * U(256) + rgt.astype(U))
            for k in range(0, own.shape[1], 8):
                c = _mix(c * U(0x9E3779B97F4A7C15) ^ _wide_words(own)[:, k])
            yield pd.DataFrame({"part": r.part, "unit": r.unit, "at": at[row].astype(np.int64), "doc": doc[row], "h": g[row, p].view(np.int64), "c": c.view(np.int64), "shift": (p - LEFT).astype(np.int32), "lft": lft.astype(np.int32), "rgt": rgt.astype(np.int32), "text": [x.tobytes() for x in own]})


def _columns(pdf: pd.DataFrame):
    text = np.frombuffer(b"".join(pdf["text"]), np.uint8).reshape(len(pdf), LEFT + LENGTH)
    return pdf["h"].to_numpy("int64"), pdf["c"].to_numpy("int64"), pdf["doc"].to_numpy("int64"), pdf["lft"].to_numpy("int64"), pdf["rgt"].to_numpy("int64"), text


FOUND = "h long, c long, first int, last int"


def _trees(batches):
    """What the trees of longer grams remove, from rows sorted by gram."""
    for pdf in batches:
        h, c, doc, left, right, text = _columns(pdf)
        own, first, last = _gone(h.view(U), doc, left, right, text, LONGER)
        yield pd.DataFrame({"h": h[own], "c": c[own], "first": first.astype(np.int32), "last": last.astype(np.int32)})


def _strings(batches):
    """Every string of each row: two hashes, and the gram's place in it."""
    for pdf in batches:
        h, c, doc, left, right, text = _columns(pdf)
        w = _wide_words(text)
        row, s = np.nonzero((np.arange(LEFT + 1) >= LEFT - left[:, None]) & (np.arange(LEFT + 1) <= LEFT + right[:, None] - LENGTH))
        w1, w2 = np.full(len(s), 1, U), np.full(len(s), 2, U)
        for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
            w1, w2 = _mix(w1 ^ w[row, s + k]), _mix(w2 * U(0x9E3779B97F4A7C15) + w[row, s + k])
        yield pd.DataFrame({"h": h[row], "c": c[row], "doc": doc[row], "w1": w1.view(np.int64), "w2": w2.view(np.int64), "o": (LEFT - s).astype(np.int32)})


def _by_unit(batches):
    for pdf in batches:
        yield _packed(*(pdf[k].to_numpy("int64") for k in ("part", "unit", "at", "first", "last")))


def crowded(sent: DataFrame, hot: int) -> DataFrame:
    """What is removed of suffixes at crowded grams, as rows of kind 4."""
    with small_batches(sent.sparkSession, 8):
        rows = written(sent.where("kind = 1").select("part", "unit", "n", "data").mapInPandas(_longer, ROW), "longer")
    leaves = rows.groupBy("h", "c").agg(F.min_by(F.struct("doc", "lft", "rgt", "text"), "doc").alias("r")).select("h", "c", "r.*")
    leaves = written(leaves, "leaves")
    grams = leaves.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("n > 1 and lo < hi")
    grams = written(grams.select("h", "n"), "grams")
    few, many = (leaves.join(grams.where(x).select("h"), "h") for x in (F.col("n") <= hot, F.col("n") > hot))
    found = few.repartition("h").sortWithinPartitions("h").mapInPandas(whole("h", _trees), FOUND)
    strings = many.mapInPandas(_strings, "h long, c long, doc long, w1 long, w2 long, o int")
    least = strings.groupBy("w1", "w2").agg(F.min("doc").alias("least"))
    found = written(found.union(strings.join(least, ["w1", "w2"]).where("doc > least").select("h", "c", F.col("o").alias("first"), F.col("o").alias("last"))), "found")
    own = rows.drop("text").join(leaves.select("h", "c", F.col("doc").alias("least")), ["h", "c"])
    later = own.where("doc > least").select("part", "unit", "at", (F.lit(LENGTH) - F.col("rgt") - F.col("shift")).alias("first"), (F.col("lft") - F.col("shift")).alias("last"))
    first = own.where("doc = least").join(found, ["h", "c"]).select("part", "unit", "at", (F.col("first") - F.col("shift")).alias("first"), (F.col("last") - F.col("shift")).alias("last"))
    return later.union(first).mapInPandas(_by_unit, "part long, unit long, kind int, data binary")


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def removed(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Where a unit's removed runs start and end, in order of their start."""
    read = {k: [np.frombuffer(zstandard.decompress(v), "<u4").astype(np.int64).reshape(-1, w) for v in answers["data"][answers["kind"] == k]] for k, w in ((2, 2), (3, 2), (4, 3))}
    runs, twins, spans = (np.concatenate([np.zeros((0, w), np.int64), *read[k]]) for k, w in ((2, 2), (3, 2), (4, 3)))
    twins = np.concatenate([twins, np.repeat(np.unique(spans[:, :1]), 2).reshape(-1, 2)])  # a place shares its own fate
    twins = twins[np.argsort(twins[:, 0], kind="stable")]
    lo, hi = (np.searchsorted(twins[:, 0], spans[:, 0], side) for side in ("left", "right"))
    each = np.repeat(np.arange(len(spans)), hi - lo)
    at = twins[np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each], 1]
    runs = np.concatenate([runs, np.stack([at - spans[each, 2], at - spans[each, 1] + LENGTH], 1)])
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    return runs[:, 0], runs[:, 1]


def _cut(with_bytes: bool):
    def run(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out, none = [], answers.iloc[:0]
        said = dict(iter(answers.groupby("unit")))
        for r in rows.itertuples(index=False):
            start, end = removed(said.get(r.unit, none))
            for at, b, _ in _open(r):
                own = slice(*np.searchsorted(start, [at, at + b.n]))
                step = np.bincount(start[own] - at, minlength=b.n + 1) - np.bincount(end[own] - at, minlength=b.n + 1)
                gone = np.cumsum(step[:-1]) > 0
                text = b.x[: b.n]
                for d, lo, hi in zip(b.ids.tolist(), (b.ends - b.sizes).tolist(), b.ends.tolist()):
                    g = gone[lo:hi]
                    n = int(np.count_nonzero(g))
                    spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if n else 0
                    kept = text[lo:hi][~g].tobytes() if n else text[lo:hi].tobytes()
                    out.append((None if d == NULL else d, hi - lo, n, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"doc_id": "Int64"})

    return run


@tidy
def deduplicate(docs: DataFrame, with_bytes: bool = False, hot: int = HOT, block: int = BLOCK, local: int = LOCAL) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the remaining bytes."""
    texts = units(docs, block)
    total = texts.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(16, int(total * 2 / (LEFT + 2) * 12) // BUCKET + 1)
    with small_batches(docs.sparkSession, 1):
        asked = texts.mapInPandas(_ask(buckets, local), "bucket int, part long, unit long, h binary, c binary, docs binary")
        answers = written(asked.groupBy("bucket").applyInPandas(_answer(hot), "part long, unit long, bucket int, gone binary, again binary, often binary"), "answers")
    sent = each_unit(texts, answers, _send(buckets, local), SENT, "suffixes")
    drop(answers)
    with small_batches(docs.sparkSession, 64):
        cold = sent.where("kind = 0").select("bucket", "part", "unit", "n", "data").repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_buckets, "part long, unit long, kind int, data binary")
        runs = [sent.where("kind >= 2").select("part", "unit", "kind", "data"), written(cold, "runs")]
    if sent.where("kind = 1").limit(1).count():
        runs.append(written(crowded(sent, hot), "runs"))
    every = runs[0]
    for x in runs[1:]:
        every = every.union(x)
    columns = [c.split()[0] for c in OUT.split(", ")]
    return each_unit(texts, every, _cut(with_bytes), OUT, "deduplicate", *columns[: None if with_bytes else -1])


def op6_repeat_tree(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
