"""Operator 3, token-ID / binary output: a wavelet matrix per shard.

Documents are range-partitioned by doc_id once, tokenized in order, and packed into shards of about
SHARD_TOKENS ids (whole documents, so a longer document has a shard of its own). A mixture that is stored in
its order already is tokenized where it lies, in that order, without a shuffle. A shard is one
self-contained compressed file: a header, the documents' ids and offsets, and one bit-plane for each bit of
an id. Planes are cut into blocks of BLOCK bits; each block is compressed alone and has its rank in a
directory, so token access, counting and occurrence lookup decompress a block a level, not the file. Shards
are written by Spark's own writer as rows (part, seq, n_tokens, file), so a lost executor's half-written
shards are never seen and any store that Spark writes to will do; `write_file` gives a bare file.

Defined results: a null or empty text has the end id alone. Repeated doc_ids get a row each, in order of
their text (in stored order: as stored); null doc_ids come first. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written

SHARD_TOKENS = 1 << 20
BLOCK = 1 << 16
SLOTS = 21  # the table of segments has 2^SLOTS places, of 24 bytes and about 8 more of ids
LONG = 50_000  # longer segments kept
END = 2
MAGIC = b"TWM1"
SCHEMA = "part string, seq long, n_tokens long, file binary"


class Encoder:
    """Whole-text encoding that encodes each segment of a text once, as far as a table of bounded size holds.

    Texts are cut where the vocabulary's pre-tokenizer always begins a piece, whatever stands around (see
    _segments), so that segments can be encoded alone. Those of up to 15 bytes are two numbers (the last byte of
    the second is the length), and are found in an open-addressing table by them, whole batches at once; longer
    ones, one by one, in a dictionary. Both start anew when full: they only save repeated work.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_str(vocabulary)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        size = self.tok.get_vocab_size()
        self.bits = max(1, (size - 1).bit_length())
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        names = [self.tok.id_to_token(k) or "" for k in range(size)]
        self.spaced = np.array([t.startswith("\u0120") for t in names])  # how the vocabulary writes a space
        self.line = np.array([t == "\u010a" for t in names])  # and a line end
        self.keys, self.place, self.count = np.zeros((1 << SLOTS, 2), U), np.zeros(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, np.int32)
        self._clear()

    def _clear(self) -> None:
        self.keys[:], self.used = 0, 0
        self.pool, self.full = np.zeros(1 << 16, self.kind), 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _plain(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _keep(self, ids: np.ndarray) -> int:
        """Put ids into the pool; where they start."""
        at, self.full = self.full, self.full + len(ids)
        if self.full > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(self.full, 2 * len(self.pool)) - at, self.kind)])
        self.pool[at : self.full] = ids
        return at

    def _learn(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the pool has each segment's ids, and how many.

        Segments of one leading space, or with a line end after each, are encoded in one call: of their tokens the
        first alone has a space, or the line ends show where they end."""
        place, n = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        spaced = [k for k, t in enumerate(segments) if t[:1] == b" " and len(t) > 1 and not _GAP.search(t, 1)]
        bare = [k for k, t in enumerate(segments) if not _GAP.search(t)]
        rest = set(range(len(segments))).difference(spaced, bare)
        for some, glue, starts in ((spaced, b"", self.spaced), (bare, b"\n", self.line)):
            for k in range(0, len(some), 10_000):
                own = some[k : k + 10_000]
                text = (b"".join([segments[i] + glue for i in own])).decode("utf-8", "surrogatepass")
                ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
                mark = np.flatnonzero(starts[ids])
                if len(mark) != len(own):  # not so in this vocabulary
                    rest.update(own)
                    continue
                lo = np.append(0, mark[:-1] + 1) if glue else mark
                n[own] = mark - lo if glue else np.diff(mark, append=len(ids))
                place[own] = self._keep(ids) + lo
        for k in rest:
            ids = np.array(self._plain(segments[k].decode("utf-8", "surrogatepass")), self.kind)
            place[k], n[k] = self._keep(ids), len(ids)
        return place, n

    def _find(self, k: np.ndarray) -> np.ndarray:
        """Slots of two-number keys; -1 for those that the table doesn't have."""
        slot = (_mix(k[:, 0] ^ _mix(k[:, 1])) >> U(64 - SLOTS)).astype(np.int64)
        out, left = np.full(len(k), -1), np.arange(len(k))
        while len(left):
            have, own = self.keys[slot], k[left]
            hit = (have[:, 0] == own[:, 0]) & (have[:, 1] == own[:, 1])
            out[left[hit]] = slot[hit]
            on = ~hit & (have[:, 1] != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << SLOTS) - 1)
        return out

    def _insert(self, k: np.ndarray, place: np.ndarray, n: np.ndarray) -> None:
        """Distinct keys that the table doesn't have yet."""
        slot = (_mix(k[:, 0] ^ _mix(k[:, 1])) >> U(64 - SLOTS)).astype(np.int64)
        left = np.arange(len(k))
        while len(left):
            free = self.keys[slot, 1] == 0
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.place[slot[put]], self.count[slot[put]] = k[left[put]], place[left[put]], n[left[put]]
            left, slot = left[~put], (slot[~put] + ~free[~put]) & ((1 << SLOTS) - 1)
        self.used += len(k)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as native unsigned integers of self.kind."""
        ids, n = self.joined(texts)
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text's after another's, and how many each text has."""
        if self.used > (1 << SLOTS) // 2 or len(self.long) > LONG or self.full > 8 << SLOTS:
            self._clear()
        odd = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        plain = {k: np.array(self._plain(texts[k]), self.kind) for k in odd}
        raw = [b"" if k in plain else t.encode("utf-8", "surrogatepass") for k, t in enumerate(texts)]
        data = b"\n".join(raw) + b"\n" + bytes(16)
        x = np.frombuffer(data, np.uint8)
        lengths = np.array([len(t) for t in raw], np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        start, end, text = _segments(x, first, lengths)
        size = end - start
        small = size < 16
        k = np.empty((len(start), 2), U)
        words = np.ndarray((len(x) - 7,), "<u8", x.data, 0, (1,))
        k[:, 0] = words[start] & _MASK[np.minimum(size, 8)]
        k[:, 1] = words[np.minimum(start + 8, len(words) - 1)] & _MASK[np.clip(size - 8, 0, 7)] | size.astype(U) << U(56)
        place, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        ask = np.flatnonzero(small & (size > 0))
        slot = self._find(k[ask])
        if len(new := ask[slot < 0]):
            _, one = np.unique(_mix(k[new, 0] ^ _mix(k[new, 1])), return_index=True)  # nearly all repeats go
            one = new[one]
            one = one[self._find(k[one]) < 0]
            self._insert(k[one], *self._learn([data[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]))
            again = self._find(k[new])
            while (again < 0).any():  # different segments of one hash
                one = new[np.flatnonzero(again < 0)[:1]]
                self._insert(k[one], *self._learn([data[int(start[one[0]]) : int(end[one[0]])]]))
                again = self._find(k[new])
            slot[slot < 0] = again
        place[ask], n[ask] = self.place[slot], self.count[slot]
        if len(ask := np.flatnonzero(~small)):
            own = [data[a:b] for a, b in zip(start[ask].tolist(), end[ask].tolist())]
            if new := list(set(own).difference(self.long)):
                self.long.update(zip(new, zip(*(v.tolist() for v in self._learn(new)))))
            place[ask], n[ask] = np.array([self.long[w] for w in own], np.int64).T
        total = np.cumsum(n)
        ids = self.pool[np.repeat(place - total + n, n) + np.arange(total[-1] if len(total) else 0)]
        per = np.bincount(text, n, len(texts)).astype(np.int64)
        if plain:
            cut = np.split(ids, np.cumsum(per)[:-1])
            cut = [plain.get(i, c) for i, c in enumerate(cut)]
            ids, per = np.concatenate(cut), np.array([len(c) for c in cut], np.int64)
        return ids, per


U = np.uint64
#: The low bytes of a number.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return (x ^ (x >> U(29))) * U(0x9E3779B97F4A7C15)


def _segments(x: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every segment. Texts stand one after another in x, with a line end after each.

    A text is cut before a space that a non-space follows, before and after a line end that stands alone between
    others than white space, and between a letter and ASCII punctuation (but an apostrophe)."""
    at = np.flatnonzero((x[:-1] == 32) & ~_BLANK[x[1:]])
    wide = at[_WIDE[x[at + 1]]]  # white space of two or three bytes may follow
    if len(wide):
        blank = [x[i + 1 : i + 4].tobytes().decode("utf-8", "replace")[:1].isspace() for i in wide.tolist()]
        at = at[~np.isin(at, wide[blank])]
    line = np.flatnonzero(x[1:-1] == 10) + 1
    line = line[_SOLID[x[line + 1]] & (_SOLID[x[line - 1]] | _letter(x, line - 1))]
    mark = np.flatnonzero(_PUNCT[x])
    mark = mark[_letter(x, mark - 1)]
    start = np.sort(np.concatenate([first, at, line, line + 1, mark]))
    start = start[np.concatenate([[True], start[1:] != start[:-1]])]
    text = np.searchsorted(first, start, "right") - 1
    ends = (first + lengths)[text]
    end = np.minimum(np.append(start[1:], len(x)), ends)
    inside = (start < ends) | (lengths[text] == 0)
    return start[inside], end[inside], text[inside]


def _letter(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an ASCII or Latin letter ends at these places; False for other letters."""
    at = np.maximum(at, 0)
    own, lead = x[at], x[np.maximum(at - 1, 0)]
    two = (own >= 0x80) & (own < 0xC0) & ((lead >= 0xC3) & (lead <= 0xC8)) & ~((lead == 0xC3) & ((own == 0x97) | (own == 0xB7)))
    return _ALPHA[own] | two


_BLANK, _SOLID, _PUNCT, _ALPHA, _WIDE = np.zeros((5, 256), bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_SOLID[33:127] = True
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_PUNCT[33:127] = ~_ALPHA[33:127]
_PUNCT[[39, *range(48, 58)]] = False
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # how such white space begins
_GAP = re.compile(rb"[\s\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\xaf]|\xe2\x81\x9f|\xe3\x80\x80")  # white space, and a little more


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker; its tables are of fixed size."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def build(ids: np.ndarray, doc_ids: np.ndarray, offsets: np.ndarray, bits: int) -> bytes:
    """The file of a shard; offsets has the start of each document and the end of the last."""
    pack = zstandard.ZstdCompressor(level=1)
    x, zeros, ranks, ends, data = np.ascontiguousarray(ids), [], [], [], []
    blocks = max(1, -(-len(x) // BLOCK))
    for level in reversed(range(bits)):
        b = (x >> x.dtype.type(level) & x.dtype.type(1)).astype(bool)
        z = np.compress(~b, x)
        zeros.append(len(z))
        x = np.concatenate([z, np.compress(b, x)])
        raw = np.packbits(b)
        ones = [np.count_nonzero(b[k * BLOCK : (k + 1) * BLOCK]) for k in range(blocks)]
        ranks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
        for k in range(blocks):
            piece = raw[k * BLOCK // 8 : (k + 1) * BLOCK // 8].tobytes()
            small = pack.compress(piece)
            data.append(small if len(small) < len(piece) else piece)
            ends.append(len(data[-1]))
    head = MAGIC + struct.pack("<QQII", len(ids), len(doc_ids), bits, blocks)
    side = pack.compress(np.concatenate([doc_ids, np.diff(offsets)]).astype("<i8").tobytes())
    return b"".join([head, struct.pack("<Q", len(side)), side, np.array(zeros, "<u8").tobytes(), np.concatenate(ranks).astype("<u8").tobytes(), np.array(ends, "<u4").tobytes(), *data])


class WaveletMatrix:
    """A shard's file, read in place."""

    def __init__(self, file: bytes):
        if file[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.n, docs, self.bits, self.blocks = struct.unpack_from("<QQII", file, 4)
        (side,) = struct.unpack_from("<Q", file, 28)
        self._unpack = zstandard.ZstdDecompressor()
        both = np.frombuffer(self._unpack.decompress(file[36 : 36 + side], max_output_size=max(1, docs * 16)), "<i8") if docs else np.zeros(0, "<i8")
        self.doc_ids, self.offsets = both[:docs], np.concatenate([[0], np.cumsum(both[docs:])])
        at = 36 + side
        self.zeros = np.frombuffer(file, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        self.ranks = np.frombuffer(file, "<u8", self.bits * self.blocks, at).astype(np.int64).reshape(self.bits, self.blocks)
        at += 8 * self.bits * self.blocks
        sizes = np.frombuffer(file, "<u4", self.bits * self.blocks, at).astype(np.int64)
        self._starts = at + 4 * len(sizes) + np.concatenate([[0], np.cumsum(sizes)])
        self._file, self._seen = file, {}

    def _block(self, level: int, k: int) -> np.ndarray:
        """The bits of block k of a plane."""
        i = level * self.blocks + k
        piece = self._file[self._starts[i] : self._starts[i + 1]]
        size = min(BLOCK, self.n - k * BLOCK)
        if len(piece) < -(-size // 8):
            piece = self._unpack.decompress(piece, max_output_size=BLOCK // 8)
        return np.unpackbits(np.frombuffer(piece, np.uint8), count=size)

    def _cached(self, level: int, k: int) -> np.ndarray:
        key = level, k
        if key not in self._seen:
            if len(self._seen) > 4 * self.bits:
                self._seen.clear()
            self._seen[key] = self._block(level, k)
        return self._seen[key]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k = min(i // BLOCK, self.blocks - 1)
        return int(self.ranks[level, k]) + (int(np.count_nonzero(self._cached(level, k)[: i - k * BLOCK])) if self.n else 0)

    def _select(self, level: int, bit: int, j: int) -> int:
        """Where the j-th (from 0) bit of this value stands in a plane."""
        before = self.ranks[level] if bit else np.arange(self.blocks) * BLOCK - self.ranks[level]
        k = int(np.searchsorted(before, j, "right")) - 1
        return k * BLOCK + int(np.flatnonzero(self._cached(level, k) == bit)[j - before[k]])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            k = i // BLOCK
            bit, one = int(self._cached(level, k)[i - k * BLOCK]), self._rank1(level, i)
            out, i = out << 1 | bit, int(self.zeros[level]) + one if bit else i - one
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """How often the id stands in the first `end` positions (all of them by default)."""
        if token < 0 or token >> self.bits:
            return 0
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def find(self, token: int, j: int) -> int:
        """The position of the id's j-th occurrence, from 0."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        i = self._range(token, self.n)[0] + j
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def all(self) -> np.ndarray:
        """Every id, in order: the planes are undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in reversed(range(self.bits)):
            b = np.concatenate([self._block(level, k) for k in range(self.blocks)]).astype(bool) if self.n else np.zeros(0, bool)
            y, z = np.empty_like(x), int(self.zeros[level])
            y[np.flatnonzero(~b)] = x[:z]
            y[np.flatnonzero(b)] = x[z:] | kind(1 << (self.bits - 1 - level))
            x = y
        return x


def write_file(path: str, file: bytes) -> None:
    with open(path + ".part", "wb") as f:
        f.write(file)
    os.replace(path + ".part", path)


def shards(docs: DataFrame, vocabulary_path: str, end: int = END, shard_tokens: int = SHARD_TOKENS, stored: bool = False) -> DataFrame:
    """Rows (part, seq, n_tokens, file); (part, seq) is the order of doc_id or, if stored, of the files that docs is read from."""
    with open(vocabulary_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, a few MB

    def run(batches):
        enc, part, seq, after = encoder(sent.value), None, 0, 0
        names, lengths, parts, have = [], [], [], 0
        stop = enc.kind(end)

        def close():
            nonlocal names, lengths, parts, have
            x, n, ids = np.concatenate(parts), np.concatenate(lengths), np.concatenate(names)
            names, lengths, parts, have = [], [], [], 0
            return pd.DataFrame({"part": [part], "seq": [seq], "n_tokens": [len(x)], "file": [build(x, ids, np.concatenate([[0], np.cumsum(n)]), enc.bits)]})

        for pdf in batches:
            for k in range(0, len(pdf), 500):
                some = pdf.iloc[k : k + 500]
                own = np.array([NULL if pd.isna(d) else int(d) for d in some["doc_id"].tolist()], np.int64)
                ids, n = enc.joined([t or "" for t in some["text"]])
                ids, n = np.insert(ids, np.cumsum(n), stop), n + 1
                files, rows = some["part"].to_numpy(), some["seq"].to_numpy()
                broken = np.append((files[1:] != files[:-1]) | (rows[1:] != rows[:-1] + 1), False)
                while len(n):
                    if names and (files[0] != part or rows[0] != after):
                        yield close()
                    if not names:
                        part, seq = files[0], rows[0]
                    over = (have + np.cumsum(n) >= shard_tokens) | broken
                    m = int(over.argmax()) + 1 if over.any() else len(n)
                    size = int(n[:m].sum())
                    names.append(own[:m])
                    lengths.append(n[:m])
                    parts.append(ids[:size])
                    have, after = have + size, rows[m - 1] + 1
                    own, n, ids, files, rows, broken = own[m:], n[m:], ids[size:], files[m:], rows[m:], broken[m:]
                    if have >= shard_tokens:
                        yield close()
        if names:
            yield close()

    slim = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    if stored:
        rows = docs.select(*slim, F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("seq"))
    else:
        place = F.monotonically_increasing_id()  # the partition, and the row in it
        rows = docs.select(*slim).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        rows = rows.select("doc_id", "text", F.lpad(F.shiftright(place, 33).cast("string"), 10, "0").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"))
    return rows.mapInPandas(run, SCHEMA)


NULL = -(1 << 63)


def read_back(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches):
        for pdf in batches:
            for part, seq, file in zip(pdf["part"], pdf["seq"], pdf["file"]):
                m = WaveletMatrix(file)
                x, o = m.all().astype("<u4"), m.offsets
                crc = [zlib.crc32(x[a:b]) for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
                yield pd.DataFrame({"part": part, "seq": seq, "doc_id": m.doc_ids, "at": o[:-1], "n_tokens": np.diff(o), "ids_crc32": crc})

    rows = files.select("part", "seq", "file").mapInPandas(run, "part string, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition or file
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = files.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("own"))
    base = own.join(before, "part").select("part", "seq", (F.col("before") + F.col("own")).alias("base"))
    return rows.join(base, ["part", "seq"]).select(F.nullif("doc_id", F.lit(NULL)).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, vocabulary_path: str | None = None, stored: bool = False) -> DataFrame:
    """Write the files, in the shared folder, and give what they hold of each document; see shards()."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    with small_batches(docs.sparkSession, 500):
        files = written(shards(docs, str(vocabulary_path), stored=stored), "shards", keep=True)  # the product
    with small_batches(docs.sparkSession, 1):
        return written(read_back(files), "token_file")


def op3_token_file(spark, sf_dir: str) -> DataFrame:
    return token_file(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of a stored mixture, in its order: doc_id, start, n_tokens, ids_crc32 for each copy of a document."""
    return token_file(docs, stored=True)
