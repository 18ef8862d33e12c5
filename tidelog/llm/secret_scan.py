"""Operator 9, secret scans: a worklist that unwraps encoded layers and rescans each.

The text itself is the first layer. Lines with URL or Unicode escapes, and runs of base64, become layers of
their own once decoded; bytes that are compressed (gzip, zlib, bzip2, xz, zstd) are unpacked on the way. Each
new layer is scanned with the same patterns and searched for layers in turn, to the fixpoint; a layer whose
content and place were seen before ends there, so cycles do. Every character of a layer knows which span of
the document it came from, and so a match maps back: exactly through escapes, to the whole run through
base64 and compression. Decoded layers are scanned whatever they hold; bytes that are not UTF-8 match nothing.
Base64 is also joined over line ends, as encoders wrap it, and compressed bytes of which an encoder escaped only
some (URL quoting, Python's repr) are unpacked from their line; both map to the whole run.

Spans of the text itself are the base; layers only add to them. Kinds, in order: assign, access, hex. A span
is the whole match, in code points, end exclusive.

Defined results: null text is empty; no match gives zero counts, an empty string of spans and the SHA-256 of
nothing. Repeated rows get a row each; extra columns are ignored; an empty table gives no rows. A layer that
unpacks to over MAX_LAYER bytes is read as a stream, to its end, in segments of about PIECE bytes, cut only where no
match, escape, line with escapes or run of base64 goes on; each is scanned and searched for layers like any other,
so the spans are those of the whole. scan() alone leaves such a layer as it is unless told otherwise. What can't be
cut (a line with escapes, a run of base64, content that is compressed again) is held whole, but for long repeats of
one byte. Concatenated members are all unpacked, and damaged ones as far as they go. Very long texts are scanned
whole; a line with escapes takes 16 bytes a character for its places. A chain of one escape (%2525...) is peeled in
one step, without the layers between.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MAX_LAYER = 1 << 24
PIECE, REPEAT = 1 << 20, 1 << 16
KINDS = ("assign", "access", "hex")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need no match
#: Escapes of an escape's own first character, any number of times over, are peeled off at once.
_ESCAPE = re.compile(r"%(?:25){2,}|\\(?:x5[cC]){2,}|\\(?:u005[cC]){2,}|(?:%[0-9A-Fa-f]{2})+|(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}")
_CHAIN = re.compile(r"%(?:25){2,}|\\(?:x5[cC]){2,}|\\(?:u005[cC]){2,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t>]*|(?:\\r)?\\n")  # also as JSON writes it
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:[ \t]*+\r?\n[ \t>]*+|(?:\\r)?\\n)[A-Za-z0-9+/_-]++)++={{0,2}}")
_PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
_QUOTED = re.compile(r"%([0-9A-Fa-f]{2})")
_PLUS = re.compile(r"%([0-9A-Fa-f]{2})|(\+)")  # form encoding: + is a space
_REPR = re.compile(r"""\\x([0-9A-Fa-f]{2})|\\([abfnrtv0\\'"])""")
_SPACE = re.compile(rb"\s")
#: Bytes after which no match or layer goes on if their line has no escapes before them: line ends that join no base64,
#: bytes that nothing is made of, and single spaces apart from : and =.
_CUT = re.compile(
    rb"""\n(?=[ \t>]*[^ \t>A-Za-z0-9+/_-])|(?<=[^A-Za-z0-9+/_\t \r-])\n"""
    rb"""|[^A-Za-z0-9+/_.=:"'%\\ \t\r\n>(^\x01\x08\x1f-]|(?<=[^:=\t\r\n> ])\x20(?=[^:=\t\r\n> ])"""
)
_MARK = re.compile(rb"%|\\|" + _PACKED.pattern)
_REPEATS = re.compile(rb"([\s\S])\1{%d,}" % (2 * REPEAT - 1))
_DAMAGE = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)
_SHORT = dict(zip("abfnrtv0+", b"\a\b\f\n\r\t\v\0 "))


def _mentions(low: str) -> bool:
    return any(k in low for k in _KEYS)


def matches(text: str):
    """(start, kind's number, end) of every match in one layer."""
    if ("=" in text or ":" in text) and _mentions(text.lower()):
        yield from ((m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6)
    if "AKIA" in text:
        yield from ((m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20)
    yield from ((m.start(), 2, m.end()) for m in _HEX.finditer(text))


class Packed:
    """Compressed bytes, unpacked in pieces of bounded size, member after member.

    Once the pieces are read, `used` is the number of bytes they took, and `sound` whether the last member ended well."""

    def __init__(self, data: bytes):
        self.data, self.used, self.sound = memoryview(data), 0, True

    def pieces(self):
        self.used, self.sound, at = 0, True, 0
        while (d := _decoder(self.data[at:])) is not None:
            try:
                yield from _member(d, self.data[at:])
                if not d.eof:
                    raise EOFError
            except _DAMAGE:
                self.sound = bool(at)
                return
            self.used = at = len(self.data) - len(d.unused_data)
            while at < len(self.data) and not self.data[at]:  # padding
                at += 1
        self.sound = self.used > 0

    def rest(self) -> bytes:
        """What follows the members."""
        return bytes(self.data[self.used :]) if self.sound else b""

    def again(self) -> list[str | Packed] | None:
        """What the content unpacks to, if it is compressed again."""
        head = b""
        for piece in self.pieces():
            head += piece
            if len(head) >= PIECE:
                break
        return contents(b"".join(self.pieces())) if any(True for _ in Packed(head).pieces()) else None

    def parts(self):
        """The content, in segments that nothing spans; or, if it is compressed again, what that unpacks to."""
        if (got := self.again()) is not None:
            yield from got
            return
        last = b""
        for own in segments(self.pieces()):
            if own != last:
                yield _utf8(own)
            last = own

    def ends(self) -> str | None:
        """The first segment and the last, between which nothing goes on; None if these bytes aren't one text."""
        if (got := self.again()) is not None:
            one = _one(got)
        else:
            first = last = None
            for own in segments(self.pieces()):
                first, last = own if first is None else first, own
            one = _utf8(first if first is last else first + b"\0" + last)
        return one if self.sound and not self.rest() else None


def _cut(data: bytes) -> int:
    """The last place to cut, or 0; in a line with escapes, or with compressed bytes that may have some, it is before them."""
    hi = len(data)
    while hi > 0:
        start = data.rfind(b"\n", 0, hi) + 1
        stop = m.start() if (m := _MARK.search(data, start, hi)) else hi
        least = max(0, start - 1)
        for lo in {max(least, stop - REPEAT): 0, least: 0}:
            if at := [m.end() for m in _CUT.finditer(data, lo, stop)]:
                return at[-1]
        hi = start - 1
    return 0


def segments(pieces):
    """The bytes cut where nothing goes on. Repeats of one byte too long to be cut lose a multiple of REPEAT of it,
    which keeps what they match, and how they decode."""
    data, need = b"", PIECE
    for piece in pieces:
        data += piece
        if len(data) < need:
            continue
        if k := _cut(data):
            yield data[:k]
            data = data[k:]
        elif not _MARK.search(data):
            data = _REPEATS.sub(lambda m: m[1] * (REPEAT + len(m[0]) % REPEAT), data)
        need = max(PIECE, 2 * len(data))
    if data:
        yield data


class _Zstd:
    """zstd's decoder with the attributes of the others; what follows the frame is unused."""

    def __init__(self):
        self.d, self.unused_data = zstandard.ZstdDecompressor().decompressobj(), b""

    @property
    def eof(self):
        return self.d.eof

    def run(self, data):
        for i in range(0, len(data), 64):  # a few bytes can hold a block of 128 KB
            if out := self.d.decompress(data[i : i + 64]):
                yield out
            if self.eof:
                self.unused_data = data[min(len(data), i + 64) - len(self.d.unused_data) :]
                return


def _decoder(data):
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    return _Zstd() if data[:4] == b"\x28\xb5\x2f\xfd" else None


def _member(d, data):
    if isinstance(d, _Zstd):
        yield from d.run(data)
        return
    while not d.eof:
        out = d.decompress(data, PIECE)
        data = getattr(d, "unconsumed_tail", b"")  # zlib's; the others keep it
        if out:
            yield out
        elif not data and getattr(d, "needs_input", True):
            return


def unpack(data: bytes) -> tuple[bytes | None, Packed] | None:
    """Compressed bytes unpacked once (None if that is over MAX_LAYER), and their reader; None if they give nothing."""
    packed, out, n = Packed(data), [], 0
    for piece in packed.pieces():
        out.append(piece)
        n += len(piece)
        if n > MAX_LAYER:
            return None, packed
    return (b"".join(out), packed) if n or packed.used else None


def _utf8(data: bytes) -> str:
    """The bytes as text; those that aren't UTF-8 stay as lone surrogates."""
    return data.decode("utf-8", "surrogateescape")


def contents(data: bytes) -> list[str | Packed]:
    """The bytes' texts through any compression; content over MAX_LAYER as its reader. What surrounds sound members, and damaged ones themselves, are texts too."""
    out, seen = [], set()
    while (got := unpack(data)) is not None:
        if got[0] is None:
            return [*out, got[1]]
        if (key := hashlib.sha256(got[0]).digest()) in seen:
            break
        seen.add(key)
        if (rest := got[1].rest() if got[1].sound else data):
            out.append(_utf8(rest))
        data = got[0]
    return [*out, _utf8(data)]


def readable(data: bytes) -> str:
    """The one text in the bytes, through compression; else the bytes themselves as text."""
    return _utf8(data) if (one := _one(contents(data))) is None else one


def _one(got: list[str | Packed]) -> str | None:
    return None if len(got) != 1 else got[0] if isinstance(got[0], str) else got[0].ends()


def _unescape(run: str) -> str | None:
    if _CHAIN.fullmatch(run):
        return run[0]
    if run[0] == "%":
        return readable(bytes.fromhex(run.replace("%", "")))
    if run[1] == "x":
        return readable(bytes.fromhex(run.replace("\\x", "")))
    try:
        if run[1] == "u":
            return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "surrogatepass")
        return chr(int(run[2:], 16))
    except (UnicodeDecodeError, ValueError, OverflowError):
        return None


def _base64(run: str) -> list[str | Packed]:
    core = run.rstrip("=")
    if len(core) % 4 == 1:  # no whole byte in the last
        core = core[:-1]
    try:
        return contents(base64.b64decode(core.replace("-", "+").replace("_", "/") + "=" * (-len(core) % 4), validate=True))
    except (binascii.Error, ValueError):
        return []


def _joined(text: str):
    """(start, end, run) of base64 runs joined over line ends: all lines, all but the first, and those of one width with the last one's rest."""
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    for m in _WRAPPED.finditer(text):
        gaps = np.fromiter((k for gap in _BREAK.finditer(text, *m.span()) for k in gap.span()), kind).reshape(-1, 2)
        first, end = np.append(kind(m.start()), gaps[:, 1]), np.append(gaps[:, 0], kind(m.end()))
        n, width = len(first), end - first
        cuts = np.concatenate([[0], np.flatnonzero(width[1:] != width[:-1]) + 1, [n]])
        a, b = np.concatenate([[[0, n]], [[1, n]], np.stack([cuts[:-1], np.minimum(n, cuts[1:] + 1)], 1)]).T
        total = np.append(0, np.cumsum(width))
        on = (b - a > 1) & (total[b] - total[a] >= 16)
        lo, hi = first[a[on]], end[b[on] - 1]
        for i, j in zip(lo.tolist(), hi.tolist()) if len(lo) > 3 else sorted(set(zip(lo.tolist(), hi.tolist()))):
            yield i, j, _BREAK.sub("", text[i:j])


def _quoted(text: str):
    """(start, end, layer) of compressed bytes that an encoder escaped only in part, found in each line that has escapes."""
    for form in (_QUOTED, _PLUS, _REPR):
        if ("\\x" if form is _REPR else "%") not in text or form is _PLUS and "+" not in text:
            continue
        hi = -1
        for m in form.finditer(text):
            if m.start() < hi:
                continue
            lo, hi = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            hi = len(text) if hi < 0 else hi
            data, at, k = bytearray(), [], lo
            for e in form.finditer(text, lo, hi):
                data += text[k : e.start()].encode("ascii", "replace")
                data.append(int(e[1], 16) if e[1] else _SHORT.get(e[2], ord(e[2])))
                at.append((k, e.start() + 1))
                k = e.end()
            data += text[k:hi].encode("ascii", "replace")
            data, done = bytes(data), 0
            if not _PACKED.search(data):
                continue
            at = np.concatenate([np.arange(*x) for x in [*at, (k, hi + 1)]])
            for p in _PACKED.finditer(data):
                if (a := p.start()) < done or (got := unpack(memoryview(data)[a:])) is None:
                    continue
                out, packed = got
                if out is None:
                    for _ in packed.pieces():  # to its end
                        pass
                b = done = a + packed.used
                if not packed.sound:
                    b, done = (gap.start() if (gap := _SPACE.search(data, a)) else len(data)), a + 1
                for layer in contents(data[a:b] if packed.sound else data[a:]):
                    yield int(at[a]), int(at[b]), layer


def layers(text: str, where):
    """The layers one step below: (text or reader, places). places: a span of the document, or an array with the span of each character."""
    at = where if isinstance(where, np.ndarray) else None

    def spans(lo: int, hi: int) -> np.ndarray:
        """The places of these characters."""
        if at is not None:
            return at[lo:hi]
        k = np.arange(lo, hi)
        return np.stack([k, k + 1], 1)

    def place(a: int, b: int) -> tuple[int, int]:
        return where if isinstance(where, tuple) else (int(at[a, 0]), int(at[b - 1, 1])) if at is not None else (a, b)

    if "%" in text or "\\" in text:
        runs: dict[tuple[int, int], list] = {}
        lo, hi = 0, -1
        for m in _ESCAPE.finditer(text):
            if (got := _unescape(m[0])) is not None:
                if m.start() > hi:
                    lo, hi = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
                    hi = len(text) if hi < 0 else hi
                runs.setdefault((lo, hi), []).append((m.start(), m.end(), got))
        for (lo, hi), own in runs.items():
            parts, places, k = [], [], lo
            for a, b, got in [*own, (hi, hi, "")]:
                parts += [text[k:a], got]
                if not isinstance(where, tuple):
                    places.append(spans(k, a))
                    if got:
                        places.append(_spread(a, b, got, spans))
                k = b
            yield "".join(parts), where if isinstance(where, tuple) else np.concatenate(places)

    if "%" in text or "\\x" in text:
        for a, b, got in _quoted(text):
            yield got, place(a, b)
    for m in _BASE64.finditer(text):
        for got in _base64(m[0]):
            yield got, place(*m.span())
    if "\n" in text or "\\n" in text:
        for a, b, run in _joined(text):
            for got in _base64(run):
                yield got, place(a, b)


def _spread(a: int, b: int, got: str, spans) -> np.ndarray:
    """Places of an escape run's characters: their own escapes if these line up, else the whole run."""
    own = spans(a, b)
    for sizes in ([len(c.encode("utf-8", "replace")) * w for c in got] for w in (3, 4)):
        if sum(sizes) == b - a:
            break
    else:
        sizes = [6 * (len(c.encode("utf-16-be", "replace")) // 2) for c in got]
    if sum(sizes) != b - a:
        return np.tile([own[0, 0], own[-1, 1]], (len(got), 1))
    ends = np.cumsum(sizes)
    return np.stack([own[ends - sizes, 0], own[ends - 1, 1]], 1)


def scan(text: str | None, oversized: bool = False) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base and all spans, each (start, kind's number, end), sorted; of layers over MAX_LAYER only if `oversized`."""
    text = text or ""
    base = sorted(matches(text))
    found, read = set(base), set()
    _search(list(layers(text, None)), found, read if oversized else None)
    return base, sorted(found)


def _search(work: list, found: set, read: set | None) -> None:
    """Adds the spans of these layers and of all below them. read: the readers that were met, or None to leave them."""
    seen, work = set(), [iter(work)]
    while work:
        if (got := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, where = got
        if isinstance(layer, Packed):
            key = (hashlib.sha256(layer.data).digest(), where)
            if read is not None and key not in read:
                read.add(key)
                for part in layer.parts():
                    _search([(part, where)], found, read)
                    if all((where[0], k, where[1]) in found for k in range(len(KINDS))):
                        break  # all that any layer there can add
                else:
                    work.append(iter([(_utf8(layer.rest() if layer.sound else bytes(layer.data)), where)]))
            continue
        key = (hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest(), where if isinstance(where, tuple) else (*where[0].tolist(), *where[-1].tolist()) if len(where) else ())
        if key in seen or not layer:
            continue
        for a, k, b in matches(layer):
            found.add((where[0], k, where[1]) if isinstance(where, tuple) else (int(where[a, 0]), k, int(where[b - 1, 1])))
        below = layers(layer, where)
        if (got := next(below, None)) is not None:
            seen.add(key)
            work.append(chain([got], below))


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                base, every = scan(t, oversized=True)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, hashlib.sha256(_text(base).encode()).hexdigest(), _text(every)))
            cols = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            out = pd.DataFrame(rows, columns=cols)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with every span, of any layer, replaced."""
    if text is None:
        return None
    out, end = [], 0
    for a, _, b in scan(text, oversized=True)[1]:
        if a >= end:
            out += [text[end:a], mask]
        end = max(end, b)
    return "".join([*out, text[end:]])


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
