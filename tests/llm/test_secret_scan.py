import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import secret_scan as op

KEY = "AKIA" + "Z9" * 10


def brute(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m.group(2)) > 5:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) > 19]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) > 23]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "toKen", "token", "API_KEY", "apikey", "ſecret", "secret", " ", ":", "=", '"', "'", "abc", "0f" * 12, "0f" * 11, "AKIA", "A1" * 8, "é", "\n", "x"]), max_size=20).map("".join))
def test_base_spans(text):
    assert op.scan(text)[0] == brute(text) and set(op.scan(text)[0]) <= set(op.scan(text)[1])


def wrap(r, text):
    kind = r.choice(["b64", "url64", "gzip", "zlib", "url", "u", "x"])
    raw = text.encode()
    if kind == "b64":
        return base64.b64encode(raw).decode()
    if kind == "url64":
        return base64.urlsafe_b64encode(raw).decode().rstrip("=")
    if kind in ("gzip", "zlib"):
        return base64.b64encode(gzip.compress(raw) if kind == "gzip" else zlib.compress(raw)).decode()
    if kind == "url":
        return "".join(f"%{b:02X}" for b in raw)
    if kind == "u":
        return "".join(f"\\u{ord(c):04x}" for c in text)
    return "".join(f"\\x{b:02x}" for b in raw)


def test_nested_layers_map_to_the_document():
    r = random.Random(8)
    for _ in range(200):
        inner = f"the key {KEY} ok"
        for _ in range(r.randint(1, 5)):
            inner = wrap(r, inner)
        text = f"före {inner} efter"
        spans = [(a, b) for a, k, b in op.scan(text)[1] if k == 1]
        assert len(spans) == 1 and 5 <= spans[0][0] < spans[0][1] <= 5 + len(inner), inner
        assert KEY not in op.redact(text)


def test_escapes_map_exactly():
    text = "a password%3D%22hunter22%22 z"
    assert op.scan(text)[1] == [(2, 0, 2 + len("password%3D%22hunter22"))]
    assert op.redact(text) == "a [secret]%22 z"
    assert op.scan(urllib.parse.quote("é token=Жabcdefg"))[1] == []


def test_cycles_and_bombs_end():
    bomb = base64.b64encode(zlib.compress(b"a" * (op.MAX_LAYER + 1))).decode()
    assert op.scan(bomb)[0] == op.scan(bomb)[1]
    assert op.scan("%2525252525%25%41" * 50)[1] == []


def test_query(spark):
    rows = [(1, None, 1), (2, "", 2), (None, f"token: abcdef {KEY}", 3), (4, "deadbeef" * 3 + " x" * 60000, 4), (4, "deadbeef" * 3, 4)]
    got = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in op.secrets(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    two = f"assign:0:13,access:14:{14 + len(KEY)}"
    assert got == {(1, 0, 0, 0, sha(""), ""), (2, 0, 0, 0, sha(""), ""), (None, 1, 1, 0, sha(two), two), (4, 0, 0, 1, sha("hex:0:24"), "hex:0:24")}


def test_layers_of_any_characters_are_scanned():
    for odd in ("10\u202f000 \u00a0", "\u3000", "a\u200bb", "\ufeff", "\f", "\0" * 300):
        for raw in (f"{odd} {KEY} ok".encode(), f"{odd} {KEY} ok".encode() + b"\xe9t\xe9"):
            url, x = "".join(f"%{b:02X}" for b in raw), "".join(f"\\x{b:02x}" for b in raw)
            for inner in (base64.b64encode(raw).decode(), base64.b64encode(gzip.compress(raw)).decode(), url, x, base64.b64encode(url.encode()).decode()):
                assert [k for _, k, _ in op.scan(f"a {inner} z")[1]] == [1], (odd, inner)
    assert [k for _, k, _ in op.scan("\\ud800" + "".join(f"\\u{ord(c):04x}" for c in KEY))[1]] == [1]


def test_wrapped_base64():
    r = random.Random(5)
    for _ in range(300):
        inner = f"{'é' * r.randrange(80)} {r.randbytes(r.randrange(200)).hex(' ')} the key {KEY} ok"
        raw = r.choice([bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress])(inner.encode())
        code, n = base64.b64encode(raw).decode(), r.choice([19, 64, 76])
        if len(code) <= n:
            continue
        run = r.choice(["\n", "\r\n", "\n  ", "\\n"]).join(code[i : i + n] for i in range(0, len(code), n))
        for text in (f"före\n\n{run}\n\nefter", f"-----BEGIN X MESSAGE-----\n{run}\n-----END X MESSAGE-----\n", f"key: {run}", "%0A".join(f"a\n{run}\n".split("\n"))):
            spans = [(a, b) for a, k, b in op.scan(text)[1] if k == 1]
            assert spans and all(a < b <= len(text) for a, b in spans), text
            assert run in text.replace("%0A", "\n") and base64.b64encode(raw)[-9:].decode() not in op.redact(text), text


def test_partly_escaped_compression():
    r = random.Random(6)
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        for _ in range(40):
            raw = pack(f"{r.randbytes(r.randrange(60)).hex(' ')} the key {KEY} ok".encode())
            for run in (urllib.parse.quote(raw), urllib.parse.quote_plus(raw), repr(raw)[2:-1]):
                text = f"å https://x.y/?q={run} z"
                at = len("å https://x.y/?q=")
                assert [x for x in op.scan(text)[1] if x[1] == 1] == [(at, 1, at + len(run))], text


def test_every_member_is_unpacked():
    packs = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress]
    for p in packs:
        for q in packs:
            raw = p(b"first member") + q(f"the key {KEY} ok".encode()) + p(b"last")
            for text in (base64.b64encode(raw).decode(), "".join(f"%{b:02X}" for b in raw), urllib.parse.quote(raw)):
                assert op.scan(f"a {text} z")[1] == [(2, 1, 2 + len(text))], (p, q)
            both = base64.b64encode(p(b"x" * 50) + f" {KEY}".encode()).decode()
            assert op.scan(both)[1] == [(0, 1, len(both))]
    cut = base64.b64encode(gzip.compress((KEY + " " + random.Random(1).randbytes(4000).hex(" ")).encode())[:-900]).decode()
    assert op.scan(cut)[1] == [(0, 1, len(cut))]


def test_oversized_layers_are_scanned(spark):
    big = b"z " * (op.MAX_LAYER // 2 + op.PIECE) + KEY.encode() + b" z" * op.PIECE
    texts = [base64.b64encode(p(big)).decode() for p in (gzip.compress, bz2.compress, zstandard.compress, lzma.compress)]
    texts.append(base64.b64encode(gzip.compress(big[: op.MAX_LAYER + 2]) + f" {KEY}".encode()).decode())
    texts.append(urllib.parse.quote(gzip.compress(big)))
    got = op.secrets(spark.createDataFrame(list(enumerate(f"a {t} z" for t in texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["spans"] for r in got} == {i: f"access:2:{2 + len(t)}" for i, t in enumerate(texts)}
    assert all(op.redact(f"a {t} z") == "a [secret] z" for t in texts[:2])
    edge = base64.b64encode(zlib.compress(b"z" * (17 * op.PIECE - 9) + KEY.encode() + b" z")).decode()
    assert [k for _, k, _ in op.scan(edge, oversized=True)[1]] == [1]


def test_chains_of_escapes_take_one_step():
    import time

    for chain in ("%" + "25" * 100_000, "\\" + "x5c" * 60_000, "\\" + "u005C" * 40_000):
        began = time.process_time()
        base, every = op.scan(f"a {chain} z")
        assert time.process_time() - began < 2 and set(base) <= set(every)
    inner = f"{KEY}%41"
    for _ in range(6):
        inner = inner.replace("%", "%25")
    assert [k for _, k, _ in op.scan("a" + "%2525252541" + "KIA" + "Z9" * 10)[1]] == [1]
    text = "x " + "%25252541KIA" + "Z9" * 10 + " y"
    assert op.scan(text)[1] == [(2, 1, len(text) - 2)]


def test_forged_frames_and_long_lines(spark):
    import tracemalloc

    assert op.scan("KLUv/eAAAAAAACAAAAEAAA==", oversized=True) == ([], [])
    rows = [(1, "KLUv/eAAAAAAACAAAAEAAA=="), (2, "x" * 300_000 + f" %41{KEY[1:]}")]
    got = {r["doc_id"]: r["n_access"] for r in op.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0} and op.secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    tracemalloc.start()
    assert [k for _, k, _ in op.scan("x" * 2_000_000 + f" %41{KEY[1:]}")[1]] == [1]
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_oversized_layers_are_searched_as_smaller_ones(monkeypatch):
    """What is found doesn't depend on MAX_LAYER, and so on no layer's size; nested layers, wide gaps and inlined content included."""
    r = random.Random(9)
    monkeypatch.setattr(op, "PIECE", 300)
    monkeypatch.setattr(op, "REPEAT", 1 << 7)
    monkeypatch.setattr(op, "_REPEATS", op.re.compile(rb"([\s\S])\1{255,}"))
    b64 = lambda x: base64.b64encode(x).decode()
    wrap = lambda t, n: "\n".join(t[i : i + n] for i in range(0, len(t), n))
    noise = lambda n: "".join(r.choice(["word ", "Next, ", "a+b/c ", "100% ", "x\n", "; ", "token ", "é", "= ", ": ", "> ", "  ", "BZh9", "\\", "q" * 40]) for _ in range(n))
    hits = 0
    for _ in range(150):
        inner = r.choice([KEY, "deadbeef" * 4, "token" + " " * r.randrange(700) + "=" + " " * r.randrange(700) + "abcdef1", 'passwd=token": abcdefgh', "secret=" + "v" * r.randrange(1000)])
        form = r.choice([str, lambda t: b64(t.encode()), lambda t: wrap(b64((t + noise(40)).encode()), 60), lambda t: "".join(f"%{c:02X}" for c in t.encode()), lambda t: b64(gzip.compress(t.encode())), lambda t: urllib.parse.quote(gzip.compress(t.encode())), lambda t: b64(b64(t.encode()).encode())])
        raw = (noise(r.randrange(200)) + r.choice(["", " ", "\n", "\0" * 900]) + form(inner) + r.choice(["", " ", "\n", " " * 900]) + noise(r.randrange(200))).encode()
        raw = r.choice([bytes, bytes, gzip.compress])(raw)
        packed = r.choice([gzip.compress, zlib.compress, bz2.compress])(raw)
        if r.random() < 0.2:
            packed += f" {KEY}".encode()
        text = r.choice(["a ", "token=", "secret: "]) + r.choice([b64(packed), "".join(f"%{c:02X}" for c in packed), urllib.parse.quote(packed)]) + " z"
        monkeypatch.setattr(op, "MAX_LAYER", 1 << 24)
        want = op.scan(text, oversized=True)
        monkeypatch.setattr(op, "MAX_LAYER", 100)
        assert op.scan(text, oversized=True) == want, (raw, text)
        hits += len(want[1]) > len(want[0])
    assert hits > 75


def test_layers_below_oversized_ones():
    pad = ("some words, and more. " * 50 + "\n") * (op.MAX_LAYER // 1100 + 1)
    deep = base64.b64encode(gzip.compress(f"the key {KEY} ok".encode())).decode()
    gap = f"token{' ' * 100_000}= {'abcdef' * 3}"
    for inner, kind in ((deep, 1), (gap, 0), ("".join(f"%{b:02X}" for b in KEY.encode()), 1)):
        text = base64.b64encode(gzip.compress(f"{pad} {inner} {pad}".encode())).decode()
        assert op.scan(text, oversized=True)[1] == [(0, kind, len(text))]
