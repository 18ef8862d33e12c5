import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidelog.llm import token_file as op

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))
TEXTS = ["", " ", "a  b", "tab\t x \n y", "it's  \n\n  we'll 12 34ü ñ  ", " lead", "x y z  w", "<|endoftext|> in text", "trail ", "a word, Word!! x%%% ü... dont't it's, &_- mañana; a1. x_y", "\x1c a \x85b", "long " * 3000, "日本 語 \U0001f600 ok"]


def test_segments_equal_whole_texts():
    enc, whole = op.Encoder(Path(PATH).read_text()), Tokenizer.from_file(PATH)
    for _ in range(2):
        got = [np.frombuffer(x, np.uint16).tolist() for x in enc.encode(TEXTS)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("n", [0, 1, 7, 200_000])
def test_wavelet_matrix(n):
    x = np.random.default_rng(n).zipf(1.3, n).clip(0, 60000).astype(np.uint16)
    m = op.WaveletMatrix(op.build(x, np.array([5, 9]), np.array([0, n // 2, n]), 16))
    assert (m.all() == x).all() and m.doc_ids.tolist() == [5, 9] and m.offsets.tolist() == [0, n // 2, n]
    for i in range(0, n, max(1, n // 50)):
        t = int(x[i])
        assert m.access(i) == t and m.count(t) == (x == t).sum() and m.count(t, i) == (x[:i] == t).sum()
        assert m.find(t, m.count(t, i)) == i
    assert m.count(65535) == 0
    with pytest.raises(IndexError):
        m.access(n)


def test_query(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "null id", 0), (3, None, 0)], "doc_id long, text string, start long")
    whole, got = Tokenizer.from_file(PATH), op.token_file(docs.repartition(3)).collect()
    rows = sorted([(-1, "null id"), (3, ""), *enumerate(TEXTS)])
    start, want = 0, set()
    for d, t in rows:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        want.add((None if d < 0 else d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert op.token_file(docs.limit(0)).count() == 0
