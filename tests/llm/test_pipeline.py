import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog.llm import decontaminate, language_id, minhash_join, poisson_mix
from test_minhash_join import brute

DATA = "/root/testdata/sf0.001"


def test_run_equals_its_stages_by_plain_code(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols = docs.columns
    got = sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()))
    kept = language_id.stage(spark, docs, DATA).select(cols)
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert len(rows) > 0.95 * docs.count()
    want = {d for d, _, c in brute([(d, r["text"]) for d, r in rows.items()], 5, 80) if d == c}
    left = minhash_join.stage(spark, kept, DATA)
    assert {r["doc_id"] for r in left.collect()} == want
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    leaks = {r["doc_id"] for r in decontaminate.contaminated(left, bench).collect()}
    clean = left.where(~left["doc_id"].isin(sorted(leaks)))
    mixed = poisson_mix.mix(clean.select(cols)).orderBy("mix_order").collect()
    tok, start, out = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), 0, []
    for r in mixed:  # the token files are in the mixture's order
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 2]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(out)
    order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order == [r["doc_id"] for r in mixed] and order != sorted(order)
    assert sorted(r["doc_id"] for r in poisson_mix.stage(spark, clean, DATA).collect()) == sorted(order)


ODD = [(1, "the and of a plain text about nothing in particular " * 3, "en", "web", 9), (1, "the and of a plain text about nothing in particular " * 3, "en", "web", 9), (2, None, None, None, None), (3, "", "en", None, 0), (None, "the null id has a text of its own here", "en", "web", 1), (4, "der und die das ein langer Text " * 9000, "de", "book", 5), (5, "12 34 !?", None, "web", 7)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_every_stage_takes_odd_rows(spark, name, stage, tmp_path):
    """Null and empty and very long texts, repeated rows, empty tables, and extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, rows in enumerate((ODD, [])):
        docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema + ", mix_order int, answer string, `rid` int")
        docs.write.parquet(f"{tmp_path}/{k}")
        out = stage(spark, spark.read.parquet(f"{tmp_path}/{k}"), DATA)
        got = [tuple(r) for r in out.collect()]
        if name == "token_id_output":
            assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and len(got) == len(rows)
            assert sorted((str(d), n == 1) for d, _, n, _ in got) == sorted((str(r[0]), not r[1]) for r in rows)
        else:
            assert out.columns == [c.split()[0] for c in schema.split(", ")]
            assert set(got) <= set(rows)
        if rows and name == "language_id":
            assert sorted(r[0] for r in got if r[0] is not None) == [1, 1, 4]
        if rows and name in ("minhash_near_dedup", "benchmark_decontamination"):
            assert sorted(got, key=str) == sorted(rows, key=str)
