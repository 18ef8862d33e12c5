import hashlib
import math

import duckdb

from tidelog.llm import poisson_mix as op
from tidelog.llm.queries import QUERIES, SQL


def test_counts_follow_weights_and_survive_odd_rows(spark):
    rows = [(d, "x" * 10, "hot" if d % 3 else f"s{d % 6}", d) for d in range(6000)] + [(None, "yy", None, 1), (9001, None, "hot", 2), (9002, "", "void", 3), (1, "x" * 10, "hot", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int").repartition(4)
    got = op.mix(docs, {"hot": 1.0, "s0": 3.0}).collect()
    chars = {s: sum(len(r["text"] or "") for r in got if r["source"] == s) for s in ("hot", "s0")}
    assert abs(chars["s0"] / chars["hot"] - 3) < 0.3 and {r["source"] for r in got} == {"hot", "s0"}
    assert abs(sum(chars.values()) / 60000 - 1) < 0.1
    assert [r["mix_order"] for r in got] == sorted(r["mix_order"] for r in got)
    assert sorted(got) == sorted(op.mix(docs.repartition(7), {"hot": 1.0, "s0": 3.0}).collect())
    twice = [r for r in got if r["doc_id"] == 1 and r["mix_copy"] == 1]
    assert len(twice) in (0, 2)
    assert op.mix(docs.limit(0)).count() == 0


def test_inversion_is_the_poisson_distribution(spark):
    docs = spark.createDataFrame([("a", 1.0)], "source string, x double").selectExpr("source", "repeat('t', 1000) text")
    for mean in (0.3, 4.0, 900.5):
        r = op.rates(docs, None, mean).first()
        rest, total = mean - r["whole"], 0.0
        for k, step in enumerate(r["steps"][:40]):
            total += math.exp(-rest + k * math.log(rest) - math.lgamma(k + 1))
            assert abs(step - total) < 1e-9
        assert r["steps"][-1] > 1 - 1e-9


def test_the_whole_mixture_carries_every_column_in_order(spark):
    data = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    df = QUERIES["op1_poisson_mix_whole"](spark, data)
    got = df.collect()
    assert df.columns == [*spark.read.parquet(f"{data}/documents.parquet").columns, "mix_copy", "mix_order"]
    assert all(tuple(r)[:-2] == tuple(docs[r["doc_id"]]) for r in got)
    assert [r["mix_order"] for r in got] == sorted(hashlib.md5(f"{op.SEED}:order:{r['doc_id']}:{r['mix_copy']}".encode()).hexdigest() for r in got)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(SQL["op1_poisson_mix_whole"]).fetchall())
    few = sorted(tuple(r) for r in QUERIES["op1_poisson_mix"](spark, data).collect())
    assert few == sorted((r["doc_id"], r["source"], r["n_chars"], r["mix_copy"], r["mix_order"]) for r in got)


def test_large_rates_stay_poisson(spark):
    docs = spark.createDataFrame([("a", 1.0)], "source string, x double").selectExpr("source", "repeat('t', 1000) text")
    for mean in (220.0, 599.9, 600.1, 5000.5, 40000.0):
        r = op.rates(docs, None, mean).first()
        ks = range(r["whole"], r["whole"] + len(r["steps"]))
        ps = [math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in ks]
        total = 0.0
        for p, step in zip(ps, r["steps"]):
            total += p
            assert abs(step - total) < 1e-8
        middle = sum(k * p for k, p in zip(ks, ps))
        steps = [0.0, *r["steps"]]
        variance = sum((k - middle) ** 2 * (b - a) for k, a, b in zip(ks, steps, steps[1:]))
        assert abs(middle / mean - 1) < 1e-6 and abs(variance / mean - 1) < 1e-5


def test_names_that_clash_and_ties(spark):
    rows = [(d, "t" * (d % 5), "s", d, 1, 2, 3, "c", "o") for d in range(300)] + [(7, "other text", "s", 1, 1, 2, 3, "c", "o")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `__steps` int, `key` int, whole int, part int, MIX_COPY string, mix_order string").repartition(5)
    one, two = op.mix(docs, epochs=3.0), op.mix(docs.repartition(2), epochs=3.0)
    assert one.columns == ["doc_id", "text", "source", "__steps", "key", "whole", "part", "mix_copy", "mix_order"]
    got = [tuple(r) for r in one.collect()]
    assert got == [tuple(r) for r in two.collect()] and len(got) > 600  # repeated rows are equal, so the order is whole
    assert [r[-1] for r in got] == sorted(r[-1] for r in got)


def test_sql_of_the_queries(spark):
    data = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = QUERIES["op1_poisson_mix"](spark, data)
    cur = db.execute(SQL["op1_poisson_mix"])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
