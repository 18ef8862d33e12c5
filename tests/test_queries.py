"""Each query with SQL equals DuckDB over the smallest tables."""

import duckdb
import pytest

from tidelog.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = db.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_scan_is_in_byte_order(spark):
    keys = [r["key"] for r in QUERIES["scan_range"](spark, DATA).collect()]
    assert keys == sorted(keys) and len(keys) == 202


def test_sequence_is_unique(spark):
    from tidelog.plans.log import log_lineitem

    log = log_lineitem(spark, DATA)
    assert log.select("seq").distinct().count() == log.count()
