"""Codecs, traces, rankings and lookups on small hand-made rows."""

import random
from bisect import bisect_right

from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import lww, runs
from tidelog.plans import trace
from tidelog.plans.shared import floor_lookup, ranked, settings, written
from tidelog.streaming import ingest


def test_ranks_are_global(spark):
    values = random.Random(0).sample(range(10**6), 3000)
    got = ranked(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), F.col("v")).collect()
    assert {r["v"]: r["rn"] for r in got} == {v: i + 1 for i, v in enumerate(sorted(values))}


def test_floor_lookup(spark):
    r = random.Random(3)
    index, keys = sorted({f"{r.randrange(500):03d}" for _ in range(60)}), [f"{r.randrange(500):03d}" for _ in range(400)]
    got = floor_lookup(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i int").repartition(5), spark.createDataFrame([(k,) for k in index], "key string"), "near").collect()
    assert len(got) == 400
    for row in got:
        at = bisect_right(index, keys[row["i"]])
        assert row["near"] == (index[at - 1] if at else None)


def test_bloom_filter(spark):
    assert codec.bloom_size(2000) == (19171, 7) and codec.bloom_size(0)[0] == 64 and codec.bloom_size(1)[1] == 16
    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    bloom = codec.bloom_build(keys, 19171, 7)
    assert codec.bloom_probe(keys, bloom, 19171, 7).count() == 2000
    assert codec.bloom_probe(keys.select(F.concat("key", F.lit("x")).alias("key")), bloom, 19171, 7).count() < 60


def shuffled(spark):
    """Rows and bytes written to shuffles so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    own = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in own), sum(s.shuffleWriteBytes() for s in own)


def test_large_bloom_filters_shuffle_a_short_row_a_key(spark):
    """Not a bitmap for each task, nor a row for each bit."""
    n = 300_000
    m, k = codec.bloom_size(n)
    keys = spark.range(n, numPartitions=64).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        start = shuffled(spark)
        bloom = written(codec.bloom_build(keys, m, k), "bloom")
        built = shuffled(spark)
        assert codec.bloom_probe(keys, bloom, m, k).count() == n
        probed = shuffled(spark)
        assert codec.bloom_probe(keys.select(F.concat("key", F.lit("?")).alias("key")), bloom, m, k).count() < 1.2 * codec.FALSE_POSITIVES * n
    assert built[0] - start[0] == n and built[1] - start[1] < 24 * n
    assert probed[0] - built[0] < 1.01 * n


def test_rankings_and_lookups_shuffle_rows_once(spark):
    """What is ranked moves by range alone, however large it is; columns that only order the rows aren't kept."""
    n = 5000
    rows = spark.range(n, numPartitions=8).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("key"), F.struct((n - F.col("id")).alias("a"), "id").alias("seq"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        start = shuffled(spark)
        got = ranked(rows, F.col("seq"), without=("seq",))
        assert got.columns == ["key", "rn"] and {r["key"]: r["rn"] for r in got.collect()} == {f"k{i:05d}": n - i for i in range(n)}
        sorted_once = shuffled(spark)
        near = floor_lookup(rows.select("key"), rows.where("seq.id % 10 = 0").select("key"), "near")
        assert {r["key"]: r["near"] for r in near.collect()} == {f"k{i:05d}": f"k{i // 10 * 10:05d}" for i in range(n)}
        looked_up = shuffled(spark)
    assert sorted_once[0] - start[0] < 1.1 * n
    assert looked_up[0] - sorted_once[0] < 2.3 * n  # 1.1 n rows by range, then again for the window over a range's rows


def test_logs_round_trip_and_skip_bad_lines(spark):
    rows = [("PUT", 'q"\\\n𐍈', ""), ("DELETE", "k", None), ("PUT", "", "v")]
    lines = spark.createDataFrame(rows, "op string, key string, value string").select(codec.log_line().alias("line"))
    assert all('"value":' in r["line"] for r in lines.collect())
    torn = spark.createDataFrame([('{"operation":"PUT","key":"a"',), ("",), ("null",), ('{"operation":"X","key":"a","value":"1"}',)], "line string")
    assert sorted(map(tuple, codec.parse_log(lines.union(torn)).collect()), key=str) == sorted(rows, key=str)


def test_null_values_of_tombstones_win(spark):
    log = spark.createDataFrame([("a", "PUT", "1", 1), ("a", "DELETE", None, 2), ("b", "DELETE", None, 1), ("b", "PUT", "", 2)], "key string, op string, value string, seq int")
    assert [tuple(r) for r in lww.live(log).collect()] == [("b", "")]
    assert sorted(map(tuple, lww.latest(log).collect())) == sorted(map(tuple, lww.latest_by_window(log).collect()))


def test_trace_grammar(spark):
    lines = ["PUT a b c", "GET a b NOT_FOUND", "DELETE x y", "SCAN a b k1, k2", "SCAN a b k1,k2", "say PUT k v", "nothing", "PUT k NOT_FOUND"]
    got = [tuple(r)[1:] for r in trace.parse(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")).orderBy("line_no").collect()]
    assert got == [("PUT", "a b", None, "c"), ("GET", "a b", None, ""), ("DELETE", "x y", None, None), ("SCAN", "a", "b", "k1,"), ("SCAN", "a", "b", "k1,k2"), ("PUT", "k", None, "v"), ("INVALID", None, None, None), ("PUT", "k", None, "")]


def test_splits_and_overlaps(spark):
    keys = spark.createDataFrame([(f"{i:05d}",) for i in range(4500)], "key string")
    files = runs.split(keys).orderBy("file").collect()
    assert [r["n"] for r in files] == [2000, 2000, 500] and files[1]["min_key"] == "02000"
    bad = spark.createDataFrame([(0, "a", "m"), (1, "m", "p"), (2, "q", "z")], "file long, min_key string, max_key string")
    assert [tuple(r) for r in runs.overlapping(bad).collect()] == [(0, 1)]


def test_streaming_state(spark, tmp_path):
    schema = "key string, op string, value string, seq long"
    for k, rows in enumerate([[("a", "PUT", "2", 5)], [("a", "PUT", "1", 1), ("b", "DELETE", None, 2)], [("b", "PUT", "x", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ingest.latest_state(log).writeStream.outputMode("complete").format("memory").queryName("state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("state").collect())) == [("a", "PUT", "2"), ("b", "DELETE", None)]


def test_tidy_leaves_what_is_returned(spark):
    import os

    from tidelog.plans import shared

    @shared.tidy
    def inner(df):
        shared.written(df, "waste")
        return shared.written(df, "inner")

    @shared.tidy
    def outer(df):
        back = inner(df)
        return shared.written(back.repartition(3, "id"), "outer", "id").where("id < 5")

    @shared.tidy
    def fails(df):
        shared.written(df, "waste")
        raise RuntimeError

    root = shared.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(root))
    out = outer(spark.range(10))
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2, 3, 4]
    try:
        fails(spark.range(3))
    except RuntimeError:
        pass
    assert len(set(os.listdir(root)) - before) == 1 and not any(t.name.startswith("outer_") for t in spark.catalog.listTables())
    shared.drop(out)
    assert set(os.listdir(root)) == before


def test_no_local_folder_on_a_cluster(spark):
    import pytest

    from tidelog.plans import shared

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared.shared_dir(Session)


def test_runs_of_json_lines_end_at_a_bad_one(spark):
    lines = ['{"key":"a","value":"1"}', '{"key":"b","value":null}', '{"key":"c"', '{"key":"d","value":"2"}']
    rows = [(r, k, x) for r, own in (("x", lines), ("y", lines[:2]), ("z", lines[2:])) for k, x in enumerate(own)]
    got = codec.parse_run(spark.createDataFrame(rows, "run string, line_no int, line string"), "run").collect()
    assert sorted((r["run"], r["key"], r["value"]) for r in got) == [("x", "a", "1"), ("x", "b", None), ("y", "a", "1"), ("y", "b", None)]


def test_scan_replay(spark):
    lines = ["PUT a 1", "PUT c 2", "SCAN a z a,c", "DELETE a", "SCAN a z c", "SCAN a z a, c", "SCAN z a NOT_FOUND", "PUT a 3", "PUT b NOT_FOUND", "SCAN a c a,b", "SCAN d e d", "SCAN c d c"]
    got = trace.replay_scans(trace.parse(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"))).orderBy("line_no").collect()
    assert [(r["line_no"], r["actual"], r["ok"]) for r in got] == [(2, "a,c", True), (4, "c", True), (5, "c", False), (6, "", False), (9, "a,b", True), (10, "", False), (11, "c", True)]
