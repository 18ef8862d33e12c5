"""The engine against a dict, through every physical state."""

import random

import pytest

from tidelog.engine import Engine, InvalidKey
from tidelog.sources import manifest as mf

KEYS = ["a", "b", "a-b:c", "[L0]", "s", "e", "𐍈", "～", "k\n", "zz"]


def same(engine, table):
    assert {r["key"]: r["value"] for r in engine.live().collect()} == table
    scanned = [r["key"] for r in engine.scan("", "\U0010ffff").collect()]
    assert scanned == sorted(table, key=str.encode)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine.open(spark, f"file://{tmp_path}/db")


def test_edge_rows(engine):
    engine.write([("PUT", "a", "1"), ("PUT", "a", "2"), ("DELETE", "b", None), ("PUT", "s", ""), ("PUT", "a-b:c", "1"), ("PUT", "𐍈", "x"), ("PUT", "～", "y")])
    for step in (lambda: None, engine.flush, lambda: engine.compact(0), lambda: engine.compact(1)):
        step()
        assert engine.get("a") == (200, "2") and engine.get("b") == (404, None) == engine.get("nope")
        assert engine.get("s") == (404, None) and engine.scan_status("s", "t") == (200, ["s"])
        assert engine.get("a-b:c") == (200, "1")
        assert engine.scan_status("a", "a") == (404, None) == engine.scan_status("z", "a")
        assert engine.scan_status("～", "\U0010ffff") == (200, ["～", "𐍈"])
    with pytest.raises(InvalidKey):
        engine.put("", "1")
    engine.delete("")


def test_traces_in_every_state(spark, tmp_path):
    r = random.Random(1)
    engine, table = Engine.open(spark, f"file://{tmp_path}/db", limits=(2, 2, 15)), {}
    for step in range(8):
        batch = []
        for _ in range(r.randint(1, 15)):
            key = r.choice(KEYS)
            if r.random() < 0.4:
                batch.append(("DELETE", key, None))
                table.pop(key, None)
            else:
                table[key] = str(r.random())
                batch.append(("PUT", key, table[key]))
        engine.write(batch)
        if step % 2:
            engine.flush()
        if step == 5:
            engine.vacuum()
            engine = Engine.open(spark, engine.path, limits=(2, 2, 15))
    same(engine, table)
    engine.flush()
    engine.compact(0)
    engine.compact(1)
    same(Engine.open(spark, engine.path), table)
    assert all(e["level"] == 2 for e in engine.manifest["runs"])
    rows = spark.read.parquet(*[f"{engine.path}/{e['file']}" for e in engine.manifest["runs"]])
    assert rows.where("op = 'DELETE'").count() == 0


def test_tombstones_stay_until_the_bottom(engine, spark):
    engine.put("a", "old")
    engine.flush()
    engine.compact(0)
    engine.compact(1)
    engine.delete("a")
    engine.flush()
    assert engine.get("a") == (404, None)
    engine.compact(0)
    assert engine.get("a") == (404, None)
    engine.compact(1)
    assert engine.get("a") == (404, None) and engine.manifest["runs"] == []
    engine.put("a", "new")
    assert engine.get("a") == (200, "new")


def test_compaction_leaves_files_it_does_not_meet(engine):
    engine.put("a", "1")
    engine.flush()
    engine.compact(0)
    kept = engine.manifest["runs"][0]["file"]
    engine.put("z", "1")
    engine.flush()
    engine.compact(0)
    assert kept in {r["file"] for r in engine.manifest["runs"]} and len(engine.manifest["runs"]) == 2


def test_crashes(engine, spark):
    """What isn't published doesn't count, and what is flushed is not lost before its run is published."""
    engine.put("a", "1")
    engine.flush()
    engine.put("b", "2")
    engine.files.publish("runs/run-99/junk.parquet", "half a run")
    engine.files.make(".batch-9")
    engine.files.publish("wal/batch=7/part.json", '{"operation":"PUT","key":"c","value":"3","pos":0}\n{"operation":"PU\n{"operation":"DELETE","key":"a","value":null,"pos":2}\n')
    again = Engine.open(spark, engine.path)
    same(again, {"b": "2", "c": "3"})
    again.vacuum()
    again.put("d", "4")
    same(Engine.open(spark, engine.path), {"b": "2", "c": "3", "d": "4"})
    assert "run-99" not in again.files.names("runs")


def test_one_writer(engine, spark):
    other = Engine.open(spark, engine.path)
    engine.put("a", "1")
    with pytest.raises(mf.Conflict):
        other.put("a", "2")
    other = Engine.open(spark, engine.path)
    engine.flush()
    with pytest.raises(mf.Conflict):
        other.flush()


def test_snapshots_are_bound_to_a_version(engine):
    engine.put("a", "1")
    engine.flush()
    before = engine.live()
    engine.put("a", "2")
    engine.flush()
    engine.compact(0)
    assert [r["value"] for r in before.collect()] == ["1"] and engine.get("a") == (200, "2")


def test_frames(engine, spark):
    log = spark.createDataFrame([("a", "PUT", "1", 0), ("a", "DELETE", "x", 1), ("b", "PUT", "2", 2)], "key string, op string, value string, pos long")
    engine.append(log)
    same(engine, {"b": "2"})
    got = engine.multi_get(spark.createDataFrame([("a",), ("b",), ("b",)], "key string")).collect()
    assert sorted((r["key"], r["status"]) for r in got) == [("a", 404), ("b", 200), ("b", 200)]
    with pytest.raises(InvalidKey):
        engine.append(spark.createDataFrame([("", "PUT", "1", 0)], log.schema))


def test_micro_batches_count_once(engine, spark):
    batch = lambda v: spark.createDataFrame([("a", "PUT", v, 1)], "key string, op string, value string, seq long")
    assert engine.ingest(batch("1"), "s", 0) and not engine.ingest(batch("2"), "s", 0)
    engine.put("a", "3")
    assert engine.ingest(batch("4"), "s", 1) and engine.get("a") == (200, "4")
    assert not Engine.open(spark, engine.path).ingest(batch("5"), "s", 1)


def test_pushdown(engine):
    engine.write([("PUT", f"k{i:04d}", "v") for i in range(50)])
    engine.flush()
    plan = engine.lookup("k0007")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,k0007)" in plan
    plan = engine.scan("k0001", "k0003")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,k0001)" in plan and "LessThan(key,k0003)" in plan
    assert engine.mutations("x", "y").count() == 0


LOG = "key string, op string, value string, seq long"


def test_a_stream_survives_vacuum_and_a_new_checkpoint_is_a_new_stream(spark, tmp_path):
    from tidelog.streaming import ingest

    engine = Engine.open(spark, f"file://{tmp_path}/db")
    log = spark.readStream.schema(LOG).parquet(f"{tmp_path}/in/*")
    with pytest.raises(ValueError):
        ingest.into(engine, log, "s", f"{engine.path}/.stream")
    for k, checkpoint in enumerate(["one", "one", "two"]):
        spark.createDataFrame([(f"k{k}", "PUT", str(k), k)], LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        ingest.into(engine, log, "s", f"{tmp_path}/{checkpoint}").awaitTermination()
        same(engine, {f"k{i}": str(i) for i in range(k + 1)})
        engine.files.make(".mine")
        engine.vacuum()
        assert ".mine" in engine.files.names()
        engine = Engine.open(spark, engine.path)
    assert len(engine.manifest["streams"]) == 2


def test_racing_writers(spark, tmp_path):
    """Of writers that start from one state, one wins each step, and what it wrote stays whole."""
    from concurrent.futures import ThreadPoolExecutor

    base = f"file://{tmp_path}/db"
    Engine.open(spark, base).put("a", "0")
    for step in ("put", "flush"):
        writers = [Engine.open(spark, base) for _ in range(6)]

        def go(k, step=step, writers=writers):
            try:
                writers[k].put("a", f"{step}{k}") if step == "put" else writers[k].flush()
                return k
            except mf.Conflict:
                return None

        with ThreadPoolExecutor(6) as pool:
            won = [k for k in pool.map(go, range(6)) if k is not None]
        assert len(won) == 1
        value = f"put{won[0]}" if step == "put" else value
        same(Engine.open(spark, base), {"a": value})
    Engine.open(spark, base).vacuum()
    same(Engine.open(spark, base), {"a": value})


def test_claims_without_their_work_leave_gaps(engine, spark):
    engine.put("a", "1")
    engine.files.claim("wal/claim=2")
    engine.files.make("manifest")
    engine.files.claim("manifest/000000000001.claim")
    again = Engine.open(spark, engine.path)
    again.put("b", "2")
    again.flush()
    again.vacuum()
    same(Engine.open(spark, engine.path), {"a": "1", "b": "2"})


def test_writes_flush_a_full_log(spark, tmp_path):
    engine = Engine.open(spark, f"file://{tmp_path}/db", flush_rows=5, flush_batches=3)
    engine.write([("PUT", f"k{i}", "1") for i in range(4)])
    assert engine.manifest["flushed"] == 0
    engine.delete("k0")
    assert engine.manifest["flushed"] == 2 and len(engine.manifest["runs"]) > 0
    for i in range(3):
        engine.put("z", str(i))
    assert engine.manifest["flushed"] == 5
    engine.write([("PUT", "y", "1")] * 3)
    again = Engine.open(spark, engine.path, flush_rows=5)
    again.append(spark.createDataFrame([("x", "PUT", "1", 0), ("x", "PUT", "2", 1)], "key string, op string, value string, pos long"))
    assert again.manifest["flushed"] == 7
    same(again, {"k1": "1", "k2": "1", "k3": "1", "z": "2", "y": "1", "x": "2"})


def test_groups_are_one_batch(engine):
    with engine.group():
        for i in range(10):
            engine.put("a", str(i))
        engine.delete("b")
    assert engine.files.names("wal") == ["batch=1", "claim=1"] and engine.get("a") == (200, "9")
    with pytest.raises(RuntimeError), engine.group():
        engine.put("a", "lost")
        raise RuntimeError
    assert engine.get("a") == (200, "9")


def test_settled_files_are_not_merged_and_lookups_open_few(engine, spark):
    for lo in (0, 100, 200):
        engine.write([("PUT", f"k{lo + i:04d}", "v") for i in range(50)])
        engine.flush()
        engine.compact(0)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(engine.live()) and engine.live().count() == 150
    probes = spark.createDataFrame([("k0105",), ("k0105",), ("k0199",), (None,)], "key string")
    found = engine.multi_get(probes)
    assert sorted((str(r["key"]), r["status"]) for r in found.collect()) == [("None", 404), ("k0105", 200), ("k0105", 200), ("k0199", 404)]
    opened = {f for f in found.inputFiles() if "/runs/" in f}
    meets = [r for r in engine.manifest["runs"] if r["min_key"] <= "k0105" <= r["max_key"]]
    assert {f.rsplit("/", 1)[1] for f in opened} == {r["file"].rsplit("/", 1)[1] for r in meets} and len(meets) < len(engine.manifest["runs"])
    engine.write([("DELETE", "k0101", None), ("PUT", "k0102", "new")])
    alone, rest = engine._settled(engine.manifest["runs"], engine._tail())
    assert alone and rest and all(r["min_key"] <= "k0102" and r["max_key"] >= "k0101" for r in rest)
    assert engine.live().count() == 149 and engine.get("k0102") == (200, "new")
    assert engine.multi_get(spark.createDataFrame([("k0101",), ("k0102",)], "key string")).where("status = 200").count() == 1


def test_killed_in_the_middle(spark, tmp_path):
    """A process that puts, flushes and compacts is killed at any moment; nothing that it reported is lost."""
    import os
    import subprocess
    import sys
    import time

    code = f"""
import sys
from pyspark.sql import SparkSession
from tidelog.engine import Engine
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
db = Engine.open(spark, "file://{tmp_path}/db", limits=(2, 2, 15), flush_batches=3)
for i in range(10000):
    db.put(f"k{{i % 7}}", str(i))
    print("done", i, file=sys.stderr, flush=True)
"""
    with open(tmp_path / "said", "w") as said:
        run = subprocess.Popen([sys.executable, "-c", code], stderr=said, stdout=subprocess.DEVNULL, env=os.environ, start_new_session=True)
    done = lambda: [int(x.split()[1]) for x in (tmp_path / "said").read_text().split("\n")[:-1] if x.startswith("done ")]
    ends = time.time() + 150
    while len(done()) < 8 and time.time() < ends:
        time.sleep(0.1)
    os.killpg(run.pid, 9)
    run.wait()
    n = max(done()) + 1
    assert n >= 8
    engine = Engine.open(spark, f"file://{tmp_path}/db")
    found = {r["key"]: int(r["value"]) for r in engine.live().collect()}
    tables = [{f"k{i % 7}": i for i in range(m)} for m in (n, n + 1)]  # the last put may be there without a report
    assert found in tables
    engine.vacuum()
    engine.put("after", "1")
    engine.flush()
    again = Engine.open(spark, engine.path)
    assert {r["key"] for r in again.live().collect()} == {*found, "after"}


def test_logs_of_frames_are_compressed_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidelog.engine.LOG_ROWS", 10)
    engine = Engine.open(spark, f"file://{tmp_path}/db")
    engine.append(spark.range(25).coalesce(1).selectExpr("concat('k', id % 20) as key", "'PUT' as op", "cast(id as string) as value", "id as pos"))
    engine.put("k1", "new")
    assert sum(n.endswith(".json.gz") for n in engine.files.names("wal/batch=1")) == 3
    table = {f"k{i % 20}": str(i) for i in range(25)} | {"k1": "new"}
    same(engine, table)
    engine.flush()
    same(Engine.open(spark, engine.path), table)
