"""The engine: an ordered key-value table over a mutation log, kept under one directory.

    wal/batch=N/        JSON lines (operation, key, value, pos), each batch claimed, then published by a rename;
                        those of a DataFrame are compressed
    runs/run-N-*/       Parquet, sorted by key, with a Bloom filter on it
    manifest/V.json     which files are live, in which level, and up to which batch the log is flushed

Reads merge the live files with the log's batches after the flushed one; the newest mutation of a key wins. Files
of a lower level that meet no other file and no logged key are settled: they are read as they are, without a
merge. A log of FLUSH_ROWS mutations or FLUSH_BATCHES batches is flushed by the write that fills it.

Order of work makes crashes harmless: a batch is visible once renamed; a run counts once a manifest names it;
only then is what it replaces deleted, by vacuum(). A DataFrame returned by a read stays bound to one
manifest version. One writer at a time: the first to claim a batch or a version wins, the other fails and leaves
nothing that a read sees (see Files.claim for the stores that this holds on). A point read is a Spark job: batch
lookups into multi_get(), and small writes into group().
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codec import FALSE_POSITIVES, LEVEL_LIMITS
from tidelog.operators import lww, reads
from tidelog.plans.log import DELETE, PUT
from tidelog.plans.shared import Files, written
from tidelog.sources import manifest as mf

LOG_SCHEMA = "operation string, key string, value string, pos bigint, batch bigint"
BOTTOM = len(LEVEL_LIMITS) - 1
FLUSH_ROWS, FLUSH_BATCHES = 2000, 200
LOG_ROWS = 1_000_000  # mutations of a file of an append: compressed files are read whole, by one task each
FEW_KEYS = 10_000  # distinct keys of a lookup that are held against the files' ranges one by one
BLOOM_KEYS = 1_000_000  # distinct keys a row group is expected to hold


class InvalidKey(ValueError):
    """An empty key in a PUT; nothing is stored."""


class Engine:
    def __init__(self, spark: SparkSession, path: str, limits: tuple[int, ...] = LEVEL_LIMITS, rows_per_file: int | None = None, flush_rows: int = FLUSH_ROWS, flush_batches: int = FLUSH_BATCHES):
        self.spark, self.path, self.limits, self.rows_per_file = spark, path.rstrip("/"), limits, rows_per_file
        self.flush_rows, self.flush_batches = flush_rows, flush_batches
        self.files = Files(spark, self.path)
        self.files.make("wal")
        self.files.make("runs")
        self.manifest = mf.load(self.files)
        self._next = max([self.manifest["flushed"], *self._batches(), *self._claims()]) + 1
        self._logged: int | None = None  # rows of the tail, once known
        self._held: list | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Engine:
        return cls(spark, path, **options)

    # Writes

    def _batches(self) -> list[int]:
        return [int(n.removeprefix("batch=")) for n in self.files.names("wal") if n.startswith("batch=")]

    def _claims(self) -> list[int]:
        return [int(n.removeprefix("claim=")) for n in self.files.names("wal") if n.startswith("claim=")]

    def _publish_batch(self, temp: str, rows: int) -> None:
        before = self._tail_rows()
        if not (self.files.claim(f"wal/claim={self._next}") and self.files.rename(temp, f"wal/batch={self._next}")):
            self.files.delete(temp)
            raise mf.Conflict(f"batch {self._next} is taken")
        self._next += 1
        self._logged = before + rows
        if self._logged >= self.flush_rows or len(self._after()) >= self.flush_batches:
            self.flush()

    def _tail_rows(self) -> int:
        """Mutations in the log that aren't flushed; counted once, after opening."""
        if self._logged is None:
            tail = self._tail()
            self._logged = tail.count() if tail is not None else 0
        return self._logged

    def write(self, mutations: Iterable[tuple[str, str, str | None]]) -> None:
        """Append (op, key, value) mutations, in order, as one batch."""
        rows = [(op, key, value if op == PUT else None) for op, key, value in mutations]
        if any(op == PUT and not key for op, key, _ in rows):
            raise InvalidKey("PUT with an empty key")
        if any(op not in (PUT, DELETE) or key is None or op == PUT and value is None for op, key, value in rows):
            raise ValueError("mutations are (PUT, key, value) or (DELETE, key, None)")
        if self._held is not None:
            self._held += rows
        elif rows:
            temp = f".batch-{uuid.uuid4().hex}"
            self.files.make(temp)
            self.files.publish(f"{temp}/part.json", "".join(json.dumps({"operation": op, "key": key, "value": value, "pos": i}, ensure_ascii=False) + "\n" for i, (op, key, value) in enumerate(rows)))
            self._publish_batch(temp, len(rows))

    @contextmanager
    def group(self):
        """What is put and deleted within becomes one batch at the end; nothing, if an exception ends it."""
        if self._held is not None:
            raise ValueError("a group is open")
        self._held = []
        try:
            yield self
            rows = self._held
        finally:
            self._held = None
        self.write(rows)

    def put(self, key: str, value: str) -> None:
        self.write([(PUT, key, value)])

    def delete(self, key: str) -> None:
        self.write([(DELETE, key, None)])

    def append(self, log: DataFrame) -> None:
        """Append a DataFrame (key, op, value, pos) as one batch; pos orders the mutations of a key.

        The frame is evaluated once: rows are checked while they are written, and a bad one undoes the batch."""
        bad = F.expr("op = 'PUT' and (key = '' or value is null) or key is null or op is null or op not in ('PUT', 'DELETE')")
        temp, seen = f".batch-{uuid.uuid4().hex}", Observation()
        log = log.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"))
        log.select(F.col("op").alias("operation"), "key", F.when(F.col("op") == PUT, F.col("value")).alias("value"), F.col("pos").cast("long").alias("pos")).write.option("ignoreNullFields", "false").option("compression", "gzip").option("maxRecordsPerFile", LOG_ROWS).json(f"{self.path}/{temp}")
        if seen.get["bad"]:
            self.files.delete(temp)
            raise InvalidKey("a PUT with an empty key or no value, or an unknown operation")
        self._publish_batch(temp, seen.get["n"])

    # Reads

    def _after(self) -> list[int]:
        """Batches that aren't flushed."""
        return [b for b in self._batches() if b > self.manifest["flushed"]]

    def _tail(self) -> DataFrame | None:
        after = self._after()
        if not after:
            return None
        rows = self.spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").option("basePath", f"{self.path}/wal").json([f"{self.path}/wal/batch={b}" for b in after])
        good = rows.where("operation in ('PUT', 'DELETE') and key is not null")  # a malformed line is skipped
        return good.select("key", F.col("operation").alias("op"), "value", F.struct(F.lit(BOTTOM + 1).alias("level"), "batch", "pos").alias("seq"))

    def _runs(self, runs: list[dict]) -> list[DataFrame]:
        """A DataFrame for each level 0 run and for each lower level, with its recency."""
        groups: dict[tuple[int, int], list[str]] = {}
        for r in runs:
            groups.setdefault((BOTTOM - r["level"], r["pos"] if r["level"] == 0 else 0), []).append(f"{self.path}/{r['file']}")
        schema = "key string, op string, value string"
        return [self.spark.read.schema(schema).parquet(*paths).select("*", F.struct(F.lit(level).alias("level"), F.lit(pos).cast("long").alias("batch"), F.lit(0).cast("long").alias("pos")).alias("seq")) for (level, pos), paths in groups.items()]

    def _meeting(self, start: str | None, end: str | None) -> list[dict]:
        """Live files that [start, end) may meet."""
        low, high = (None if x is None else x.encode("utf-8", "surrogatepass") for x in (start, end))
        return [r for r in self.manifest["runs"] if (low is None or r["max_key"].encode() >= low) and (high is None or r["min_key"].encode() < high)]

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], "key string, op string, value string, seq struct<level: int, batch: bigint, pos: bigint>")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def mutations(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Every mutation that a read may need; files that [start, end) can't meet are not opened."""
        tail = self._tail()
        return self._union([*self._runs(self._meeting(start, end)), *([tail] if tail is not None else [])])

    def _settled(self, runs: list[dict], tail: DataFrame | None) -> tuple[list[dict], list[dict]]:
        """Files that meet no other file and no key of the tail, and the rest. Keys are unique within a file."""
        ranges = [(r["min_key"].encode(), r["max_key"].encode(), r) for r in runs]
        if tail is not None:
            row = tail.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
            if row["lo"] is not None:
                ranges.append((row["lo"].encode(), row["hi"].encode(), None))
        alone, rest, group, reach = [], [], [], b""
        for lo, hi, r in sorted(ranges, key=lambda x: x[:2]):
            if group and lo > reach:
                (alone if len(group) == 1 and group[0] else rest).extend(x for x in group if x)
                group, reach = [], b""
            group.append(r)
            reach = max(reach, hi)
        (alone if len(group) == 1 and group[0] else rest).extend(x for x in group if x)
        return alone, rest

    def _live(self, runs: list[dict], keys: DataFrame | None = None) -> DataFrame:
        """key, value of the live keys in these files and the tail; of `keys` alone, if given."""
        tail = self._tail()
        alone, rest = self._settled(runs, tail)
        some = (lambda df: df.join(keys, "key", "left_semi")) if keys is not None else (lambda df: df)
        parts = [lww.live(some(self._union([*self._runs(rest), *([tail] if tail is not None else [])])))] if rest or tail is not None else []
        if alone:
            paths = [f"{self.path}/{r['file']}" for r in alone]
            parts.append(some(self.spark.read.schema("key string, op string, value string").parquet(*paths).where(F.col("op") == PUT).select("key", "value")))
        return self._union(parts) if parts else lww.live(self._union([]))

    def live(self) -> DataFrame:
        return self._live(self.manifest["runs"])

    def lookup(self, key: str) -> DataFrame:
        return reads.get(lww.live(self.mutations(key, key + "\0")), key)

    def get(self, key: str) -> tuple[int, str | None]:
        """(200, value), or (404, None) if the key is missing, deleted or, as the two are one, empty."""
        row = self.lookup(key).first()
        return (200, row["value"]) if row and row["status"] == 200 else (404, None)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """key, value, status for each row of keys. Files that none of the keys can be in are not opened, and only
        mutations of these keys are merged."""
        wanted = written(keys.select("key").where("key is not null").distinct(), "wanted")
        n = wanted.count()
        if n <= FEW_KEYS:
            own = sorted(r["key"].encode("utf-8", "surrogatepass") for r in wanted.collect())
            runs = [r for r in self.manifest["runs"] if (k := bisect_left(own, r["min_key"].encode())) < n and own[k] <= r["max_key"].encode()]
            wanted = F.broadcast(wanted)
        else:
            row = wanted.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
            runs = self._meeting(row["lo"], row["hi"] + "\0")
        return reads.multi_get(self._live(runs, wanted), keys)

    def scan(self, start: str, end: str) -> DataFrame:
        """Live keys in [start, end), ascending."""
        return reads.scan(lww.live(self.mutations(start, end)), start, end)

    def scan_status(self, start: str, end: str) -> tuple[int, list[str] | None]:
        """(200, keys), or (404, None) if there are none. All keys come to the driver: for wide ranges use scan()."""
        keys = [r["key"] for r in self.scan(start, end).toLocalIterator()]
        return (200, keys) if keys else (404, None)

    # Maintenance

    def _store(self, rows: DataFrame, level: int, pos: int, manifest: dict) -> tuple[list[dict], dict]:
        """Write a run; its manifest entries, and the manifest with its id used up."""
        run = manifest["next_run"]
        folder = f"runs/run-{run}-{uuid.uuid4().hex[:8]}"  # no other writer's
        writer = rows.select("key", "op", "value").repartitionByRange("key").sortWithinPartitions("key").write
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(BLOOM_KEYS)).option("parquet.bloom.filter.fpp#key", str(FALSE_POSITIVES))
        if self.rows_per_file:
            writer = writer.option("maxRecordsPerFile", self.rows_per_file)
        writer.parquet(f"{self.path}/{folder}")
        back = self.spark.read.schema("key string").parquet(f"{self.path}/{folder}").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        found = back.groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).collect()  # a row for each file
        entries = [{"level": level, "pos": pos, "run_id": run, "file": f"{folder}/{r['file']}", "min_key": r["lo"], "max_key": r["hi"], "n": r["n"]} for r in found]
        return sorted(entries, key=lambda e: e["min_key"].encode()), manifest | {"next_run": run + 1}

    def _flushed(self, rows: DataFrame, **changes) -> None:
        pos = max((r["pos"] for r in self.manifest["runs"] if r["level"] == 0), default=0) + 1
        entries, new = self._store(rows, 0, pos, self.manifest)
        self.manifest = mf.publish(self.files, new | {"runs": [*new["runs"], *entries]} | changes)

    def flush(self) -> bool:
        """The log's tail becomes a run of level 0, tombstones kept; then full levels are compacted."""
        tail, upto = self._tail(), self._next - 1
        if tail is None:
            return False
        self._flushed(lww.latest(tail), flushed=upto)
        self._logged = 0
        self.maintain()
        return True

    def ingest(self, batch: DataFrame, stream: str, batch_id: int) -> bool:
        """A micro-batch (key, op, value, seq) becomes a run, once: its id is published with the run.

        The log's tail is flushed first, so that what came before stays older."""
        if self.manifest["streams"].get(stream, -1) >= batch_id:
            return False
        self.flush()
        self._flushed(lww.latest(batch), streams=self.manifest["streams"] | {stream: batch_id})
        self.maintain()
        return True

    def _size(self, level: int) -> int:
        """Runs of level 0, files of the others."""
        own = [r for r in self.manifest["runs"] if r["level"] == level]
        return len({r["run_id"] for r in own}) if level == 0 else len(own)

    def maintain(self) -> None:
        for level in range(BOTTOM):
            if self._size(level) >= self.limits[level]:
                self.compact(level)

    def compact(self, level: int) -> bool:
        """Merge a level into the next. Files of the next level that meet none of its keys stay as they are;
        tombstones go only at the bottom, where nothing older is left to shadow."""
        if not 0 <= level < BOTTOM:
            raise ValueError(f"level {level} has none below it")
        own = [r for r in self.manifest["runs"] if r["level"] == level]
        if not own:
            return False
        low, high = min(r["min_key"].encode() for r in own), max(r["max_key"].encode() for r in own)
        met = [r for r in self.manifest["runs"] if r["level"] == level + 1 and r["min_key"].encode() <= high and r["max_key"].encode() >= low]
        parts = self._runs([*own, *met])
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        merged = lww.latest(rows)
        if level + 1 == BOTTOM:
            merged = merged.where("op = 'PUT'")
        entries, new = self._store(merged, level + 1, 0, self.manifest)
        gone = {r["file"] for r in (*own, *met)}
        self.manifest = mf.publish(self.files, new | {"runs": [r for r in new["runs"] if r["file"] not in gone] + entries})
        return True

    def vacuum(self) -> list[str]:
        """Delete runs that no file of the manifest is in, flushed batches, older manifests and what crashes left of
        writes: only what the engine itself makes."""
        live = {r["file"].split("/")[1] for r in self.manifest["runs"]}
        gone = [f"runs/{n}" for n in self.files.names("runs") if n.startswith("run-") and n not in live]
        gone += [f"wal/batch={b}" for b in self._batches() if b <= self.manifest["flushed"]]
        gone += [f"wal/claim={b}" for b in self._claims() if b <= self.manifest["flushed"]]
        gone += [f"{mf.FOLDER}/{n}" for n in self.files.names(mf.FOLDER) if 0 <= mf._number(n) < self.manifest["version"]]
        gone += [f"{mf.FOLDER}/{n:012d}.claim" for n in mf.claims(self.files) if n < self.manifest["version"]]
        gone += [n for n in self.files.names() if n.startswith(".batch-") or n.startswith(".") and n.endswith(".tmp")]
        for name in gone:
            self.files.delete(name)
        return gone
