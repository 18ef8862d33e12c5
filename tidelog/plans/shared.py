"""The shared folder, the file system behind it, and rankings that no single task computes alone."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Files:
    """Small-file operations on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._none = spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0)
        self.root = root.rstrip("/")

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return p.getFileSystem(self._conf), p

    def names(self, folder: str = "") -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, folder: str) -> None:
        fs, p = self._at(folder)
        fs.mkdirs(p)

    def read(self, name: str) -> str:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def claim(self, name: str) -> bool:
        """Create an empty file; False if it is there already. One of several callers gets True.

        The store decides: creation is exclusive on local disks, HDFS and stores with conditional writes; on a
        store without them two callers within one request's time may both get True."""
        fs, p = self._at(name)
        try:
            if fs.getScheme() == "file":
                self._jvm.java.nio.file.Files.createFile(self._jvm.java.io.File(p.toUri().getPath()).toPath(), self._none)
            else:
                fs.create(p, False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def publish(self, name: str, text: str) -> bool:
        """Write under another name, then rename; False if the name is taken."""
        temp = f".{uuid.uuid4().hex}.tmp"
        fs, p = self._at(temp)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        return self.rename(temp, name)

    def rename(self, name: str, to: str) -> bool:
        fs, p = self._at(name)
        _, q = self._at(to)
        if fs.exists(q) or not fs.rename(p, q):
            fs.delete(p, True)
            return False
        return True

    def size(self, name: str) -> int:
        fs, p = self._at(name)
        return fs.getContentSummary(p).getLength()

    def delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where the session names none and is a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for a while; names have __ for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int):
    """Rows that Python gets at once from now on, for rows that are large."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))


_scopes = threading.local()
BUCKETS = 50_000


def written(df: DataFrame, name: str, by: str | None = None, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    With `by`, rows of one value of that column lie together, in a bucket: a join or a cogroup on it then moves
    the other side alone. The job's shuffle files go when it ends. The table belongs to the innermost tidy()
    function, if there is one; with `keep`, to the user, who deletes it."""
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{own}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        put = df.write.option("compression", "zstd")
        if by:
            n = min(BUCKETS, max(1, df._jdf.queryExecution().toRdd().getNumPartitions()))
            put.bucketBy(n, by).option("path", path).saveAsTable(own)
        else:
            put.parquet(path)
    back = spark.table(own) if by else spark.read.schema(df.schema).parquet(path)
    back._tidelog_path, back._tidelog_table = path, own if by else None
    for own in [] if keep else getattr(_scopes, "open", [])[-1:]:
        own[path] = back
    return back


def drop(*frames: DataFrame) -> None:
    """Delete tables that written() made and no other DataFrame reads any more."""
    for df in frames:
        spark, path = df.sparkSession, getattr(df, "_tidelog_path", None)
        if path:
            for own in getattr(_scopes, "open", []):
                own.pop(path, None)
            if df._tidelog_table:
                spark.sql(f"DROP TABLE IF EXISTS {df._tidelog_table}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(f):
    """Write what f returns, and delete every other table that was written meanwhile, whether f ends well or not."""

    @functools.wraps(f)
    def run(*args, **named):
        scopes = _scopes.__dict__.setdefault("open", [])
        scopes.append({})
        kept = None
        try:
            out = f(*args, **named)
            kept = out if hasattr(out, "_tidelog_path") else written(out, f.__name__)
            return kept
        finally:
            own = scopes.pop()
            if kept is not None:
                own.pop(kept._tidelog_path, None)
                for outer in scopes[-1:]:
                    outer[kept._tidelog_path] = kept
            drop(*own.values())

    return run


def _ranged(df: DataFrame, order: list, without: tuple[str, ...] = ()) -> DataFrame:
    """Range-partitioned and sorted rows with __place, which holds the partition above bit 33."""
    df = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    return written(df.drop(*without).withColumn("__part", F.shiftright("__place", 33)), "ranged")


def ranked(df: DataFrame, *order, name: str = "rn", without: tuple[str, ...] = ()) -> DataFrame:
    """df with its row number from 1 in a total order, less the columns in `without`, which may be those of the order.
    Only one row a partition meets in a single task, and only these rows are sent to the others."""
    rows = _ranged(df, list(order), without)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    first = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__first"))
    number = F.col("__first") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(first), "__part").withColumn(name, number).drop("__part", "__place", "__first", "__n")


def floor_lookup(probes: DataFrame, index: DataFrame, found: str) -> DataFrame:
    """probes (key, ...) with the greatest index key not over theirs, or null, in the column `found`.

    An as-of join: both sides are range-partitioned together, each partition carries the last index key on,
    and the greatest of earlier partitions comes from one row a partition.
    """
    extra = [c for c in probes.columns if c != "key"]
    both = probes.select("key", *extra, F.lit(1).alias("__probe")).unionByName(index.select("key", F.lit(0).alias("__probe")), allowMissingColumns=True)
    rows = _ranged(both, [F.col("key"), F.col("__probe")])
    own = F.when(F.col("__probe") == 0, F.col("key"))
    last = rows.groupBy("__part").agg(F.max(own).alias("__last"))
    before = last.select("__part", F.max("__last").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    near = F.last(own, ignorenulls=True).over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__near", near).where("__probe = 1").join(F.broadcast(before), "__part", "left")
    return rows.select("key", *extra, F.coalesce("__near", "__before").alias(found))
