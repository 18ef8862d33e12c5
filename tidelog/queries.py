"""The catalogue: a Spark query for each operation, and its SQL over the same tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.engine import Engine
from tidelog.functions import codec
from tidelog.operators import lww, reads, runs
from tidelog.plans import log as logs
from tidelog.plans import trace
from tidelog.plans.shared import floor_lookup, shared_dir, written
from tidelog.sources import manifest
from tidelog.streaming import ingest

N = 1000  # mutations of a run, in these queries
POINT, START, END = "k00000001", "k00000100", "k00000400"

L = """WITH L AS (SELECT 'k'||lpad(CAST(l_orderkey AS VARCHAR),8,'0') AS key,
  CASE WHEN l_returnflag='R' THEN 'DELETE' ELSE 'PUT' END AS op,
  CASE WHEN l_returnflag<>'R' THEN CAST(l_partkey AS VARCHAR) END AS value, l_returnflag, l_linestatus,
  row_number() OVER (ORDER BY l_shipdate,l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS rn
  FROM lineitem),
LW AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rn DESC) AS r FROM L) WHERE r=1),
LIVE AS (SELECT key, value FROM LW WHERE op='PUT'),
PROBES AS (SELECT 'k'||lpad(CAST(o_orderkey AS VARCHAR),8,'0') AS key FROM orders)"""
RUNS = f""", RUNS AS (SELECT run, key, op, value FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY rn DESC) AS q
  FROM (SELECT *, (rn-1)//{N} AS run FROM L)) WHERE q=1)"""
SPLITS = f""", SPLITS AS (SELECT file, min(key) AS min_key, max(key) AS max_key, count(*) AS n
  FROM (SELECT key, (row_number() OVER (ORDER BY key)-1)//{codec.SPLIT} AS file FROM LW) GROUP BY file)"""
INDEX = f""", IX AS (SELECT rn, key FROM (SELECT key, row_number() OVER (ORDER BY key) AS rn FROM LIVE) WHERE (rn-1)%{codec.STRIDE}=0)"""
EVENTS = """WITH E AS (SELECT 'u'||lpad(CAST(user_id AS VARCHAR),6,'0') AS key, event_type, props, event_id FROM events),
EW AS (SELECT key, CASE WHEN event_type='error' THEN 'DELETE' ELSE 'PUT' END AS op, CASE WHEN event_type<>'error' THEN props END AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS r FROM E) WHERE r=1)"""
STATUS = "CASE WHEN coalesce(value,'')='' THEN 404 ELSE 200 END AS status"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def probes(spark, sf_dir):
    """A key for each order; about half were never written."""
    return logs.table(spark, sf_dir, "orders").select(logs.key_of("k", "o_orderkey", 8).alias("key"))


@query(f"{L} SELECT key, value FROM LIVE")
def latest_state(spark, sf_dir):
    return lww.live(logs.log_lineitem(spark, sf_dir))


@query(f"{L} SELECT key, value FROM LIVE")
def latest_state_window(spark, sf_dir):
    return lww.latest_by_window(logs.log_lineitem(spark, sf_dir)).where("op = 'PUT'").select("key", "value")


@query(f"{L} SELECT key FROM LIVE WHERE key>='{START}' AND key<'{END}' ORDER BY key")
def scan_range(spark, sf_dir):
    return reads.scan(lww.live(logs.log_lineitem(spark, sf_dir)), START, END)


@query(f"{L} SELECT key FROM LIVE WHERE key>='{END}' AND key<'{START}'")
def scan_empty(spark, sf_dir):
    return reads.scan(lww.live(logs.log_lineitem(spark, sf_dir)), END, START)


@query(f"{L} SELECT key, value, {STATUS} FROM LIVE WHERE key='{POINT}'")
def get_point(spark, sf_dir):
    return reads.get(lww.live(logs.log_lineitem(spark, sf_dir)), POINT)


@query(f"{L} SELECT p.key, value, {STATUS} FROM PROBES p LEFT JOIN LIVE USING (key)")
def multi_get_status(spark, sf_dir):
    return reads.multi_get(lww.live(logs.log_lineitem(spark, sf_dir)), probes(spark, sf_dir))


@query(f"""{L}, X AS (SELECT key, CASE WHEN l_linestatus='O' THEN '' ELSE value END AS value FROM LW WHERE op='PUT')
SELECT key, {STATUS}, true AS listed FROM X""")
def get_empty_value(spark, sf_dir):
    """An empty value reads as 404, and a scan lists its key all the same."""
    empty = (F.col("op") == "PUT") & (F.col("l_linestatus") == "O")
    log = logs.log_lineitem(spark, sf_dir, "l_linestatus").withColumn("value", F.when(empty, "").otherwise(F.col("value")))
    return lww.live(log).select("key", reads.status().alias("status"), F.lit(True).alias("listed"))


@query(f"{L} SELECT key FROM LW WHERE op='DELETE'")
def tombstones(spark, sf_dir):
    return lww.tombstones(logs.log_lineitem(spark, sf_dir))


@query(f"{L} SELECT key FROM L GROUP BY key HAVING min(CASE WHEN op='DELETE' THEN rn END) < max(CASE WHEN op='PUT' THEN rn END)")
def resurrected_keys(spark, sf_dir):
    return lww.resurrected(logs.log_lineitem(spark, sf_dir))


@query(f"{L} SELECT key FROM (SELECT key, op, row_number() OVER (PARTITION BY key ORDER BY rn) AS r FROM L) WHERE r=1 AND op='DELETE'")
def blind_deletes(spark, sf_dir):
    return lww.blind_deletes(logs.log_lineitem(spark, sf_dir))


@query(f"{L} SELECT count(*) AS n_live FROM LIVE")
def count_live(spark, sf_dir):
    return reads.count_live(lww.live(logs.log_lineitem(spark, sf_dir)))


@query("SELECT 'o'||lpad(CAST(o_orderkey AS VARCHAR),9,'0') AS key, o_orderstatus AS value FROM orders WHERE o_orderpriority<>'5-LOW'")
def put_validation(spark, sf_dir):
    """PUTs whose key is empty are refused."""
    rows = logs.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(logs.key_of("o", "o_orderkey", 9)).alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"))
    return lww.live(logs.puts(rows))


@query("SELECT 'o'||lpad(CAST(o_orderkey AS VARCHAR),9,'0') AS key, CASE WHEN o_orderstatus='F' THEN 'DELETE' ELSE 'PUT' END AS op, CASE WHEN o_orderstatus<>'F' THEN o_orderstatus END AS value FROM orders")
def put_then_delete(spark, sf_dir):
    """DELETE of existing keys, by appending tombstones to an insert-only log."""
    puts = logs.log_orders(spark, sf_dir)
    gone = logs.deletes(puts.where("value = 'F'").select("key", (F.col("seq") + (1 << 40)).alias("seq")))
    return lww.latest(puts.unionByName(gone))


@query(f"{L}{RUNS} SELECT * FROM RUNS")
def flush_runs(spark, sf_dir):
    return runs.flush_runs(logs.log_lineitem(spark, sf_dir), N)


@query(f"{L} SELECT key, value FROM LIVE")
def merge_on_read_runs(spark, sf_dir):
    merged = runs.merge_runs(runs.flush_runs(logs.log_lineitem(spark, sf_dir), N))
    return merged.where("op = 'PUT'").select("key", "value")


@query(f"{L} SELECT key, op, value FROM LW")
def compact_l0_l1(spark, sf_dir):
    return runs.merge_runs(runs.flush_runs(logs.log_lineitem(spark, sf_dir), N))


@query(f"{L} SELECT key, value FROM LIVE")
def compact_l1_l2(spark, sf_dir):
    """Tombstones go at the bottom level only."""
    return written(compact_l0_l1(spark, sf_dir), "level1").where("op = 'PUT'").select("key", "value")


@query(f"{L}{SPLITS} SELECT * FROM SPLITS")
def split_runs(spark, sf_dir):
    return runs.split(lww.latest(logs.log_lineitem(spark, sf_dir)))


@query(f"{L}{SPLITS} SELECT * FROM SPLITS WHERE max_key>='{START}' AND min_key<'{END}'")
def file_prune_range(spark, sf_dir):
    return split_runs(spark, sf_dir).where(reads.overlaps(START, END))


@query(f"{L}{SPLITS} SELECT p.key, file FROM PROBES p JOIN SPLITS ON p.key BETWEEN min_key AND max_key")
def file_prune_point(spark, sf_dir):
    return runs.files_of(probes(spark, sf_dir), written(split_runs(spark, sf_dir), "splits"))


@query(f"{L}{SPLITS} SELECT a.file, b.file AS next_file FROM SPLITS a JOIN SPLITS b ON a.file+1=b.file WHERE b.min_key<=a.max_key")
def level_overlaps(spark, sf_dir):
    return runs.overlapping(written(split_runs(spark, sf_dir), "splits"))


@query(f"{L}{RUNS}, RR AS (SELECT run AS file, min(key) AS min_key, max(key) AS max_key, row_number() OVER (ORDER BY min(key), max(key), run) AS q FROM RUNS GROUP BY run) SELECT a.file, b.file AS next_file FROM RR a JOIN RR b ON a.q+1=b.q WHERE b.min_key<=a.max_key")
def l0_overlaps(spark, sf_dir):
    """Runs of level 0 do overlap."""
    own = flush_runs(spark, sf_dir).groupBy(F.col("run").alias("file")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    return runs.overlapping(written(own, "runs"))


@query(f"{L}{INDEX} SELECT * FROM IX")
def sparse_index(spark, sf_dir):
    return runs.sparse_index(lww.live(logs.log_lineitem(spark, sf_dir)))


@query(f"""{L}{RUNS}, J AS (SELECT *, '{{"key":"'||key||'","value":'||CASE WHEN value IS NULL THEN 'null' ELSE '"'||value||'"' END||'}}' AS line FROM RUNS),
K AS (SELECT run, key, row_number() OVER w AS q, CAST(coalesce(sum(octet_length(encode(line))+1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS file_offset FROM J WINDOW w AS (PARTITION BY run ORDER BY key))
SELECT run, key, file_offset FROM K WHERE (q-1)%{codec.STRIDE}=0""")
def sparse_index_offsets(spark, sf_dir):
    return runs.sparse_offsets(flush_runs(spark, sf_dir))


@query(f"{L}{INDEX} SELECT key, (SELECT max(i.key) FROM IX i WHERE i.key<=p.key) AS seek_key FROM PROBES p")
def sparse_seek(spark, sf_dir):
    return floor_lookup(probes(spark, sf_dir), sparse_index(spark, sf_dir).select("key"), "seek_key")


@query(f"""{L}{RUNS}, C AS (SELECT run, count(*) AS n FROM RUNS GROUP BY run),
M AS (SELECT run, n, greatest(64, CAST(ceil(-n*ln({codec.FALSE_POSITIVES})/(ln(2)*ln(2))) AS BIGINT)) AS m FROM C)
SELECT run, n, m, least(16, greatest(1, CAST(round(m/CAST(n AS DOUBLE)*ln(2)) AS BIGINT))) AS k FROM M""")
def bloom_params(spark, sf_dir):
    m, k = codec.bloom_columns("n")
    return flush_runs(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("n")).select("run", "n", m.alias("m"), k.alias("k"))


@query(f"{L} SELECT count(*) AS n_keys, 0 AS n_missed, true AS few_false FROM LW")
def bloom_no_false_negative(spark, sf_dir):
    """Every key of the table is found by its filter, and few keys that it doesn't have."""
    keys = written(lww.latest(logs.log_lineitem(spark, sf_dir)).select("key"), "keys")
    n = keys.count()
    m, k = codec.bloom_size(n)
    bloom = written(codec.bloom_build(keys, m, k), "bloom")
    both = keys.union(keys.select(F.concat("key", F.lit("?")).alias("key")))
    found = codec.bloom_probe(both, bloom, m, k).agg(F.count_if(~F.col("key").endswith("?")).alias("hits"), F.count_if(F.col("key").endswith("?")).alias("wrong"))
    return found.select(F.lit(n).cast("long").alias("n_keys"), (F.lit(n) - F.col("hits")).cast("int").alias("n_missed"), (F.col("wrong") <= 3 * codec.FALSE_POSITIVES * n + 10).alias("few_false"))


@query("SELECT * FROM (VALUES (0,5),(1,10),(2,15)) t(level, max_files)")
def level_limits(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(codec.LEVEL_LIMITS)), "level int, max_files int")


@query(f"{L} SELECT rn, key, op, value FROM L")
def wal_json_roundtrip(spark, sf_dir):
    log = runs.ranked(logs.log_lineitem(spark, sf_dir), F.col("seq"), without=("seq",))
    return codec.parse_log(log.select("rn", codec.log_line().alias("line")))


@query(f"{L}, G AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rn DESC) AS r FROM L WHERE l_returnflag<>'A') WHERE r=1) SELECT key, op, value FROM G")
def wal_replay_skip_bad(spark, sf_dir):
    """A replay skips malformed lines and goes on."""
    lines = logs.log_lineitem(spark, sf_dir, "l_returnflag").select("seq", "l_returnflag", codec.log_line().alias("line"))
    torn = F.when(F.col("l_returnflag") == "A", F.expr("substring(line, 1, length(line) - 4)")).otherwise(F.col("line"))
    return lww.latest(codec.parse_log(lines.select("seq", torn.alias("line"))))


@query(f"{L}{SPLITS} SELECT 'run-'||CAST(file AS VARCHAR)||'.parquet' AS file FROM SPLITS WHERE file%2=1")
def manifest_orphans(spark, sf_dir):
    """Files that a manifest, which lists the even ones, leaves out."""
    files = written(split_runs(spark, sf_dir), "splits")
    named = F.concat(F.lit("run-"), F.col("file").cast("string"), F.lit(".parquet")).alias("file")
    return manifest.orphans(files.select(named), files.where("file % 2 = 0").select(named))


@query(f"{L}{SPLITS} SELECT 'run-'||CAST(file AS VARCHAR) AS stem, max(file) OVER ()+1 AS next_id FROM SPLITS")
def next_run_id(spark, sf_dir):
    """Names without their extension, and the id after the last."""
    files = written(split_runs(spark, sf_dir), "splits").select(F.concat(F.lit("run-"), F.col("file").cast("string"), F.lit(".tar.parquet")).alias("name"))
    stems = files.select(codec.stem("name").alias("stem"))
    last = stems.agg(F.max(F.substring_index("stem", "-", -1).cast("long"))).first()[0]
    return stems.withColumn("next_id", F.lit((last or 0) + 1).cast("long"))


@query(f"{L} SELECT op AS method, count(*) AS n, count(DISTINCT key) AS n_keys, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS total FROM L GROUP BY op")
def verb_stats(spark, sf_dir):
    return logs.log_lineitem(spark, sf_dir).groupBy(F.col("op").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys"), F.sum(F.col("value").cast("long")).alias("total"))


@query("SELECT event_type AS method, count(*) AS n, CAST(sum(user_id%3) AS BIGINT) AS retries, avg(CAST(user_id AS DOUBLE)) AS avg_us FROM events GROUP BY event_type")
def harness_stats(spark, sf_dir):
    events = logs.table(spark, sf_dir, "events")
    return trace.verb_stats(events.select(F.col("event_type").alias("method"), (F.col("user_id") % 3).alias("retries"), F.col("user_id").cast("double").alias("us")))


def trace_lines(spark, sf_dir):
    user = logs.key_of("u", "user_id", 6)
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", F.concat(F.lit("DELETE "), user))
        .when(kind == "click", F.concat(F.lit("PUT "), user, F.lit(" "), F.regexp_replace("props", " ", "_")))
        .when(kind == "view", F.concat(F.lit("GET "), user, F.lit(" "), F.when(F.col("user_id") % 2 == 0, "NOT_FOUND").otherwise("x")))
        .when(kind == "signup", F.concat(F.lit("SCAN "), user, F.lit(" v "), user, F.lit(",v")))
        .otherwise(F.concat(F.lit("BUY "), user))
    )
    return logs.table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), text.alias("line"))


TRACE = EVENTS + """, T AS (SELECT event_id AS line_no, CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'click' THEN 'PUT' WHEN 'view' THEN 'GET' WHEN 'signup' THEN 'SCAN' ELSE 'INVALID' END AS method,
CASE WHEN event_type<>'purchase' THEN key END AS key, CASE WHEN event_type='signup' THEN 'v' END AS end_key,
CASE event_type WHEN 'click' THEN replace(props,' ','_') WHEN 'view' THEN CASE WHEN CAST(substr(key,2) AS INT)%2=0 THEN '' ELSE 'x' END WHEN 'signup' THEN key||',v' END AS value FROM E)"""


@query(f"{TRACE} SELECT * FROM T")
def trace_parse(spark, sf_dir):
    return trace.parse(trace_lines(spark, sf_dir))


@query(f"""{TRACE}, M AS (SELECT *, max(CASE WHEN method IN ('PUT','DELETE') THEN line_no END) OVER (PARTITION BY key ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM T WHERE method IN ('PUT','DELETE','GET'))
SELECT M.line_no, M.key, M.value AS expected, coalesce(CASE WHEN p.method='PUT' THEN p.value END,'') AS actual, M.value=coalesce(CASE WHEN p.method='PUT' THEN p.value END,'') AS ok FROM M LEFT JOIN T p ON p.line_no=M.last WHERE M.method='GET'""")
def trace_replay(spark, sf_dir):
    return trace.replay_gets(trace.parse(trace_lines(spark, sf_dir)))


@query(f"{TRACE}, X AS (SELECT line_no, unnest(string_split(value,',')) AS key FROM T WHERE method='SCAN') SELECT * FROM X")
def trace_scan_keys(spark, sf_dir):
    return trace.parse(trace_lines(spark, sf_dir)).where("method = 'SCAN'").select("line_no", F.explode(trace.expected_keys()).alias("key"))


def narrow_lines(spark, sf_dir):
    """As trace_lines, with scans of a few keys, some of which expect what they find."""
    key = lambda n: F.concat(F.lit("u"), F.lpad(n.cast("string"), 6, "0"))
    user = F.col("user_id")
    scan = F.concat(F.lit("SCAN "), key(user), F.lit(" "), key(user + 4), F.lit(" "), key(user), F.when(user % 3 == 0, F.concat(F.lit(","), key(user + 2))).otherwise(""))
    own = logs.table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("line_no"), scan.alias("line"))
    return trace_lines(spark, sf_dir).where("line not like 'SCAN %'").union(own)


@query(f"""{TRACE}, S AS (SELECT event_id AS line_no, 'u'||lpad(CAST(user_id AS VARCHAR),6,'0') AS lo, 'u'||lpad(CAST(user_id+4 AS VARCHAR),6,'0') AS hi,
'u'||lpad(CAST(user_id AS VARCHAR),6,'0')||CASE WHEN user_id%3=0 THEN ',u'||lpad(CAST(user_id+2 AS VARCHAR),6,'0') ELSE '' END AS expected FROM events WHERE event_type='signup'),
V AS (SELECT key, method, line_no, lead(line_no) OVER (PARTITION BY key ORDER BY line_no) AS until FROM T WHERE method IN ('PUT','DELETE')),
A AS (SELECT S.line_no, string_agg(V.key, ',' ORDER BY V.key) AS actual FROM S JOIN V ON V.key>=lo AND V.key<hi AND V.method='PUT' AND V.line_no<S.line_no AND (until IS NULL OR until>S.line_no) GROUP BY S.line_no)
SELECT S.line_no, expected, coalesce(actual,'') AS actual, coalesce(actual,'')=expected AS ok FROM S LEFT JOIN A USING (line_no)""")
def trace_scan_replay(spark, sf_dir):
    return trace.replay_scans(trace.parse(narrow_lines(spark, sf_dir)))


@query(f"{TRACE} SELECT line_no, method, 200 AS status FROM T WHERE method IN ('PUT','DELETE')")
def trace_write_status(spark, sf_dir):
    return trace.replay_writes(trace.parse(trace_lines(spark, sf_dir)))


@query(f"{L}{RUNS}, J AS (SELECT run, key, value, row_number() OVER (PARTITION BY run ORDER BY key) AS q, l FROM (SELECT *, octet_length(encode(key))%7 AS l FROM RUNS)) SELECT run, key, value FROM J WHERE q<=50")
def run_lines_end_at_bad(spark, sf_dir):
    """A run of JSON lines, of which the 51st is torn, is read up to that line."""
    rows = flush_runs(spark, sf_dir).withColumn("line_no", F.row_number().over(Window.partitionBy("run").orderBy("key")))
    line = F.when(F.col("line_no") == 51, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line"))
    return codec.parse_run(rows.select("run", "line_no", codec.run_line().alias("line")).withColumn("line", line), "run").select("run", "key", "value")


@query(f"{L}, H AS (SELECT *, CASE WHEN rn<=(SELECT max(rn)/2 FROM L) THEN 1 ELSE 2 END AS pos FROM L) SELECT 0 AS level, pos, min(key) AS min_key, max(key) AS max_key, count(DISTINCT key) AS n FROM H GROUP BY pos")
def engine_manifest(spark, sf_dir):
    """The rows of the manifest after two flushes, by run."""
    engine = _fresh(spark)
    log = runs.ranked(logs.log_lineitem(spark, sf_dir), F.col("seq"), name="pos", without=("seq",))
    half = log.agg((F.max("pos") / 2).alias("h")).first()["h"] or 0
    for part in (log.where(F.col("pos") <= half), log.where(F.col("pos") > half)):
        engine.append(part)
        engine.flush()
    rows = manifest.frame(spark, engine.manifest)
    return rows.groupBy("level", "pos").agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("n").alias("n"))


@query(f"{L} SELECT p.key, value, {STATUS} FROM PROBES p LEFT JOIN LIVE USING (key)")
def engine_multi_get(spark, sf_dir):
    """A batch lookup over a settled level under a log."""
    engine = _fresh(spark)
    log = runs.ranked(logs.log_lineitem(spark, sf_dir), F.col("seq"), name="pos", without=("seq",))
    half = log.agg((F.max("pos") / 2).alias("h")).first()["h"] or 0
    engine.append(log.where(F.col("pos") <= half))
    engine.flush()
    engine.compact(0)
    engine.append(log.where(F.col("pos") > half))
    return engine.multi_get(probes(spark, sf_dir))


def _fresh(spark, **options) -> Engine:
    return Engine.open(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", **options)


@query(f"{EVENTS} SELECT key, value FROM EW WHERE op='PUT'")
def stream_latest_state(spark, sf_dir):
    """The events table as a stream, each micro-batch a run of an engine."""
    engine = _fresh(spark)
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    ingest.into(engine, logs.log_events(events), "events", f"{engine.path}-stream").awaitTermination()
    engine.vacuum()
    return engine.live()


@query(f"{L} SELECT key, value FROM LIVE")
def engine_latest_state(spark, sf_dir):
    """The log appended in two batches, flushed, compacted to the bottom, reopened and read."""
    engine = _fresh(spark)
    log = runs.ranked(logs.log_lineitem(spark, sf_dir), F.col("seq"), name="pos", without=("seq",))
    half = log.agg((F.max("pos") / 2).alias("h")).first()["h"] or 0
    engine.append(log.where(F.col("pos") <= half))
    engine.flush()
    engine.append(log.where(F.col("pos") > half))
    engine.flush()
    engine.compact(0)
    engine.compact(1)
    engine.vacuum()
    return Engine.open(spark, engine.path).live()


@query(f"{L} SELECT key FROM LIVE WHERE key>='{START}' AND key<'{END}'")
def engine_scan(spark, sf_dir):
    """A range scan over a flushed run under a tail that is still only logged."""
    engine = _fresh(spark)
    log = runs.ranked(logs.log_lineitem(spark, sf_dir), F.col("seq"), name="pos", without=("seq",))
    half = log.agg((F.max("pos") / 2).alias("h")).first()["h"] or 0
    engine.append(log.where(F.col("pos") <= half))
    engine.flush()
    engine.append(log.where(F.col("pos") > half))
    return engine.scan(START, END)


def flagship(spark):
    return scan_range(spark, os.environ.get("TIDELOG_ENTRY_DIR", "/root/testdata/sf0.001"))
