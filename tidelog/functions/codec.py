"""Scalar functions: JSON lines, names, capacities and Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WAL_SCHEMA = "operation string, key string, value string"

# The runs or files that a level holds before it is compacted (the last level has no limit),
# the entries between two of a sparse index, the false-positive rate of filters, the rows of a split.
LEVEL_LIMITS = (5, 10, 15)
STRIDE = 64
FALSE_POSITIVES = 0.01
SPLIT = 2000
BLOCK = 32_768  # bits of a bitmap of Spark's
FEW_BLOCKS = 64  # up to so many, a filter (256 kB) is merged and sent whole


def log_line(op: str = "op", key: str = "key", value: str = "value") -> Column:
    return F.to_json(F.struct(F.col(op).alias("operation"), F.col(key).alias("key"), F.col(value).alias("value")), {"ignoreNullFields": "false"})


def run_line(key: str = "key", value: str = "value") -> Column:
    return F.to_json(F.struct(F.col(key).alias("key"), F.col(value).alias("value")), {"ignoreNullFields": "false"})


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with op, key, value; malformed lines are skipped, as in a replay."""
    parsed = lines.withColumn("__j", F.from_json(line, WAL_SCHEMA, {"mode": "PERMISSIVE"}))
    good = parsed.where("__j.operation in ('PUT', 'DELETE') and __j.key is not null")
    return good.select(*[c for c in lines.columns if c != line], F.col("__j.operation").alias("op"), "__j.key", "__j.value")


RUN_SCHEMA = "key string, value string"


def parse_run(lines: DataFrame, run: str, at: str = "line_no", line: str = "line") -> DataFrame:
    """lines of sorted runs with key, value; a run ends at its first malformed line, as a reader of one stops there."""
    parsed = lines.withColumn("__j", F.from_json(line, RUN_SCHEMA, {"mode": "PERMISSIVE"}))
    first = parsed.groupBy(run).agg(F.min(F.when(F.col("__j.key").isNull(), F.col(at))).alias("__end"))
    good = parsed.join(first, run).where(F.col("__end").isNull() | (F.col(at) < F.col("__end")))
    return good.select(*[c for c in lines.columns if c != line], F.col("__j.key").alias("key"), F.col("__j.value").alias("value"))


def stem(name: str) -> Column:
    """A file name without what follows its first dot."""
    return F.substring_index(name, ".", 1)


def bloom_size(n: int, p: float = FALSE_POSITIVES) -> tuple[int, int]:
    """Bits and hash functions of a filter for n keys."""
    m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2)) if n else 64
    return m, min(16, max(1, round(m / max(n, 1) * math.log(2))))


def bloom_columns(n: str, p: float = FALSE_POSITIVES) -> tuple[Column, Column]:
    m = F.greatest(F.lit(64), F.ceil(-F.col(n) * F.lit(math.log(p)) / F.lit(math.log(2) ** 2)))
    k = F.least(F.lit(16), F.greatest(F.lit(1), F.round(m / F.greatest(F.col(n), F.lit(1)) * F.lit(math.log(2)))))
    return m.cast("long"), k.cast("long")


def bloom_blocks(m: int) -> tuple[int, int]:
    """Blocks of a filter of m bits, each one bitmap, and the bits of a block."""
    blocks = -(-m // BLOCK)
    return blocks, -(-m // blocks)


def bloom_hashes(key: Column, m: int) -> tuple[Column, Column, Column]:
    """The block of a key, and two hashes of 31 bits, so that nothing wraps."""
    low = F.lit((1 << 31) - 1)
    block = F.pmod(F.xxhash64(F.lit(3), key), F.lit(bloom_blocks(m)[0]).cast("long"))
    return block, F.xxhash64(F.lit(1), key).bitwiseAND(low), F.xxhash64(F.lit(2), key).bitwiseAND(low)


def bloom_positions(one: Column, two: Column, m: int, k: int) -> list[Column]:
    """The k bits of a key in its block, by double hashing."""
    return [F.pmod(one + F.lit(i).cast("long") * two, F.lit(bloom_blocks(m)[1]).cast("long")) for i in range(k)]


def bloom_build(keys: DataFrame, m: int, k: int) -> DataFrame:
    """The filter as bitmaps of up to 32,768 bits: (bucket, bits). All bits of a key are in one bitmap (a blocked filter).

    A large filter's keys are dealt out by bitmap, a short row each, for partial bitmaps would be a whole filter
    for each task. Those of a few bitmaps are merged before the shuffle, so no key moves."""
    block, one, two = bloom_hashes(F.col("key"), m)
    at = keys.select(block.alias("bucket"), one.alias("one"), two.alias("two"))
    if bloom_blocks(m)[0] > FEW_BLOCKS:
        at = at.repartition("bucket")
    own = at.groupBy("bucket").agg(*[F.bitmap_construct_agg(p).alias(f"b{i}") for i, p in enumerate(bloom_positions(F.col("one"), F.col("two"), m, k))])
    return own.select("bucket", F.explode(F.array(*own.columns[1:])).alias("bits")).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bloom_probe(keys: DataFrame, bloom: DataFrame, m: int, k: int) -> DataFrame:
    """The keys that the filter might contain, once each. A key meets its one bitmap: a large filter is joined by bitmap, a
    row for each key, a small one is broadcast."""
    block, one, two = bloom_hashes(F.col("key"), m)
    words = bloom.select("bucket", F.transform(F.regexp_extract_all(F.hex("bits"), F.lit(".{16}"), F.lit(0)), lambda x: F.conv(x, 16, -10).cast("long")).alias("words"))
    words = words.hint("shuffle_hash") if bloom_blocks(m)[0] > FEW_BLOCKS else F.broadcast(words)
    both = keys.select("key", block.alias("bucket")).join(words, "bucket")
    for p in bloom_positions(one, two, m, k):  # hex is byte by byte, and bits count from a byte's low end
        word, bit = F.shiftright(p, 6).cast("int"), p.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56)).cast("int")
        both = both.where(F.getbit(F.col("words")[word], bit) == 1)
    return both.select("bucket", "key").distinct().select("key")
