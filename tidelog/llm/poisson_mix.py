"""Operator 1, mixing sources to target weights: Poisson replication.

A source's documents are repeated so that the source's share of the mixture, in characters, is its target
weight. The mean repetition rate of a source is weight x budget / characters; a document's count inverts the
Poisson distribution of that mean at a uniform number taken from a seeded hash of the document, so counts
need no state and are the same in every run. Documents are exploded by count and shuffled globally by a
hash of (document, copy, seed): the hash is uniform, so its leading digits are the partition and no sampling
pass is needed, and partitions are sorted by it.

Only built-in expressions run. Sources are pre-aggregated to one row each; that row carries the
distribution's steps, and the join back is by source, which Spark broadcasts or, for a hot source, splits.

Defined results: a null source is a source of its own; null and empty texts count as no characters and are
mixed at their source's rate (a source of no characters has rate 0). Rows with equal doc_id and text get the
same count, as do rows of equal doc_id and source whose texts differ. A null doc_id hashes as the text "null".
Sources that `weights` does not name get none; without weights, a source weighs the square root of its
characters. Rows of equal mix_order (repeated doc_ids) are in order of their text's hash. Extra columns stay,
whatever their names, but for ones named mix_copy or mix_order, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, partitions, table, tidy, written

SEED = 17
EPOCHS = 1.0  # the mixture's characters, times those of the input
FEW = 20_000  # sources that may be broadcast: 10 MB of steps
MAX_RATE = 600.0  # below the mean at which exp(-rate) is no normal double; for larger rates the distribution starts near the mean


def uniform(*parts: Column) -> Column:
    """In [0, 1): 52 bits of the MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """source_key, whole (copies for certain: fewer have odds under 1e-30), steps (the Poisson distribution function from there on)."""
    per = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source_key")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    if weights is None:
        weight = F.sqrt(F.col("chars").cast("double"))
    else:
        named = [x for k, v in weights.items() for x in (F.lit("\0" if k is None else k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*named)[F.col("source_key")], F.lit(0.0)) if named else F.lit(0.0)
    per = per.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    per = written(per, "sources")
    chars, weights = per.agg(F.sum("chars"), F.sum("weight")).first()
    mean = F.col("weight") / F.lit(float(weights or 1)) * F.lit(chars or 0) * F.lit(float(epochs)) / F.col("chars")
    per = per.withColumn("rate", F.when((F.col("weight") > 0) & (F.col("chars") > 0), mean).otherwise(0.0))
    rate, n = F.col("rate"), F.col("whole").cast("double")
    per = per.withColumn("whole", F.when(rate > MAX_RATE, F.floor(rate - 12 * F.sqrt("rate") - 30)).otherwise(0).cast("long"))
    stirling = n * F.log(rate / n) - (rate - n) - F.log(2 * math.pi * n) / 2 - 1 / (12 * n) + 1 / (360 * n * n * n)
    p = F.when(n > 0, F.exp(stirling)).otherwise(F.exp(-rate))  # of `whole` copies
    first = F.struct(p.alias("p"), p.alias("sum"), F.array(p).alias("steps"))
    top = F.ceil(rate - n + 10 * F.sqrt("rate") + 30).cast("int")

    def step(a, k):
        p = a["p"] * rate / (n + k)
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["steps"], F.array(a["sum"] + p)).alias("steps"))

    return per.select("source_key", "rate", "whole", F.aggregate(F.sequence(F.lit(1), top), first, step)["steps"].alias("steps"))


@tidy
def _steps(docs: DataFrame, weights: dict[str, float] | None, epochs: float, names: list[str]) -> DataFrame:
    """A stored row for each source: its key, whole and steps, under these names."""
    return written(rates(docs, weights, epochs).select(*[F.col(c).alias(n) for c, n in zip(("source_key", "whole", "steps"), names)]), "rates")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The columns of docs, then mix_copy (from 1) and mix_order (the global order's key), in that order."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("mix_copy", "mix_order")])
    key, whole, steps, count, part = free(docs, "key", "whole", "steps", "count", "part")
    u = uniform(F.lit(seed), F.lit("count"), F.col("doc_id"))
    by = _steps(docs, weights, epochs, [key, whole, steps])
    by = F.broadcast(by) if by.count() <= FEW else by
    counted = docs.join(by, F.coalesce(F.col("source").cast("string"), F.lit("\0")) == F.col(key)).withColumn(count, F.col(whole) + F.size(F.filter(steps, lambda s: s <= u)))
    copies = counted.where(F.col(count) > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("mix_copy").cast("string")))
    n = partitions(docs.sparkSession)
    at = F.floor(F.conv(F.substring("mix_order", 1, 7), 16, 10).cast("double") * n / float(1 << 28)).cast("int")
    out = copies.select(*docs.columns, "mix_copy", order.alias("mix_order")).withColumn(part, at)
    return out.repartitionById(n, part).drop(part).sortWithinPartitions("mix_order", F.xxhash64("text"))


def op1_poisson_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "source", F.col("n_chars"), "mix_copy", "mix_order")


def op1_poisson_mix_whole(spark, sf_dir: str) -> DataFrame:
    """The mixture itself: every column of documents, texts too, with mix_copy and mix_order."""
    return mix(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH per AS (SELECT coalesce(source, chr(0)) AS k, sum(coalesce(length(text), 0)) AS chars FROM documents GROUP BY 1),
w AS (SELECT k, chars, sqrt(CAST(chars AS DOUBLE)) AS weight FROM per),
r AS (SELECT k, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM w) * (SELECT sum(chars) FROM w) * {EPOCHS} / chars ELSE 0 END AS rate FROM w),
steps AS (
  SELECT k, rate, n, sum(p) OVER (PARTITION BY k ORDER BY n) AS cdf FROM (
    SELECT k, rate, n, exp(-rate + n * ln(rate) - lgamma(n + 1)) AS p FROM r, range(0, 60) t(n) WHERE rate > 0)
),
d AS (
  SELECT doc_id, source, n_chars, coalesce(source, chr(0)) AS k,
    CAST(('0x' || substr(md5('{SEED}:count:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS UBIGINT) / 4503599627370496.0 AS u
  FROM documents
),
c AS (SELECT d.*, (SELECT count(*) FROM steps s WHERE s.k = d.k AND s.cdf <= d.u) AS copies FROM d),
x AS (SELECT doc_id, source, n_chars, unnest(range(1, copies + 1)) AS mix_copy FROM c)
SELECT doc_id, source, n_chars, mix_copy, md5('{SEED}:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(mix_copy AS VARCHAR)) AS mix_order FROM x
"""


OP1_WHOLE_SQL = f"WITH m AS ({OP1_SQL}), one AS (SELECT DISTINCT * FROM m) SELECT d.*, o.mix_copy, o.mix_order FROM documents d JOIN one o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.source IS NOT DISTINCT FROM o.source AND d.n_chars IS NOT DISTINCT FROM o.n_chars"


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the mixture's weights, stored in its order; the columns of documents. See mix() for odd rows."""
    return mix(docs.select("doc_id", "text", "lang", "source", "n_chars")).drop("mix_copy", "mix_order")
