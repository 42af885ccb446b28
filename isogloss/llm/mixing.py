"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every document of a source waits in its source's shuffled queue, up to
`repeats` times. Its virtual finish time is the words that its source has sent
by then, divided by the source's weight. All queues are merged by a global
range sort of the finish times, and the merged stream is cut at the budget.
Running sums are taken in two steps, over slices of a source's shuffle or
partitions of the range sort and then inside each, so no source and no order
has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, pick, table

WEIGHTS = (5, 2, 1)
#: Budget as a fraction of all words.
BUDGET = (3, 2)
REPEATS = 2
SEED = "mix"


def _key(source: Column) -> Column:
    """A text that orders as sources do, null last."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """key, source_size, weight, target of sizes(key, source_size).

    The budget is shared by weight; a source that would exceed repeats times its
    size gets just that, and the rest is shared again. Sources are ordered by the
    level at which they fill up: the first ones that fit together are full.
    """
    every, by_key = Window.partitionBy(), Window.partitionBy().orderBy("key")
    fill = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "key")
    num, den = budget
    cycle = F.array(*[F.lit(w) for w in weights])
    s = (
        sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("caps", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("after", F.coalesce(F.sum("weight").over(fill.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
        .withColumn("full", den * (F.col("caps") * F.col("weight") + F.col("cap") * F.col("after")) <= num * F.col("total") * F.col("weight"))
    )
    rest = F.col("total") * num / den - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    level = rest / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return s.select("key", "source_size", "weight", target.alias("target"), F.floor(F.col("total") * num / den).alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken, one row per row of docs (doc_id, text, source).

    taken counts the words that the mix takes of the row, all repeats together;
    the document that crosses the budget is taken in part. A null text has no
    words. A null source is a source of its own, the last. Null and repeated ids
    queue in the order of their sizes. Reruns agree. Extra columns are ignored,
    and an empty table gives an empty result.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    shuffle = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = pick(docs, "doc_id", "text", "source").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "source", _key(F.col("source")).alias("key"), words.alias("size"), shuffle.alias("h")
    )
    rows = cut(rows.withColumn("slice", F.substring("h", 1, 3)))
    slices = rows.groupBy("key", "slice").agg(F.sum("size").alias("slice_size"))
    sources = targets(slices.groupBy("key").agg(F.sum("slice_size").alias("source_size")), weights, budget, repeats)
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).join(sources, "key")
    inside = Window.partitionBy("key", "slice").orderBy("h", "doc_id", "size", "text_hash", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        rows.join(slices, ["key", "slice"])
        .withColumn("sent", F.col("before") + F.sum("size").over(inside))
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("finish", (F.col("sent") + F.col("round") * F.col("source_size")) / F.col("weight"))
    )
    order = ["finish", "key", "h", "doc_id", "size", "text_hash", "row", "round"]
    # The partition of a row must stay the same while its sums are taken, so the range sort is written.
    merged = cut(queued.drop("slice_size", "before", "sent", "slice").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = merged.groupBy("part").agg(F.sum("size").alias("part_size"))
    parts = parts.select("part", F.coalesce(F.sum("part_size").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - start))
    done = merged.join(parts, "part").withColumn("taken", taken)
    return done.groupBy("row", "doc_id", "text_hash", "source", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("row")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mix takes, with mix_size, mix_target (of the source) and mix_taken.

    Rows alike in id, text and source are one here: mix_taken is their sum.
    """
    names = docs.columns
    took = mix(docs, **how).filter("taken > 0").groupBy(F.col("doc_id").alias("mix_id"), F.col("text_hash").alias("mix_hash"), F.col("source").alias("mix_source"))
    took = took.agg(F.sum("size").alias("mix_size"), F.first("target").alias("mix_target"), F.sum("taken").alias("mix_taken"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text, source = (f"c{names.index(n)}" for n in ("doc_id", "text", "source"))
    plain = plain.withColumn("h", F.xxhash64(text)).dropDuplicates([doc_id, "h", source])
    joined = plain.join(took, plain[doc_id].eqNullSafe(took["mix_id"]) & (plain["h"] == took["mix_hash"]) & plain[source].eqNullSafe(took["mix_source"]))
    return joined.select(*plain.columns[: len(names)], "mix_size", "mix_target", "mix_taken").toDF(*names, "mix_size", "mix_target", "mix_taken")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {"op7_mixing": op7}
ORACLE_SQL = {
    "op7_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce('a' || source, 'b') AS key, md5('mix:' || doc_id::VARCHAR) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY key) - 1) % 3 + 1]::BIGINT AS weight, (sum(source_size) OVER ())::BIGINT AS total, source_size * 2 AS cap FROM s),
f AS (
  SELECT *, (sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS caps,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS after
  FROM w),
g AS (SELECT *, 2 * (caps * weight + cap * after) <= 3 * total * weight AS filled FROM f),
t AS (
  SELECT key, source_size, weight, floor(total * 3 / 2)::BIGINT AS budget,
         CASE WHEN filled THEN cap::DOUBLE
              ELSE (total * 3 / 2 - (sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ())::BIGINT) / (sum(CASE WHEN NOT filled THEN weight END) OVER ())::BIGINT * weight END AS target
  FROM g),
q AS (
  SELECT d.*, t.source_size, t.target, t.budget, r.round,
         ((sum(size) OVER (PARTITION BY d.key, r.round ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT + r.round * t.source_size) / t.weight AS finish
  FROM d JOIN t USING (key), (VALUES (0), (1)) r(round)),
c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, key, h, doc_id, size, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM q)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(size, budget - start)))::BIGINT AS taken, source
FROM c GROUP BY doc_id, size, source_size, target, source
"""
}
