"""Incremental jobs on new files: scoring, keep-first and running counts."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import markers as M
from ..operators.selection import keep_first


def new_documents(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, `files` at a time."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def same_parameters(spark: SparkSession, path: str, parameters: dict) -> None:
    """Note the parameters of a resumable job at its first run; refuse others at a later one."""
    now = json.dumps(parameters, sort_keys=True)
    try:
        then = spark.read.text(path).first()["value"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([(now,)], "value string").write.text(path)
        return
    if then != now:
        raise ValueError(f"the job was begun with {then}, not with {now}")


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _written(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The batches of which a folder `kind=batch` is there whole."""
    fs, at = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    done = [n for n in names if n.startswith(f"{kind}=") and fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.partition("=")[2]) for n in done)


def kept_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """What the batches under `before` (all, if null) have written: the last base and the deltas since; None if there is nothing."""
    under = lambda kind: [n for n in _written(spark, path, kind) if before is None or n < before]
    base = under("base")[-1:]
    parts = [f"{path}/base={n}" for n in base] + [f"{path}/batch={n}" for n in under("batch") if not base or n > base[0]]
    return spark.read.parquet(*parts) if parts else None


def add_delta(delta: DataFrame, number: int, path: str, every: int, merge=None) -> None:
    """Write a batch's delta, and each `every` batches a base of all so far (merged by `merge`), after which what it holds goes.

    A retry writes the same folders again. So reading costs the size of the state
    and of `every` deltas at most, however many batches there were.
    """
    spark = delta.sparkSession
    delta.write.mode("overwrite").parquet(f"{path}/batch={number}")
    if (number + 1) % every == 0:
        state = kept_state(spark, path, number + 1)
        (merge(state) if merge else state).write.mode("overwrite").parquet(f"{path}/base={number}")
        for kind in ("base", "batch"):
            for old in _written(spark, path, kind):
                if old < number or kind == "batch" and old == number:
                    fs, at = _folder(spark, f"{path}/{kind}={old}")
                    fs.delete(at, True)


def score_new(stream: DataFrame, keys: list[str], forms: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Score each text when it arrives. A batch writes a folder of its own number, so a retry overwrites what it left."""

    def batch(df: DataFrame, number: int) -> None:
        M.counted(df, keys, forms).withColumn("index", M.index(F.col("occ"), F.col("other"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_first_new(stream: DataFrame, text: str, out: str, checkpoint: str, time: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Drop texts whose repeat key was seen. Without a time column the keys are kept for ever; with one, for `delay`."""
    keyed = stream.withColumn("key", T.repeat_key(F.col(text)))
    first = keyed.dropDuplicates(["key"]) if time is None else keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])
    return first.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_first_by_table(stream: DataFrame, text: str, order: list[str], out: str, seen: str, checkpoint: str, every: int = 10) -> StreamingQuery:
    """As keep_first_new(), with the keys in a table: nothing is kept in memory between batches, whatever their number.

    A key is the SHA-256 of a text as it is compared (repeat_text), so only equal
    texts share one. Of a batch the first of each key in `order` stays, if no
    batch before has it. A batch writes folders of its own number: a retry looks
    at earlier ones only and writes the same again. A null text is a key too.
    """

    def batch(df: DataFrame, number: int) -> None:
        keyed = df.withColumn("_key", F.sha2(F.coalesce(T.repeat_text(F.col(text)), F.lit("")), 256))
        known = kept_state(df.sparkSession, seen, number)
        fresh = keyed if known is None else keyed.join(known, "_key", "left_anti")
        first = keep_first(fresh, ["_key"], order)
        first.drop("_key").write.mode("overwrite").parquet(f"{out}/batch={number}")
        # What was written decides, so that keys and rows can't differ.
        written = df.sparkSession.read.parquet(f"{out}/batch={number}")
        add_delta(written.select(F.sha2(F.coalesce(T.repeat_text(F.col(text)), F.lit("")), 256).alias("_key")), number, seen, every)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _summed(by: list[str]):
    return lambda df: df.groupBy(*by).agg(F.sum("count").alias("count"))


def running_counts(stream: DataFrame, by: list[str], out: str, checkpoint: str, every: int = 10) -> StreamingQuery:
    """Counts of each group, a delta for each batch and a base each `every` (add_delta); no state stays in memory."""

    def batch(df: DataFrame, number: int) -> None:
        add_delta(df.groupBy(*by).count(), number, out, every, _summed(by))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_counts(spark: SparkSession, by: list[str], out: str) -> DataFrame:
    """by, count: each group so far, from the last base and the deltas since."""
    return _summed(by)(kept_state(spark, out))


def stop_after(stream: DataFrame, keep, limit: int, out: str, checkpoint: str) -> StreamingQuery:
    """Write kept rows batch by batch and skip batches once `limit` rows are there; a batch is always written whole."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        earlier = [n for n in _written(spark, out, "batch") if n < number]
        have = sum(spark.read.parquet(f"{out}/batch={n}").count() for n in earlier)
        if have < limit:
            df.filter(keep).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
