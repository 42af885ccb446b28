"""Cut lineage in loops, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and everything runs on this machine."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="isogloss-")


def cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums of expressions over rows in order inside each `by`, the own row included.

    Rows are sorted into slices over all tasks, so one `by` may hold any number
    of rows; sums go on from slice to slice by a table of a row for each. Of
    equal rows in `order` any may come first.
    """
    keys = [F.col(c) for c in by]
    rows = df.withColumns({f"_{n}": v for n, v in sums.items()})
    rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_slice", F.shiftright("_at", 33)))
    inside = Window.partitionBy(*by, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(*by, "_slice").agg(*[F.sum(f"_{n}").alias(f"_s_{n}") for n in sums])
    slices = slices.select(*by, "_slice", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    rows = rows.withColumns({n: F.sum(f"_{n}").over(inside) for n in sums}).join(slices, [*by, "_slice"])
    return rows.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop("_at", "_slice", *[f"{p}{n}" for n in sums for p in ("_", "_b_")])
