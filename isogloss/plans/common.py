"""Frames that several plans start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segment
from .registry import table


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table of a few rows, which goes to all tasks. Spark doesn't know its size before the other side of a join is being shuffled."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt by id where the scan alone would leave most cores without a task."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    cores = spark.sparkContext.defaultParallelism
    return d if d.rdd.getNumPartitions() >= 4 * cores else d.repartition(cores, "doc_id")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.explode_sentences(documents(spark, sf_dir))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, a, b: each turn of a conversation with the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1_000_000_000 + F.col("turn")).alias("id"), F.col("text").alias("a"), "b")
