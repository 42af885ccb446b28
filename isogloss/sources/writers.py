"""Sinks: lines, aligned sides, chunks, merges, and what is still to do. Spark's commit protocol makes a write all or nothing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def csv_report(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def aligned_sides(pairs: DataFrame, path: str, key: str, sides: tuple[str, str], flags: str | None = None, suspicious: bool = False) -> None:
    """One text folder for each side, line by line in the same order; rows with flags stay out unless asked for."""
    rows = pairs if flags is None or suspicious else pairs.filter(F.size(flags) == 0)
    one = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    rows = rows.select(key, *[one(F.col(s)).alias(s) for s in sides]).repartitionByRange(key).sortWithinPartitions(key, *sides).persist()
    for s in sides:
        rows.select(s).write.text(f"{path}/{s}")
    rows.unpersist()


def classifier_lines(df: DataFrame, label: str, text: str, path: str) -> None:
    df.select(F.concat_ws(" ", F.concat(F.lit("__label__"), F.col(label).cast("string")), F.regexp_replace(text, r"\s+", " ")).alias("value")).write.text(path)


def numbered_chunks(df: DataFrame, order: list, size: int = 1000) -> DataFrame:
    """df with chunk: rows in order, `size` to a chunk. Places are counted by partition of a range sort, then inside."""
    from ..operators.lineage import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    n = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    before = n.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(before, "_p").withColumn("chunk", F.floor((place - 1) / size)).drop("_p", "before")


def merged_shards(shards: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """The union of shards, the first row of each key in order."""
    from functools import reduce

    from ..operators.selection import keep_first

    return keep_first(reduce(DataFrame.unionByName, shards), [key], order)


def still_to_do(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def routed(df: DataFrame, ambiguous) -> tuple[DataFrame, DataFrame]:
    """Final rows and pending rows."""
    return df.filter(~ambiguous), df.filter(ambiguous)


_HEADER = "PK\x03\x04"


def zipped(df: DataFrame, path: str, name: str, text: str) -> None:
    """A folder of zip files, one for each partition, with a deflated member for each row; a null name or text is left out.

    Spark's own text writer puts the signature of a member between the rows that
    it is given and behind the last, where it stands as the archive's comment, so
    a write is all or nothing in any store. A file of more than 65,534 members or
    4 GB ends in a directory of eight-byte sizes and places (Zip64).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, at, count = [], 4, 0
        held = b""  # before the first signature stands nothing

        def row(value: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])

        for b in batches:
            for member, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if member is None or content is None:
                    continue
                body, title = content.encode(), member.encode()
                z = zlib.compressobj(6, zlib.DEFLATED, -15)
                packed = z.compress(body) + z.flush()
                fields = struct.pack("<HHHHHIIIHH", 20, 0x800, 8, 0, 0x21, zlib.crc32(body), len(packed), len(body), len(title), 0)
                far = struct.pack("<HHQ", 1, 8, at - 4) if at - 4 >= 0xFFFFFFFF else b""
                directory.append(b"PK\x01\x02" + struct.pack("<H", 20) + fields[:-2] + struct.pack("<HHHHII", len(far), 0, 0, 0, 0, 0xFFFFFFFF if far else at - 4) + title + far)
                yield row(held)
                held = fields + title + packed
                at += 4 + len(held)
                count += 1
        if count:
            listed = b"".join(directory)
            start = at - 4
            more = b""
            if count > 0xFFFE or len(listed) >= 0xFFFFFFFF or start >= 0xFFFFFFFF:
                more = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(listed), start) + b"PK\x06\x07" + struct.pack("<IQI", 0, start + len(listed), 1)
            # The signature that the writer puts behind the last row is the comment, of four bytes.
            yield row(held + listed + more + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, *[min(count, 0xFFFF)] * 2, min(len(listed), 0xFFFFFFFF), min(start, 0xFFFFFFFF), 4))

    df.select(name, text).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", _HEADER).text(path)
