"""Readers: marked-up corpora, JSON lines, TSV, plain lines and web pages."""

from __future__ import annotations

import html
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..operators.lineage import cut

ATTRIBUTES = r'(\w+)="([^"]*)"'


def _attributes(c: Column) -> Column:
    return F.map_from_arrays(F.regexp_extract_all(c, F.lit(ATTRIBUTES), F.lit(1)), F.regexp_extract_all(c, F.lit(ATTRIBUTES), F.lit(2)))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Character references; only texts with an ampersand leave the JVM."""
    return F.when(c.contains("&"), _unescape(c)).otherwise(c)


def prevert(spark: SparkSession, path: str) -> DataFrame:
    """doc, domain, url, par_id, quality, lang, heading, sensitive, lm_score, text of a corpus of <doc> and <p> lines.

    Files are split at </doc>, so documents are read in parallel; gz and bz2 are
    read as they are. Lines outside of <p> don't count, and the lines of a
    paragraph are joined by blanks.
    """
    raw = spark.read.option("lineSep", "</doc>").text(path)
    doc = raw.select(_attributes(F.regexp_extract("value", r"<doc ([^>]*)>", 1)).alias("d"), F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<p( [^>]*)?>(.*?)</p>"), F.lit(0))).alias("p"))
    p = doc.select("d", _attributes(F.regexp_extract("p", r"<p( [^>]*)?>", 1)).alias("a"), F.regexp_extract("p", r"(?s)<p(?: [^>]*)?>(.*?)</p>", 1).alias("body"))
    lines = T.filled(F.split("body", "\n"))
    get = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    return p.select(
        get("d", "id").alias("doc"), get("d", "domain").alias("domain"), get("d", "url").alias("url"), get("a", "id").alias("par_id"), get("a", "quality").alias("quality"), get("a", "lang").alias("lang"),
        get("a", "heading").alias("heading"), get("a", "sensitive").alias("sensitive"), get("a", "lm_score").try_cast("double").alias("lm_score"), unescape(F.array_join(lines, " ")).alias("text"),
    )


_HEADER = b"PK\x03\x04"


def _member(piece: bytes) -> tuple[str, int, int, int, int, int]:
    """Name, method, start of the data, and the sizes and checksum that a local header (without its signature) states; -1 where they stand behind the data."""
    flags, method, _, _, crc, packed, _, n, m = struct.unpack("<xxHHHHIIIHH", piece[:26])
    name = piece[26 : 26 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
    if flags & 1:
        raise ValueError(f"{name} is encrypted")
    if flags & 8:
        return name, method, 26 + n + m, -1, -1, flags
    if packed == 0xFFFFFFFF:  # eight bytes each, in the extra field
        extra, at = piece[26 + n : 26 + n + m], 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack("<HH", extra[at : at + 4])
            if kind == 1:
                packed = struct.unpack("<Q", extra[at + 12 : at + 20])[0]
            at += 4 + size
    return name, method, 26 + n + m, packed, crc, flags


def _unpacked(pieces: Iterator[bytes]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """Members of the pieces of a zip file between signatures. A signature inside of a member's data is put back."""
    held: bytes | None = None
    for piece in pieces:
        held = piece if held is None else held + _HEADER + piece
        if len(held) < 26:
            held = None
            continue
        name, method, start, packed, crc, flags = _member(held)
        if method == 8:
            z = zlib.decompressobj(-15)
            body = z.decompress(held[start:])
            if not z.eof:
                continue  # more of it behind the next signature
            crc = struct.unpack("<I", z.unused_data[4:8] if z.unused_data[:4] == b"PK\x07\x08" else z.unused_data[:4])[0] if crc < 0 else crc
        elif method == 0 and packed >= 0:
            if len(held) < start + packed:
                continue
            body = held[start : start + packed]
        else:
            raise ValueError(f"{name} is packed in a way that isn't known (method {method}, flags {flags})")
        if zlib.crc32(body) != crc:
            raise ValueError(f"{name} doesn't match its checksum")
        held = None
        yield name, body
    if held is not None:
        raise ValueError(f"{_member(held)[0]} isn't whole in its part of the file; read larger parts (spark.sql.files.maxPartitionBytes)")


def zipped_members(spark: SparkSession, path: str) -> DataFrame:
    """file, member, content (binary) of the members of zip files, stored or deflated, with checksums compared.

    Files are split like lines, at the signature that stands before each member,
    so the members of one file are read by many tasks and none holds the file.
    Members are those that have a header in the file, folders left out.
    """
    raw = spark.read.option("lineSep", _HEADER.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int, bytes]]:
            for b in batches:
                for i in range(b.num_rows):
                    yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()

        for (file, block), part in groupby(rows(), key=lambda r: r[:2]):
            pieces = (r[2] for r in part)
            if block == 0:
                next(pieces)  # what stands before the first signature
            for name, body in _unpacked(pieces):
                if not name.endswith("/"):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([name]), pa.array([body], pa.binary())], ["file", "member", "content"])

    return raw.mapInArrow(run, "file string, member string, content binary")


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, member, line_no, value of text members of zip files (zipped_members); a last line break ends no line."""
    lines_ = F.split(F.regexp_replace(F.col("content").cast("string"), r"\n\z", ""), "\n")
    return zipped_members(spark, path).filter(F.octet_length("content") > 0).select("file", "member", F.posexplode(lines_).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("long"))


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of plain or compressed text (gz, bz2, as Spark reads them), or of the members of zip files."""
    return zipped_lines(spark, path).select("value") if path.endswith(".zip") else spark.read.text(path)


def trial(rows: DataFrame, order: list[str], limit_bytes: Column, text: str = "text") -> DataFrame:
    """The first rows in order, up to and with the one that reaches limit_bytes of text.

    Bytes are summed by partition of a range sort, then inside each, so a trial
    of any size takes no single task. A null text has no bytes.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    ranged = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).withColumn("_n", size))
    parts = ranged.groupBy("_p").agg(F.sum("_n").alias("_part"))
    parts = parts.select("_p", F.coalesce(F.sum("_part").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(parts, "_p").withColumn("_at", F.col("_before") + inside).filter(F.col("_at") < limit_bytes).drop("_p", "_n", "_before", "_at")


def json_records(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good records of JSON lines (or of one array a file), and the lines that aren't JSON."""
    raw = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", multi_line).json(path)
    return raw.filter("_bad is null").drop("_bad"), raw.filter("_bad is not null").select(F.col("_bad").alias("line"))


def repaired_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """record, repaired (something stood before the first brace) and lost of each line."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    body = F.regexp_extract("value", r"(\{.*)", 1)
    got = raw.select(F.from_json(body, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("record"), (F.instr("value", "{") > 1).alias("dirty"), (body == "").alias("none"))
    lost = F.col("none") | F.col("record").isNull() | F.col("record._bad").isNotNull()
    return got.select(F.when(~lost, F.col("record").dropFields("_bad")).alias("record"), (F.col("dirty") & ~lost).alias("repaired"), lost.alias("lost"))


def tsv(spark: SparkSession, path: str, text: str) -> DataFrame:
    """A TSV with a header, whose text column writes line breaks as backslash n."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return df.withColumn(text, F.replace(text, F.lit("\\n"), F.lit("\n")))


def _in_file(spark: SparkSession, path: str) -> DataFrame:
    """file, block, o, value: lines of text files; o grows by one from line to line inside a block of a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("o"), "value")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """id and text of lines that aren't empty, trimmed: L1, L2 and so on, through all files in the order of their names.

    Only the counts of blocks are put in order in one place; lines stay where they are read.
    """
    raw = _in_file(spark, path).withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).filter("value <> ''")
    # Lines are numbered after the filter, so that places have no gaps in a block.
    raw = raw.withColumn("o", F.monotonically_increasing_id())
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("o").alias("start"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), "start", before.alias("before"))
    placed = raw.join(blocks, (raw["file"] == blocks["f"]) & (raw["block"] == blocks["b"]))
    return placed.select(F.concat(F.lit("L"), (F.col("o") - F.col("start") + F.col("before") + 1).cast("string")).alias("id"), F.col("value").alias("text"))


def aligned_lines(spark: SparkSession, path: str, sides: tuple[str, str]) -> DataFrame:
    """part, line and the sides: what writers.aligned_sides() wrote, line by line."""

    def side(s: str) -> DataFrame:
        at = _in_file(spark, f"{path}/{s}").withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
        return at.select("part", F.row_number().over(Window.partitionBy("part").orderBy("block", "o")).alias("line"), F.col("value").alias(s))

    return side(sides[0]).join(side(sides[1]), ["part", "line"], "full")


def frequency_table(spark: SparkSession, path: str) -> DataFrame:
    """form, n of a JSON file with a map freq."""
    return spark.read.schema("text string, freq map<string,long>").option("multiLine", True).json(path).select(F.explode("freq").alias("form", "n"))


_HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|article|footer|title|section)\b[^>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


@F.pandas_udf(StringType())
def _references(s: pd.Series) -> pd.Series:
    known = dict(ENTITIES)
    return s.str.replace(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: known.get(m[0]) or html.unescape(m[0]), regex=True)


def visible_text(page: Column, every: bool = False) -> Column:
    """Text without hidden parts and tags, a block to a line. References are those of ENTITIES, or `every` one that ends in a semicolon; each is resolved once."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(page, _HIDDEN, " "), _BLOCK, "\n"), "<[^>]*>", "")
    if every:
        c = F.when(c.contains("&"), _references(c)).otherwise(c)
    else:
        for entity, char in ENTITIES:
            c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(F.regexp_replace(c, r"[\t\r ]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def page_documents(pages: DataFrame) -> DataFrame:
    """id (of the url), page_id, title, text and words of pages (page_id, url, html)."""
    title = F.coalesce(*[F.nullif(visible_text(F.regexp_extract("html", p, 1)), F.lit("")) for p in (r"(?is)<h1\b[^>]*>(.*?)</h1>", r"(?is)<title\b[^>]*>(.*?)</title>")])
    text = visible_text(F.col("html"))
    return pages.select(F.substring(F.md5("url"), 1, 12).alias("id"), "page_id", title.alias("title"), text.alias("text")).withColumn("words", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))


def page_links(pages: DataFrame, pattern: str) -> DataFrame:
    """page_id, link: absolute links without their query that match a pattern, once for each page."""
    host = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    l = pages.select("page_id", host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))  # noqa: E741
    bare = F.regexp_replace("href", r"[?#].*$", "")
    return l.select("page_id", F.when(bare.startswith("/"), F.concat("host", bare)).otherwise(bare).alias("link")).filter(F.col("link").rlike(pattern)).distinct()


def page_chapters(pages: DataFrame, heading: str = r"(?i)<p\b[^>]*>") -> DataFrame:
    """page_id, chapter, text: a page split at a mark; what stands before the first is chapter 0."""
    return pages.select("page_id", F.posexplode(F.split("html", heading)).alias("chapter", "part")).select("page_id", "chapter", visible_text(F.col("part")).alias("text")).filter("text <> ''")


def headed_chapters(pages: DataFrame, levels: str = "1-6") -> DataFrame:
    """page_id, chapter, level, heading, text: a page split at its headings of some levels; what stands before the first is chapter 0, without a heading.

    A chapter without text stays if it has a heading. Headings in hidden parts don't count.
    """
    shown = F.regexp_replace("html", _HIDDEN, " ")
    parts = F.split(shown, rf"(?i)(?=<h[{levels}]\b[^>]*>)")
    c = pages.select("page_id", F.posexplode(parts).alias("chapter", "part"))
    pattern = rf"(?is)^<h([{levels}])\b[^>]*>(.*?)</h\1\s*>(.*)$"
    # A page that begins with a heading has no chapter 0, and a split there leaves none.
    first = F.when(F.col("part").rlike(rf"(?i)^<h[{levels}]\b"), 1).otherwise(0)
    level = F.regexp_extract("part", pattern, 1)
    c = c.withColumn("level", F.when(level != "", level.cast("int")))
    body = F.when(F.col("level").isNull(), F.col("part")).otherwise(F.regexp_extract("part", pattern, 3))
    c = c.select("page_id", "chapter", "level", F.when(F.col("level").isNotNull(), visible_text(F.regexp_extract("part", pattern, 2))).alias("heading"), visible_text(body).alias("text"), first.alias("_headed"))
    w = Window.partitionBy("page_id").orderBy("chapter")
    c = c.withColumn("chapter", F.col("chapter") + F.first("_headed").over(w)).drop("_headed")
    return c.filter((F.col("text") != "") | F.col("heading").isNotNull())


def cms_documents(spark: SparkSession, path: str) -> DataFrame:
    """url, title, date, text of items with rendered title and content."""
    items = spark.read.schema("link string, date string, title struct<rendered:string>, content struct<rendered:string>").json(path)
    return items.select(F.col("link").alias("url"), visible_text(F.col("title.rendered"), True).alias("title"), F.to_date(F.substring("date", 1, 10)).alias("date"), visible_text(F.col("content.rendered"), True).alias("text"))
