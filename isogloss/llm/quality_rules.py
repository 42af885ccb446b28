"""Quality rules with thresholds that adapt to each language and source.

Every document is measured once. Each measure becomes an integer, and integers
become buckets of a log-linear histogram (exact to 1/64). Such a histogram is a
quantile sketch that merges by adding counts: those of (language, source) add up
to those of the language and of the whole. Quartiles of a sketch give a fence,
upper quartile plus FENCE times the spread (at least `least`); groups of fewer
than MIN_DOCS documents take the fence of the language, or of all documents.
The fences are joined to the measured documents, which then pass or fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .common import cut, pick, table

FENCE, MIN_DOCS = 3, 200
#: Measure: (numerator, denominator, scale, smallest spread, whether low values fail too).
MEASURES = {
    "word_length": ("word_chars", "n_words", 100, 50, True),
    "symbols": ("n_symbols", "n_words", 1000, 20, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 50, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 50, False),
    "capitals": ("n_upper", "word_chars", 1000, 30, False),
    "marks": ("n_marks", "n_words", 1000, 20, False),
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in kernel.chunks(b.column("text")):
                m = kernel.measures(buf, off)
                cols = [b.column(c).slice(lo, hi - lo) for c in ("doc_id", "lang", "source")] + [pa.array(m[c].astype(np.int64)) for c in _COUNTS]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "source", *_COUNTS])

    rows = pick(docs, "doc_id", "lang", "source", "text")
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {id_type}, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def _value(name: str) -> Column:
    num, den, scale, _, _ = MEASURES[name]
    return F.expr(f"if({den} = 0, 0L, {scale} * {num} div {den})")


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the mergeable sketch of each group; documents without words have no part."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), _value(m).alias("v")) for m in MEASURES])
    shift = "greatest(0, length(bin(v)) - 7)"
    return (
        rows.filter("n_words > 0").select("lang", "source", F.explode(each).alias("e")).select("lang", "source", "e.measure", "e.v")
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})"))
        .groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """q1, q3 and n of the sketches merged by keys, per measure."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    run = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    return run.groupBy(*keys, "measure").agg(
        F.min(F.when(F.expr("4 * upto >= total"), F.col("bucket"))).alias("q1"), F.min(F.when(F.expr("4 * upto >= 3 * total"), F.col("bucket"))).alias("q3"), F.first("total").alias("n")
    )


def thresholds(sketch: DataFrame, fence: int = FENCE, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source and lo_/hi_ of each measure, a row per group."""
    own = quartiles(sketch, "lang", "source")
    lang = quartiles(sketch, "lang").select(F.col("lang").alias("l"), F.col("measure").alias("ml"), F.struct("q1", "q3").alias("by_lang"), F.col("n").alias("n_lang"))
    all_ = quartiles(sketch).select("measure", F.struct("q1", "q3").alias("by_all"))
    joined = own.join(lang, own["lang"].eqNullSafe(lang["l"]) & (own["measure"] == lang["ml"])).join(all_, "measure")
    q = F.when(F.col("n") >= min_docs, F.struct("q1", "q3")).when(F.col("n_lang") >= min_docs, F.col("by_lang")).otherwise(F.col("by_all"))
    q = joined.select("lang", "source", "measure", q.alias("q")).select("lang", "source", "measure", "q.q1", "q.q3")
    out = []
    for m, (_, _, _, least, _) in MEASURES.items():
        spread = fence * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        out += [F.max(F.when(F.col("measure") == m, F.col("q1") - spread)).alias(f"lo_{m}"), F.max(F.when(F.col("measure") == m, F.col("q3") + spread)).alias(f"hi_{m}")]
    return q.groupBy("lang", "source").agg(*out)


def judged(docs: DataFrame, fence: int = FENCE, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, the counts, base_failed, failed (names of the failing measures) and kept, one row per row of docs.

    docs has doc_id, text, lang and source. A null text has no words and fails
    the base rules; a null language or source is a group of its own. Repeated
    rows each count and each get a row. Extra columns are ignored.
    """
    rows = cut(measured(docs))
    limits = thresholds(cut(sketches(rows)), fence, min_docs).withColumnsRenamed({"lang": "group_lang", "source": "group_source"})
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["group_lang"]) & rows["source"].eqNullSafe(limits["group_source"]), "left")
    fails = [F.when((_value(m) > F.col(f"hi_{m}")) | ((_value(m) < F.col(f"lo_{m}")) if low else F.lit(False)), F.lit(m)) for m, (_, _, _, _, low) in MEASURES.items()]
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return joined.select("doc_id", *_COUNTS, base.alias("base_failed"), F.concat_ws(",", *fails).alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def _sql() -> str:
    value = {m: f"CASE WHEN {den} = 0 THEN 0 ELSE {scale} * {num} // {den} END" for m, (num, den, scale, _, _) in MEASURES.items()}
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {v} AS v FROM c WHERE n_words > 0" for m, v in value.items())
    spread = {m: f"{FENCE} * greatest(q3 - q1, {x[3]})" for m, x in MEASURES.items()}
    limit = ", ".join(f"max(CASE WHEN measure = '{m}' THEN q1 - {s} END) AS lo_{m}, max(CASE WHEN measure = '{m}' THEN q3 + {s} END) AS hi_{m}" for m, s in spread.items())
    fails = ", ".join(f"CASE WHEN ({v}) > hi_{m}" + (f" OR ({v}) < lo_{m}" if MEASURES[m][4] else "") + f" THEN '{m}' END" for m, v in value.items())

    def quart(keys: str) -> str:
        k = f"{keys}, " if keys else ""
        return f"""
  SELECT {k}measure, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3, max(total) AS n
  FROM (SELECT *, sum(n) OVER (PARTITION BY {k}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {k}measure) AS total
        FROM (SELECT {k}measure, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY {k}measure"""

    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
cnt AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM cnt, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^!?]+', '', 'g'))::BIGINT AS n_marks
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
v AS ({each}),
sk AS (SELECT lang, source, measure, (v >> greatest(0, length(bin(v)) - 7)) << greatest(0, length(bin(v)) - 7) AS bucket, count(*) AS n FROM v GROUP BY ALL),
own AS ({quart("lang, source")}), by_lang AS ({quart("lang")}), by_all AS ({quart("")}),
q AS (
  SELECT o.lang, o.source, o.measure, CASE WHEN o.n >= {MIN_DOCS} THEN o.q1 WHEN l.n >= {MIN_DOCS} THEN l.q1 ELSE a.q1 END AS q1,
         CASE WHEN o.n >= {MIN_DOCS} THEN o.q3 WHEN l.n >= {MIN_DOCS} THEN l.q3 ELSE a.q3 END AS q3
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN by_all a ON o.measure = a.measure),
lim AS (SELECT lang, source, {limit} FROM q GROUP BY lang, source),
f AS (
  SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {fails}) AS failed
  FROM c LEFT JOIN lim ON c.lang IS NOT DISTINCT FROM lim.lang AND c.source IS NOT DISTINCT FROM lim.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM f
"""


QUERIES = {"op4_quality_rules": op4}
ORACLE_SQL = {"op4_quality_rules": _sql()}
