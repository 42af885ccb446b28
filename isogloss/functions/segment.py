"""Sentence and paragraph segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Where sentences end, all patterns and the abbreviations.
#: A closing mark, blanks, and a capital letter or an opening quote.
BREAK = r'(?<=[.!?])\s+(?=[«"“A-ZÀ-Ý])'
#: Also before a digit or a parenthesis.
WIDE_BREAK = r'(?<=[.!?])\s+(?=[A-ZÀÈÉÍÒÓÚÜÇ«"(0-9])'
PLAIN_BREAK = r"(?<=[.!?])\s+"
#: Also after an ellipsis and before single quotes and parentheses.
QUOTE_BREAK = r"""(?<=[.!?…])\s+(?=[A-ZÀÈÉÍÒÓÚÜÇ«"'(‘“])"""
#: Abbreviations after which a sentence goes on.
ABBREVIATIONS = [
    "sr", "sra", "sres", "dr", "dra", "d", "dna", "núm", "num", "art", "pàg", "pag", "p", "ex", "etc", "aprox", "vol", "ed", "coord", "tel", "c", "av", "prof", "cf", "ibid", "op", "cit", "s",
]


def sentences(text: Column, pattern: str = BREAK) -> Column:
    return F.split(text, pattern)


def rejoined(parts: Column, abbreviations: list[str] | None = None) -> Column:
    """Join a part to the one before if that ends in an abbreviation or an initial."""
    known = F.array(*[F.lit(a) for a in abbreviations or ABBREVIATIONS])
    start = F.expr("cast(array() as array<string>)")

    def add(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        word = F.lower(F.regexp_extract(last, r"([A-Za-zÀ-ÿ]+)\.?$", 1))
        goes_on = (F.size(acc) > 0) & (F.array_contains(known, word) | ((F.length(word) <= 1) & last.endswith(".")))
        return F.when(goes_on, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.concat(last, F.lit(" "), part))).otherwise(F.array_append(acc, part))

    return F.aggregate(T.filled(parts), start, add)


def explode_sentences(docs: DataFrame, text: str = "text", pattern: str = BREAK) -> DataFrame:
    """docs with a row per sentence: sent_no from 0, and the sentence in place of text."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(sentences(F.col(text), pattern)).alias("sent_no", text))


def explode_paragraphs(docs: DataFrame, text: str = "text", between: str = "\n") -> DataFrame:
    """A row per line (or what else is parted) with text: par_no from 0, trimmed."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(T.filled(F.split(F.col(text), between))).alias("par_no", text))


def line_sentences(docs: DataFrame, text: str = "text", pattern: str = WIDE_BREAK, between: str = "\n") -> DataFrame:
    """Paragraphs first, then their sentences: par_no and sent_no."""
    return explode_sentences(explode_paragraphs(docs, text, between), text, pattern)
