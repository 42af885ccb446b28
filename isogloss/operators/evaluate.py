"""Evaluation of hypotheses against references, in columns."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T


def _units(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def exact(hyp: Column, ref: Column) -> Column:
    norm = lambda c: F.lower(F.trim(T.fold_apostrophes(c)))
    return norm(hyp) == norm(ref)


def word_edits(a: Column, b: Column) -> Column:
    """Levenshtein distance of blank-separated words: each distinct word of the pair becomes one character, of a million that there are beyond U+FFFF."""

    def edits(p: Column) -> Column:
        code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(65535) + F.array_position(p["v"], w)), 8, "0")), "UTF-32")
        text = lambda words: F.array_join(F.transform(words, code), "")
        return F.when(p["a"] == p["b"], 0).otherwise(F.levenshtein(text(p["a"]), text(p["b"])))

    # Words and vocabulary are bound to variables, else they would be made anew for every word.
    units = F.transform(F.array(F.struct(_units(a).alias("a"), _units(b).alias("b"))), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.array_distinct(F.concat(p["a"], p["b"])).alias("v")))
    return F.transform(units, edits)[0]


def _matches(hyp: list | str, ref: list | str, n: int) -> tuple[int, int, int]:
    """Clipped matches of the n-grams of both sides, and how many each has; of texts (characters) or lists of words.

    What both sides begin and end with is left out of the count: n-grams that lie
    inside of it are matches on both sides, whatever else there is of them.
    """
    cut = (lambda x, i: x[i : i + n]) if isinstance(hyp, str) else (lambda x, i: tuple(x[i : i + n]))
    nh, nr = max(0, len(hyp) - n + 1), max(0, len(ref) - n + 1)
    if hyp == ref:
        return nh, nh, nr
    most = min(len(hyp), len(ref))
    head = next((i for i in range(most) if hyp[i] != ref[i]), most)
    tail = next((i for i in range(most - head) if hyp[-1 - i] != ref[-1 - i]), most - head)
    first, last = max(0, head - n + 1), max(0, tail - n + 1)
    h, r = (Counter([cut(x, i) for i in range(first, k - last)]) for x, k in ((hyp, nh), (ref, nr)))
    return first + last + sum(min(c, r[g]) for g, c in h.items() if g in r), nh, nr


def bleu(df: DataFrame, key: str, hyp: str, ref: str) -> DataFrame:
    """key, bleu: sentence BLEU of blank-separated lower-cased tokens, orders 1 to 4.

    A precision without a match is 1 / (2^k * total), where k counts such orders
    so far; orders the hypothesis is too short for are left out. The brevity
    penalty is exp(1 - ref / hyp) for a shorter hypothesis. A row's n-grams are
    counted in its own task, so nothing is shuffled.
    """

    @F.pandas_udf(DoubleType())
    def score(h: pd.Series, r: pd.Series) -> pd.Series:
        def one(x: list[str], y: list[str]) -> float:
            zeros, logs = 0, []
            for n in range(1, 5):
                match, nh, _ = _matches(x, y, n)
                if nh:
                    zeros += not match
                    logs.append(math.log(match / nh if match else 1 / (2.0**zeros * nh)))
            penalty = math.exp(1 - len(y) / len(x)) if 0 < len(x) < len(y) else 1.0
            return 100 * penalty * math.exp(sum(logs) / len(logs)) if logs else 0.0

        return pd.Series([one(list(x), list(y)) for x, y in zip(h, r)], dtype=float)

    none = F.expr("cast(array() as array<string>)")
    u = lambda c: F.coalesce(_units(F.lower(c)), none)
    return df.select(key, score(u(F.col(hyp)), u(F.col(ref))).alias("bleu"))


def _f_scores(hyp: list[str] | str, ref: list[str] | str, orders: int, beta: float) -> list[float]:
    """F-beta of the n-grams of each order that either side has."""
    out = []
    for n in range(1, orders + 1):
        both, nh, nr = _matches(hyp, ref, n)
        if nh or nr:
            p, c = both / nh if nh else 0.0, both / nr if nr else 0.0
            out.append((1 + beta**2) * p * c / (beta**2 * p + c) if p + c else 0.0)
    return out


def chrf(df: DataFrame, key: str, hyp: str, ref: str, words: int | dict[str, int] = 0, beta: float = 2.0) -> DataFrame:
    """key, chrf: mean F-beta of characters (1 to 6, without blanks) and, for chrF++, of words (1 to `words`).

    Of several `words` by name there is a column for each; characters are counted
    once for all. A row's counts fit in its own task, and as rows of a table they
    would be some hundred times the text, so this one is scored in Arrow batches.
    """
    named = words if isinstance(words, dict) else {"chrf": words}
    most = max(named.values())

    @F.pandas_udf(ArrayType(DoubleType()))
    def score(h: pd.Series, r: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> list[float]:
            a, b = x.split(), y.split()
            chars, of_words = _f_scores("".join(a), "".join(b), 6, beta), _f_scores(a, b, most, beta)
            each = [chars + of_words[:n] for n in named.values()]
            return [100 * sum(f) / len(f) if f else 0.0 for f in each]

        return pd.Series([one(x or "", y or "") for x, y in zip(h, r)], dtype=object)

    return df.select(key, score(hyp, ref).alias("s")).select(key, *[F.col("s")[k].alias(n) for k, n in enumerate(named)])


def evaluated(benchmark: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Benchmark rows (id, input, reference) with hypothesis, failed, exact, edits and ref_words.

    A row without a hypothesis keeps its input as one and counts as failed.
    """
    j = benchmark.join(hypotheses.select("id", "hypothesis"), "id", "left").withColumn("failed", F.col("hypothesis").isNull()).withColumn("hypothesis", F.coalesce("hypothesis", "input"))
    return j.withColumn("exact", exact(F.col("hypothesis"), F.col("reference"))).withColumn("edits", word_edits(F.col("hypothesis"), F.col("reference"))).withColumn("ref_words", F.size(_units(F.col("reference"))))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """n, failed, exact, and the corpus rate of word edits in percent."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"), F.count_if("exact").alias("exact"), F.round(100 * F.sum("edits") / F.sum("ref_words"), 6).alias("wer"))


def judge_score(spans: Column) -> Column:
    """100 less 10 for a major and 2.5 for a minor error, 0 at least; spans is an array of severities."""
    lost = F.aggregate(spans, F.lit(0.0), lambda a, s: a + F.when(s == "major", 10.0).when(s == "minor", 2.5).otherwise(0.0))
    return F.greatest(F.lit(0.0), 100.0 - lost)


def contrast(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """wins, ties, losses of a over b, and the mean gap."""
    j = a.select(key, F.col(score).alias("x")).join(b.select(key, F.col(score).alias("y")), key)
    return j.agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.count_if(F.col("x") < F.col("y")).alias("losses"), F.round(F.avg(F.col("x") - F.col("y")), 6).alias("gap"))


def metric_rows(summary: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, value: a row for each figure of a summary, to be written as a table or as JSON."""
    figures = [c for c in summary.columns if c not in keys]
    return summary.select(*keys, *[F.col(c).cast("double").alias(c) for c in figures]).unpivot(keys, figures, "metric", "value")
