"""Marker matching and the variety index of texts.

forms: form, side ('occ' or 'or'), and optionally kind ('simple' or 'verb') and
allowed_pos (array). phrases: phrase, side. Lexicons are tables; Spark sends
them to all tasks while they are small and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def token_rows(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, i, form: a row per token, and one of nulls for a text without."""
    return texts.select(*keys, F.posexplode_outer(T.tokens(F.col(text))).alias("i", "form"))


def matched(tokens: DataFrame, forms: DataFrame, pos: str | None = None) -> DataFrame:
    """tokens with side: null unless the form is a marker that its part of speech (if there is such a column) allows."""
    joined = tokens.join(forms, "form", "left")
    if pos is None:
        return joined
    p = F.col(pos)
    fits = p.isNull() | ((F.coalesce("kind", F.lit("simple")) != "verb") | p.isin("VERB", "AUX")) & (F.col("allowed_pos").isNull() | F.array_contains("allowed_pos", p)) & (p != "PROPN")
    return joined.withColumn("side", F.when(fits, F.col("side")))


def index(occ: Column, other: Column) -> Column:
    """occ / (occ + other); null without markers."""
    return F.when(occ + other > 0, occ / (occ + other))


def share(other: Column, words: Column, empty: float | None = 1.0) -> Column:
    """1 - other / words; `empty` for no words."""
    return F.when(words > 0, 1 - other / words).otherwise(F.lit(empty).cast("double"))


def scored(texts: DataFrame, keys: list[str], forms: DataFrame, text: str = "text", assumed: float | None = None) -> DataFrame:
    """keys, words, occ, other, index, gdv, gdc and the ordered markers of both sides of every text."""
    hits = matched(token_rows(texts, keys, text), forms.select("form", "side"))
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("i", "form")))), lambda x: x["form"])
    out = hits.groupBy(*keys).agg(
        F.count("form").alias("words"), F.count_if(F.col("side") == "occ").alias("occ"), F.count_if(F.col("side") == "or").alias("other"), listed("occ").alias("occ_markers"), listed("or").alias("other_markers")
    )
    i = index(F.col("occ"), F.col("other"))
    if assumed is not None:
        i = F.coalesce(i, F.lit(assumed))
    return out.withColumn("index", i).withColumn("gdv", share(F.col("other"), F.col("words"))).withColumn("gdc", share(F.col("occ"), F.col("words")))


def counted(texts: DataFrame, keys: list[str], forms: DataFrame, text: str = "text") -> DataFrame:
    """keys, words, occ, other: the counts alone, combined before the shuffle."""
    hits = matched(token_rows(texts, keys, text), forms.select("form", "side"))
    return hits.groupBy(*keys).agg(F.count("form").alias("words"), F.count_if(F.col("side") == "occ").alias("occ"), F.count_if(F.col("side") == "or").alias("other"))


def could_pass(texts: DataFrame, keys: list[str], forms: DataFrame, homographs: DataFrame, at_least: int = 1, over: float = 0.5, text: str = "text") -> DataFrame:
    """keys of the texts whose index may exceed `over`, by bounds, so that a costly exact score is left for these alone.

    Parts of speech can only take western markers away, so all western forms of
    a text are the most it can have; eastern forms that are neither homographs
    nor verbs are the fewest of the other side. No text that passes is lost.
    """
    certain = (F.col("side") == "occ") | F.col("_homograph").isNull()
    if "kind" in forms.columns:
        certain &= (F.col("side") == "occ") | (F.coalesce("kind", F.lit("simple")) != "verb")
    known = forms.join(homographs.select("form").distinct().withColumn("_homograph", F.lit(True)), "form", "left").filter(certain)
    n = counted(texts, keys, known.select("form", "side"), text)
    return n.filter((F.col("occ") >= at_least) & (index(F.col("occ"), F.col("other")) > over)).select(*keys)


def corpus_index(counts: DataFrame, *by: str) -> DataFrame:
    """Of counted(): texts, sums, the index of the sums, and the mean of the texts' indices (those that have one).

    Each text's index counts in whole billionths, so that the mean doesn't depend on the order of summing.
    """
    each = F.when(F.col("occ") + F.col("other") > 0, F.expr("occ * 1000000000L div (occ + other)"))
    mean = F.round(F.sum(each) / F.count(each) / 1e9, 6)
    out = counts.groupBy(*by).agg(F.count("*").alias("texts"), F.sum("words").alias("words"), F.sum("occ").alias("occ"), F.sum("other").alias("other"), mean.alias("mean_index"))
    return out.withColumn("index", index(F.col("occ"), F.col("other"))).withColumn("gdv", share(F.col("other"), F.col("words"), None)).withColumn("gdc", share(F.col("occ"), F.col("words"), None))


def phrase_hits(texts: DataFrame, keys: list[str], phrases: DataFrame, longest: int | None = None, text: str = "text") -> DataFrame:
    """keys, i, n, phrase, side: every occurrence of every phrase, overlaps too; of `longest` words or fewer, if given, else of any length.

    Tokens meet the phrases that they begin, and only then are the next words
    compared, as many as the longest phrase of the table has.
    """
    p = phrases.withColumn("first", F.substring_index("phrase", " ", 1)).withColumn("n", F.size(F.split("phrase", " ")))
    if longest is None:
        longest = p.agg(F.max("n")).first()[0] or 1
    t = texts.select(*keys, T.tokens(F.col(text)).alias("t"))
    place = lambda x, i: F.struct(i.alias("i"), x.alias("first"), F.slice("t", i + 1, F.lit(longest)).alias("ahead"))
    places = t.select(*keys, F.explode(F.transform("t", place)).alias("p")).select(*keys, "p.*")
    return places.join(p.filter(F.col("n") <= longest), "first").filter(F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ") == F.col("phrase")).drop("first", "ahead")


def longest_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of phrase_hits(): longest first at each start, left to right without overlap; equal phrases at a place all stay."""
    w = Window.partitionBy(*keys, "i")
    best = hits.withColumn("most", F.max("n").over(w)).filter("n = most")
    starts = best.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("i", "n")))).alias("s"))
    zero = F.expr("cast(named_struct('nxt', 0, 'kept', cast(array() as array<int>)) as struct<nxt:int,kept:array<int>>)")
    fold = F.aggregate(
        "s", zero,
        lambda acc, x: F.when(x["i"] >= acc["nxt"], F.struct((x["i"] + x["n"]).alias("nxt"), F.array_append(acc["kept"], x["i"]).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    kept = starts.select(*keys, F.explode(fold).alias("i"))
    return best.drop("most").join(kept, [*keys, "i"])


def collocations(texts: DataFrame, markers: DataFrame, stop: DataFrame, width: int = 3, top: int = 20, text: str = "text") -> DataFrame:
    """marker, word, n: the `top` words most often within `width` tokens of each marker (markers: form), stop words out.

    Neighbours are cut inside a text's array, so no place is joined to a token;
    pairs are counted before they are shuffled.
    """
    t = texts.select(T.tokens(F.col(text)).alias("t"))

    def place(form: Column, i: Column) -> Column:
        left = F.slice("t", F.greatest(F.lit(1), i + 1 - width), F.least(i, F.lit(width)))
        return F.struct(form.alias("form"), F.concat(left, F.slice("t", i + 2, F.lit(width))).alias("near"))

    places = t.select(F.explode(F.transform("t", place)).alias("p")).select("p.*").join(markers.select("form"), "form", "left_semi")
    n = places.select(F.col("form").alias("marker"), F.explode("near").alias("word")).groupBy("marker", "word").agg(F.count("*").alias("n"))
    n = n.join(stop.select("word"), "word", "left_anti")
    return n.withColumn("r", F.row_number().over(Window.partitionBy("marker").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= top).drop("r").select("marker", "word", "n")


def new_markers(tokens: DataFrame, subset: Column, least: int = 50, ratio: float = 1.5, top: int = 100) -> DataFrame:
    """form, n_in, n_all, ratio of forms that are relatively frequent in a subset of token rows."""
    n = tokens.groupBy("form").agg(F.count_if(subset).alias("n_in"), F.count("*").alias("n_all"))
    total = tokens.agg(F.count_if(subset).alias("t_in"), F.count("*").alias("t_all"))
    r = (F.col("n_in") * F.col("t_all")) / (F.col("n_all") * F.col("t_in"))
    return n.filter(F.col("n_in") > least).crossJoin(total).withColumn("ratio", r).filter(F.col("ratio") > ratio).orderBy(F.desc("ratio"), "form").limit(top).select("form", "n_in", "n_all", "ratio")


def concordance(texts: DataFrame, keys: list[str], terms: DataFrame, width: int = 2, text: str = "text") -> DataFrame:
    """keys, i, form, left_context, right_context of every occurrence of a term (column form)."""
    t = texts.select(*keys, T.tokens(F.col(text)).alias("t"))

    def place(form: Column, i: Column) -> Column:
        # Contexts are cut here: a row of a token must not carry all tokens of its text.
        left = F.slice("t", F.greatest(F.lit(1), i + 1 - width), F.least(i, F.lit(width)))
        return F.struct(i.alias("i"), form.alias("form"), F.array_join(left, " ").alias("left_context"), F.array_join(F.slice("t", i + 2, width), " ").alias("right_context"))

    return t.select(*keys, F.explode(F.transform("t", place)).alias("p")).select(*keys, "p.*").join(terms.select("form"), "form")
