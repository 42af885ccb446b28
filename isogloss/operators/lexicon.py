"""Lexicon tables: inversion, lookups, indexes and checks.

pairs: src, dst, category, canonical, seq. All operators take and return tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _only(value):
    """The value if all of a group's are the same. Least and greatest are two values a group, where a set grows with the text."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def invert(pairs: DataFrame, key: str = "dst", value: str = "src") -> DataFrame:
    """key, value where there is one candidate, or else one that is canonical."""
    g = pairs.groupBy(key).agg(_only(F.col(value)).alias("all"), _only(F.when(F.col("canonical"), F.col(value))).alias("canon"))
    return g.select(key, F.coalesce("all", "canon").alias(value)).filter(F.col(value).isNotNull())


def forward(pairs: DataFrame, key: str = "src", value: str = "dst") -> DataFrame:
    """key, value: the canonical one if there is just one, else the first in file order."""
    g = pairs.groupBy(key).agg(_only(F.when(F.col("canonical"), F.col(value))).alias("canon"), F.min_by(value, "seq").alias("first"))
    return g.select(key, F.coalesce("canon", "first").alias(value))


def lookup(pairs: DataFrame, categories: list[str], topics: list[str]) -> DataFrame:
    """src, dst, words (of src): inverted pairs of some categories without some topics; equal pairs go after the choice."""
    chosen = invert(pairs.filter(F.col("category").isin(categories) & ~F.col("topic").isin(topics)))
    return chosen.filter("src <> dst").withColumn("words", F.size(F.split("src", " ")))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Pairs whose sides have one partner each."""
    single = lambda a, b: pairs.groupBy(a).agg(_only(F.col(b)).alias(b)).filter(F.col(b).isNotNull())
    return pairs.join(single("src", "dst").join(single("dst", "src"), ["src", "dst"]), ["src", "dst"], "left_semi").select(pairs.columns)


def collided(pairs: DataFrame) -> DataFrame:
    """Sides src of pairs whose dst has several partners."""
    once = pairs.select("src", "dst").distinct()
    several = once.groupBy("dst").agg(F.count("src").alias("n")).filter("n > 1").select("dst")
    return once.join(several, "dst", "left_semi").select("src").distinct()


def verb_collision(a, b):
    """Whether two verb forms differ as moods do: -en against -in or -ïn, or one is the other and an o."""
    return (a.rlike("en$") & b.rlike("[iï]n$")) | (a == F.concat(b, F.lit("o")))


def neutral(pairs: DataFrame) -> DataFrame:
    return pairs.filter("src = dst").select(F.col("src").alias("form")).distinct()


def marker_index(western: DataFrame, eastern: DataFrame, excluded: DataFrame) -> DataFrame:
    """form, side: forms of one side only, without the excluded ones."""
    both = western.select("form", F.lit("occ").alias("side")).unionByName(eastern.select("form", F.lit("or").alias("side"))).distinct()
    single = both.groupBy("form").agg(F.min("side").alias("side"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return single.join(excluded.select("form"), "form", "left_anti")


def homographs(readings: DataFrame) -> DataFrame:
    """form, resolvable, reading of readings(form, lemma, reading_category, category): resolvable by just one reading of the entry's category."""
    fits = F.when(F.col("reading_category") == F.col("category"), F.col("lemma"))
    g = readings.groupBy("form").agg(_only(fits).alias("reading"), (F.min("lemma") < F.max("lemma")).alias("several")).filter("several")
    return g.select("form", F.col("reading").isNotNull().alias("resolvable"), "reading")


def noun_only(pairs: DataFrame, form: str = "src", noun: str = "n") -> DataFrame:
    return pairs.groupBy(form).agg(F.every(F.col("category") == noun).alias("c")).filter("c").select(F.col(form).alias("form"))


def _first_seen(pairs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, values: the different values of each key in first-seen order."""
    first = pairs.groupBy(key, value).agg(F.min(order).alias("_o"))
    # sort_array() compares by compiled code, array_sort() by an expression for each comparison.
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("values"))


def ambiguity_points(pairs: DataFrame, key: str = "dst", value: str = "src", order: str = "seq") -> DataFrame:
    """key and candidates in first-seen order, where there are two or more.

    order: the column that says which comes first. The least of a number is kept
    in a hash table; for the least of a struct all rows are sorted.
    """
    return _first_seen(pairs, key, value, order).withColumnRenamed("values", "candidates").filter(F.size("candidates") > 1)


def candidate_forms(points: DataFrame) -> DataFrame:
    return points.select(F.explode("candidates").alias("form")).distinct()


def forms_of_ambiguous(pairs: DataFrame, key: str = "dst", value: str = "src") -> DataFrame:
    """form: values of keys that have two or more, as candidate_forms() of ambiguity_points(), by counts alone.

    A key with one value says nothing of it; a value counts unless such keys are all that it has. Nulls take no part.
    """
    p = pairs.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    keys = p.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))
    single = keys.filter("least = most").groupBy(F.col("least").alias("form")).agg(F.sum("n").alias("alone"))
    values = p.groupBy(F.col(value).alias("form")).agg(F.count("*").alias("n"))
    return values.join(single, "form", "left").filter(F.col("n") > F.coalesce("alone", F.lit(0))).select("form")


def flag_within_file(entries: DataFrame) -> DataFrame:
    """entries (source, form, partner) with ambiguous: several partners in one source."""
    n = entries.groupBy("source", "form").agg(F.coalesce(F.min("partner") < F.max("partner"), F.lit(False)).alias("ambiguous"))
    return entries.join(n, ["source", "form"]).select(*entries.columns, "ambiguous")


def merge_sources(entries: DataFrame, key: list[str]) -> DataFrame:
    """The entry of each key from the source of least priority, then of least seq."""
    first = entries.groupBy(*key).agg(F.min_by(F.struct(*[c for c in entries.columns if c not in key]), F.struct("priority", "seq")).alias("_e"))
    return first.select(*key, "_e.*").select(entries.columns)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with change: added or removed; repeated entries count."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def alternatives(pairs: DataFrame, key: str = "src", value: str = "dst", order: str = "seq") -> DataFrame:
    """All alternatives of each key, in first-seen order (order as for ambiguity_points)."""
    return _first_seen(pairs, key, value, order).withColumnRenamed("values", "alternatives")


def labelled(pairs: DataFrame, priority: DataFrame) -> DataFrame:
    """src, dst, label: of several labels that of least priority (priority: label, rank)."""
    return pairs.join(priority, "label").groupBy("src", "dst").agg(F.min_by("label", F.struct("rank", "label")).alias("label"))


def mood_pairs(pairs: DataFrame) -> DataFrame:
    """src and its two partners, which share a stem and end in -o and -i."""
    g = pairs.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("p")).filter(F.size("p") == 2)
    i, o = F.col("p")[0], F.col("p")[1]
    stem = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    return g.filter(i.endswith("i") & o.endswith("o") & (stem(i) == stem(o))).select("src", i.alias("in_i"), o.alias("in_o"))


def sense_groups(points: DataFrame, lemmas: DataFrame) -> DataFrame:
    """points with group: the lemma of the form if there is one, so that numbers share a group."""
    return points.join(lemmas, "form", "left").withColumn("group", F.coalesce("lemma", "form"))


def clean_words(words):
    """Without fragments of one or two small letters."""
    return F.filter(words, lambda w: ~((F.length(w) <= 2) & w.rlike(r"^\p{Ll}+$")))


def phrases_by_length(entries: DataFrame, phrase: str = "phrase") -> DataFrame:
    n = F.size(F.split(phrase, " "))
    return entries.select(phrase, n.alias("words")).filter("words >= 2").distinct()
