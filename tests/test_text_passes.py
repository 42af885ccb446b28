"""Decisions read the text twice: for the model's longest grams, and for the places of ambiguous words."""

from isogloss.operators import language_model as M
from isogloss.plans import models
from pyspark.sql import functions as F


def plan(df):
    s = df.sparkSession
    s.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        s.conf.unset("spark.sql.adaptive.enabled")


def test_two_passes(spark, sf):
    """Asked grams and counts of candidates were made of the text by passes of their own."""
    assert plan(models.scored_candidates(spark, sf)).count("Generate posexplode(split(text") == 2


def test_joins_leave_places_alone(spark, sf):
    """Filters for keys that aren't null went below the sums, and places that were asked differed from those answered."""
    assert plan(models.combined(spark, sf)).count("Generate posexplode(split(text") == 6


def test_counts_are_those_of_words(spark):
    s = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "b")], "id int, text string").withColumn("m", F.lit("x"))
    for order in (1, 2, 3):
        assert {r.gram: r["count"] for r in M.word_counts(s, "text", order, "m").collect()} == {"<s>": 3, "</s>": 3, "a": 2, "b": 2}


def test_places_without_a_candidate_are_left(spark):
    t = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, []), (3, ["c"])], "id int, w array<string>")
    s = spark.createDataFrame([(1, "a b a"), (2, "b c")], "id int, text string")
    points = F.broadcast(spark.createDataFrame([("a", "a"), ("a", "c")], "form string, candidate string"))
    got = M.scored_candidates(t, points, ["id"], M.kneser_ney(s, "text", 3), 3).collect()
    assert sorted((r.id, r.i, r.candidate, r.words) for r in got) == [(1, 0, "a", 3), (1, 0, "c", 3), (1, 2, "a", 3), (1, 2, "c", 3)]
