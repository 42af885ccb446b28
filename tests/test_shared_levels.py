"""Models, and scores of the sentences they are made of, cut the grams out of a text once and share the shuffles of all levels."""

import re

from pyspark.sql import functions as F

from isogloss.operators import language_model as M


def cuts(df):
    """Times that grams are cut out of the text in the plan that runs."""
    s = df.sparkSession
    s.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        s.conf.unset("spark.sql.adaptive.enabled")
    return len(re.findall(r"Generate explode\(transform\(", plan))


def text(spark):
    return spark.createDataFrame([(1, "a b c a b"), (2, "b a"), (3, "")], "id long, text string").withColumn("m", F.lit("x")).repartition(2, "id")


def test_kneser_ney(spark):
    s = text(spark)
    # The levels, and the places that are joined with what they score.
    assert cuts(M.scored_sentences(s, ["id"], "text", M.kneser_ney(s, "text", 3, ("m",)), 3, ("m",))) == 2


def test_backoff(spark):
    s = text(spark)
    assert cuts(M.log_probability(s, "id", "text", M.ngram_counts(s, "text", 3, "m"), 3, by=("m",))) == 2
