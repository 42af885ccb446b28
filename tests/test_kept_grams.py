"""Of the longest grams only those that are kept are shuffled again, and of words only candidates."""

import pytest
from isogloss.operators import language_model as M
from isogloss.plans import models
from pyspark.sql import functions as F

TEXTS = ["a b a b c", "a", "", "b c", "a b a b c d", "a b a b c"]


def plan(df):
    s = df.sparkSession
    s.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        s.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_histories(spark, order):
    """Sums and weights after each history, by the grams themselves."""
    s = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("m", F.lit("x"))
    model = M.kneser_ney(s, "text", order, ("m",))
    marked = [["<s>", *t.split(), "</s>"] for t in TEXTS]
    followed, kept = {}, set()
    grams = [tuple(w[i : i + order]) for w in marked for i in range(len(w) - order + 1)]
    for g in grams:
        if order > 1 or g != ("<s>",):
            followed[" ".join(g[:-1])] = followed.get(" ".join(g[:-1]), 0) + 1
            if order == 1 or grams.count(g) > 1:
                kept.add(g)
    got = {r.hist: r for r in model[order][1].collect()}
    assert {h: r.s for h, r in got.items()} == followed
    left = {}
    for r in model[order][0].collect():
        h = " ".join(r.gram.split(" ")[:-1])
        left[h] = left.get(h, 0) + r.c
    assert all(r.gamma == pytest.approx(1 - left.get(h, 0) / r.s) for h, r in got.items())


def test_longest_grams_meet_no_history_whole(spark):
    """Sums over all of the longest grams were shuffled by history."""
    s = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("m", F.lit("x"))
    assert "partial_sum(c#" not in plan(M.kneser_ney(s, "text", 3, ("m",))[3][1])


def test_priors_count_candidates_only(spark, sf):
    """All words were counted by word and then met the candidates, by a semi-join that no other step has."""
    assert "LeftSemi" not in plan(models.scored_candidates(spark, sf))
