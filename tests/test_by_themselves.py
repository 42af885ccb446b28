"""Sentences scored by the model of themselves: the same as by a model's tables, with one shuffle of places."""

import random

import pytest

from isogloss.operators import language_model as M
from isogloss.plans import models


@pytest.mark.parametrize("order", [3, 5])
def test_as_by_tables_of_a_model(spark, order):
    r = random.Random(order)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 9))) for _ in range(150)]
    s = spark.createDataFrame([(k, k % 3, t) for k, t in enumerate(texts + texts[:20])], "id long, lang int, text string")
    for by in ((), ("lang",)):
        want = M.scored_sentences(s, ["id"], "text", M.kneser_ney(s, "text", order, by), order, by)
        got = M.scored_by_themselves(s, ["id"], "text", order, by)
        key = lambda df: {r.id: (r.words, r.logprob) for r in df.collect()}
        a, b = key(want), key(got)
        assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 2e-6 for k in a)


def test_places_are_shuffled_once(spark, sf):
    # Down to where places are dealt, only sums of sentences are shuffled.
    plan = models.kneser_ney(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("REPARTITION_BY_COL")[0].count("Exchange hashpartitioning") == 2
