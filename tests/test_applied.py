"""Choices put into texts: what goes through the shuffle."""

import re

from isogloss.operators import language_model as M


def test_texts_are_shuffled_as_texts_and_kept_words_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "the cat of the"), (2, ""), (3, "of"), (None, "the")], "id long, text string")
    choices = spark.createDataFrame([(1, 0, "thee", "the"), (1, 2, "of", "of"), (1, 3, "the", "the"), (3, 0, "off", "of"), (9, 0, "off", "of")], "id long, i int, chosen string, default string")
    want = {(1, "thee cat of the"), (2, ""), (3, "off"), (None, "the")}
    assert {tuple(r) for r in M.applied(texts, "id", choices).collect()} == want
    assert {tuple(r) for r in M.applied(texts, "id", choices.drop("default")).collect()} == want
    plan = M.applied(texts, "id", choices)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"NOT \(chosen#\d+ <=> default#\d+\)", plan)  # what changes nothing is left out before the join
