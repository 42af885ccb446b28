"""Agreement over paths inside a text's array: as over token tables, and without shuffles of tokens."""

import random

from isogloss.operators import agreement as A
from isogloss.operators import rewrite as W
from isogloss.plans import rewriting
from pyspark.sql import functions as F

WORD = "i int, translated string, rule string, gender string, head int, dep string, agrees boolean, participle boolean, lemma string, relative boolean"


def parses(seed, n):
    r = random.Random(seed)
    for key in range(n):
        size = r.randrange(0, 12)
        yield key, [
            (i, r.choice(["blanca", "blanc", "Alta", "alt", "x"]), r.choice([None, "lexicon"]), r.choice(["f", "m", None]), r.choice([None, r.randrange(size), r.randrange(size), size + 2]), r.choice([*A.UP, *A.SUBJECT, *A.COMPLEMENT, "aux", "case", None]),
             r.random() < 0.7, r.random() < 0.4, r.choice(["haver", "ser", "x", None]), r.choice([True, False, False, None]))
            for i in range(size)
        ]


def test_as_over_token_tables(spark):
    texts = spark.createDataFrame([*parses(7, 400), (None, [])], f"k int, t array<struct<{WORD.replace(' ', ':').replace(',:', ',')}>>")
    m = spark.createDataFrame([(f, lemma, "adj", g, "sg") for f, lemma, g in [("blanca", "b", "f"), ("blanc", "b", "m"), ("alta", "a", "f"), ("alt", "a", "m")]], "form string, lemma string, cat string, gender string, number string")
    tokens = texts.select("k", F.inline("t"))
    want = {(r.k, r.i): r.controller for r in A.controllers(tokens, "k").collect()}
    got = {(r.k, i): (c if c >= 0 else None) for r in texts.filter("k IS NOT NULL").select("k", A.text_controllers(F.col("t")).alias("c")).collect() for i, c in enumerate(r.c)}
    assert got == want and sum(c is not None for c in got.values()) > 50
    changed = A.path_agreed(tokens.withColumn("old", F.col("translated")), "k", m).filter("translated <> old")
    assert {(r.k, r.i, r.put) for r in A.path_changes(texts, "k", m).collect()} == {(r.k, r.i, r.translated) for r in changed.collect()}


def test_a_long_chain_and_a_circle(spark):
    size = 3000
    chain = [(i, "alt", "lexicon" if i == 0 else None, "f", i - 1 if i else None, "conj", i > 0, False, "x", False) for i in range(size)]
    circle = [(i, "alt", None, "f", (i + 1) % 4, "conj", True, False, "x", False) for i in range(4)]
    texts = spark.createDataFrame([(0, chain), (1, circle)], f"k int, t array<struct<{WORD.replace(' ', ':').replace(',:', ',')}>>")
    got = {r.k: r.c for r in texts.select("k", A.text_controllers(F.col("t")).alias("c")).collect()}
    assert got[0] == [-1] + [0] * (size - 1) and got[1] == [-1] * 4


def test_words_stay_in_their_text(spark, sf):
    """All tokens were shuffled to meet the words beside them, and in each round their heads."""
    df = rewriting.controlled(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "checkpoint" not in plan


def test_entries_as_by_lookup(spark):
    words = ["The", "THE", "d'of", "D’Of", "x", "of", "l'x", "T'THE"]
    entries = [("the", "le"), ("of", "de")]
    t = spark.createDataFrame([(w,) for w in words], "surface string")
    want = {r.surface: r.put for r in W.by_lookup(t, spark.createDataFrame(entries, "form string, put string"), "put", small=True).collect()}
    assert {r.surface: r.put for r in t.select("surface", W.entry_put(F.col("surface"), entries).alias("put")).collect()} == want
