"""N-grams of two texts, counted without what they begin and end with, and scores that shuffle nothing."""

import random
from collections import Counter

from isogloss.operators import evaluate as E


def test_matches():
    r = random.Random(3)
    for _ in range(3000):
        x, y = ("".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(2))
        if r.random() < 0.5:
            k = r.randint(0, len(x))
            y = x[:k] + r.choice(["", "a", "c"]) + x[min(len(x), k + r.randint(0, 2)) :]
        for a, b in ((x, y), (list(x), list(y))):
            for n in range(1, 7):
                h, q = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (x, y))
                assert E._matches(a, b, n) == ((h & q).total(), h.total(), q.total())


def test_nothing_is_shuffled(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b c e"), (2, "", "a"), (3, "a a", "a a"), (4, None, "b")], "id long, hyp string, ref string")
    got = E.bleu(df, "id", "hyp", "ref")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {x.id: round(x.bleu, 4) for x in got.collect()} == {1: 59.4604, 2: 0.0, 3: 100.0, 4: 0.0}
    both = E.chrf(df, "id", "hyp", "ref", {"chrf": 0, "plus": 2})
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    one, two = ({x.id: x.chrf for x in E.chrf(df, "id", "hyp", "ref", n).collect()} for n in (0, 2))
    assert {x.id: (x.chrf, x.plus) for x in both.collect()} == {k: (one[k], two[k]) for k in one}
