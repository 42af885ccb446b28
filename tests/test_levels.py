"""Models by levels: counts against counts by hand, and nothing of them is written out whole."""

from collections import Counter

from isogloss.operators import language_model as M
from pyspark.sql import DataFrame

TEXTS = ["a b a b c", "a", "", "b c", "a b a b c d"]


def test_counts(spark):
    s = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    want, before = Counter(), {}
    for t in TEXTS:
        w = ["<s>", *t.split(), "</s>"]
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                want[n, " ".join(w[i : i + n])] += 1
                if i:
                    before.setdefault((n, " ".join(w[i : i + n])), set()).add(w[i - 1])
    levels = M._levels(s, "text", 3)
    got = {(n, r.gram): r["count"] for n, df in levels.items() for r in df.filter("whole").collect()}
    assert got == dict(want)
    for n in (1, 2):
        assert all(r.before == len(before.get((n, r.gram), ())) for r in levels[n].filter("whole").collect())


def test_models_are_not_written(spark, monkeypatch):
    """Tables of grams were checkpointed three times, and each place of a text was shuffled to meet the ambiguous words."""
    monkeypatch.setattr(DataFrame, "checkpoint", lambda *a, **k: 1 / 0)
    s = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    points = spark.createDataFrame([("a", "a"), ("a", "d")], "form string, candidate string")
    got = M.scored_candidates(s.selectExpr("id", "split(text, ' ') AS w"), points, ["id"], M.kneser_ney(s, "text", 3), 3)
    assert got.count() == 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(form" not in plan
