"""Differences are sought once for pairs and the rules that explain them."""

from isogloss.operators import pairs as R
from isogloss.plans import pairs
from pyspark.sql import functions as F


def test_one_pass(spark, sf):
    """Pairs and the rules that explain them each made the differences of the whole text."""
    plan = pairs.mined(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_spans_and_rules(spark):
    rows = [(1, "a nation of x".split(), "a nacio de x".split()), (2, "the x".split(), "le x".split()), (3, "the x the".split(), "le x le".split()), (4, [], ["y"]), (5, None, ["y"]), (6, "p q r s t u".split(), "v w x y z u".split())]
    d = R.diff_ops(spark.createDataFrame(rows, "id int, ta array<string>, tb array<string>"))
    assert {(r.id, tuple(o)) for r in d.collect() for o in r.ops or []} == {(1, ("replace", 1, 3, 1, 3)), (2, ("replace", 0, 1, 0, 1)), (3, ("replace", 0, 1, 0, 1)), (3, ("replace", 2, 3, 2, 3)), (4, ("insert", 0, 0, 0, 1)), (6, ("replace", 0, 5, 0, 5))}
    assert [r.ops for r in d.filter("id = 5").collect()] == [None]
    subs = R.substitutions(d)
    assert sorted((r.id, r["from"], r.to, r.isolated) for r in subs.collect()) == [(1, "nation of", "nacio de", True), (2, "the", "le", True), (3, "the", "le", False), (3, "the", "le", False)]
    known = spark.createDataFrame([("the", "le")], "src string, dst string")
    rules = F.broadcast(spark.createDataFrame([("e", "e", 3), ("the", "le", 4), ("the", "le", 2)], "cut string, put string, number int"))
    assert {(r["from"], r.n, r.isolated, r.rule, r.kind) for r in R.mined(subs, known, rules).collect()} == {("the", 3, 0.333333, 2, "known"), ("nation of", 1, 1.0, None, "new")}
