"""Features of most slots are summed where the slots are."""

import math

from isogloss.operators import language_model as M

ROWS = [(k, "g" if k % 3 else "h", k % 2, ["all", f"x{k % 5}", "all" if k % 4 else "some"]) for k in range(60)]


def test_odds(spark, monkeypatch):
    """With all, some, and none of the features sent to the slots."""
    slots = spark.createDataFrame(ROWS, "id long, `group` string, cls int, features array<string>")
    model = M.bayes_train(slots)
    by = {(r.group, r.feature): r for r in model.collect()}
    p = lambda n, t, v: (n + 0.5) / (t + 0.5 * v)
    odd = lambda r: math.log(p(r.n0, r.t0, r.v)) - math.log(p(r.n1, r.t1, r.v))
    want = {i: round(sum(odd(by[g, x]) for x in f if (g, x) in by), 6) for i, g, _, f in ROWS}
    for common in (10_000, 3, 1):
        monkeypatch.setattr(M, "COMMON", common)
        got = {r.id: r.logodds for r in M.bayes_logodds(slots, ["id"], model).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def test_frequent_features_are_not_shuffled(spark):
    """Every feature of every slot was shuffled to the model, those of most slots to one task."""
    slots = spark.createDataFrame(ROWS, "id long, `group` string, cls int, features array<string>")
    plan = M.bayes_logodds(slots, ["id"], M.bayes_train(slots))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
