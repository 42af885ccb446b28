"""Decisions on ambiguous words, sweeps of their margins, and scores of several models."""

from __future__ import annotations

import random

import pytest

from isogloss.operators import language_model as M
from isogloss.operators.lineage import running_sums

SLOT = "id int, i int, type string, form string, engine string, reading string, sense string"
CANDIDATE = "id int, i int, candidate string, logprob double, words int, prior double"


def decide(spark, slot, scores, criteria):
    s = spark.createDataFrame([(1, 0, *slot)], SLOT)
    c = spark.createDataFrame([(1, 0, *x) for x in scores], CANDIDATE)
    (row,) = M.cascade(s, c, ["id", "i"], criteria).collect()
    return row.chosen, row.decided


@pytest.mark.parametrize(
    "slot, scores, criteria, want",
    [
        # The prior turns the choice, and a mean score is by words.
        (("collision", "hit", None, None, None), [("blow", -30.0, 9, -35.0), ("time", -25.0, 9, -20.0)], M.Criteria(), ("time", "model")),
        (("collision", "hit", None, None, None), [("blow", -30.0, 9, -35.0), ("time", -25.0, 9, -20.0)], M.Criteria(lam=1.0), ("blow", "model")),
        (("collision", "hit", None, None, None), [("blow", -30.0, 9, -35.0), ("time", -25.0, 9, -20.0)], M.Criteria(lams={"collision": 1.0}), ("blow", "model")),
        (("collision", "hit", None, None, None), [("blow", -30.0, 20, 0.0), ("time", -25.0, 9, 0.0)], M.Criteria(mean=True), ("blow", "model")),
        # The classifier decides a narrow lead only, and only for a candidate.
        (("collision", "hit", None, None, "blow"), [("blow", -30.0, 9, 0.0), ("time", -25.0, 9, 0.0)], M.Criteria(tie=2.0), ("time", "model")),
        (("collision", "hit", None, None, "blow"), [("blow", -30.0, 9, 0.0), ("time", -25.0, 9, 0.0)], M.Criteria(tie=6.0), ("blow", "classifier")),
        (("collision", "hit", None, None, "other"), [("blow", -30.0, 9, 0.0), ("time", -25.0, 9, 0.0)], M.Criteria(tie=6.0), ("time", "model")),
        (("collision", "hit", None, None, None), [("blow", -30.0, 9, 0.0), ("time", -25.0, 9, 0.0)], M.Criteria(tie=6.0), ("time", "model")),
        # The engine's candidate gives way to a lead over the margin.
        (("other", "tights", "pants", None, None), [("pants", -30.0, 9, 0.0), ("tights", -28.0, 9, 0.0)], M.Criteria(), ("tights", "model")),
        (("other", "tights", "pants", None, None), [("pants", -30.0, 9, 0.0), ("tights", -28.0, 9, 0.0)], M.Criteria(margin=5.0), ("pants", "engine")),
        (("other", "tights", "pants", None, None), [("pants", -30.0, 9, 0.0), ("tights", -28.0, 9, 0.0)], M.Criteria(margin=2.0), ("pants", "engine")),
        # The word of the source may be the default instead.
        (("other", "Tights", "pants", None, None), [("pants", -26.0, 9, 0.0), ("tights", -28.0, 9, 0.0)], M.Criteria(default="source", margin=1.0), ("pants", "model")),
        (("other", "Tights", "pants", None, None), [("pants", -26.0, 9, 0.0), ("tights", -28.0, 9, 0.0)], M.Criteria(default="source", margin=5.0), ("tights", "source")),
        (("other", "gone", "pants", None, None), [("pants", -26.0, 9, 0.0), ("tights", -25.0, 9, 0.0)], M.Criteria(default="source", margin=5.0), ("pants", "engine")),
        # Of narrow leads the classifier's goes before the margin's.
        (("other", "washer", "cleaner", None, "cleaner"), [("cleaner", -20.0, 6, -10.0), ("washer", -20.5, 6, -10.0)], M.Criteria(lam=1.5, tie=2.0, margin=3.0, default="source"), ("cleaner", "classifier")),
        (("other", "washer", "cleaner", None, None), [("cleaner", -20.0, 6, -10.0), ("washer", -20.5, 6, -10.0)], M.Criteria(lam=1.5, tie=2.0, margin=3.0, default="source"), ("washer", "source")),
        # The part of speech goes first, where the type has it.
        (("other", "lazy", "chair", "lazy", "chair"), [("chair", -1.0, 9, 0.0), ("lazy", -50.0, 9, 0.0)], M.Criteria(veto=("other",)), ("lazy", "pos")),
        (("other", "lazy", "chair", "lazy", None), [("chair", -1.0, 9, 0.0), ("lazy", -50.0, 9, 0.0)], M.Criteria(), ("chair", "model")),
        # Without the model for a type, and without candidates, the engine decides.
        (("other", "lazy", "chair", None, "lazy"), [("chair", -50.0, 9, 0.0), ("lazy", -1.0, 9, 0.0)], M.Criteria(model=("collision",), tie=99.0), ("chair", "engine")),
        (("other", "lazy", "chair", None, "lazy"), [], M.Criteria(tie=99.0), ("chair", "engine")),
    ],
)
def test_cascade(spark, slot, scores, criteria, want):
    assert decide(spark, slot, scores, criteria) == want


def test_margin_sweep_is_exhaustive(spark):
    r = random.Random(6)
    rows, want = [], {}
    for i in range(150):
        words = r.sample(["a", "b", "c"], r.randrange(2, 4))
        kind, right = r.choice(["x", "y"]), r.choice(words)
        rows += [(i, kind, w, r.randrange(-9, 0) / 2, r.randrange(-6, 0) / 2, k == 0, right) for k, w in enumerate(words)]
    settings = {"none": {}, "both": {"x": 0.5, "y": 1.0}, "one": {"y": 2.0}}
    for name, lams in settings.items():
        leads = []
        for i in range(150):
            c = [(lp - lams.get(kind, 0.0) * p, w, d, right) for j, kind, w, lp, p, d, right in rows if j == i]
            top = max(s for s, *_ in c)
            best = min(w for s, w, *_ in c if s == top)
            (base, default, _, right), *_ = [x for x in c if x[2]]
            leads.append((top - base, best, default, right))
        for margin in {0.0, *(x[0] for x in leads)}:
            taken = [(best if lead > margin else default, default, right) for lead, best, default, right in leads]
            want[name, margin] = sum(t == w for t, _, w in taken), sum(t != w and t != d for t, d, w in taken)
    df = spark.createDataFrame(rows, "id int, type string, candidate string, logprob double, prior double, is_default boolean, expected string")
    sweep = M.margin_sweep(df, ["id"], settings)
    assert {(x.setting, x.margin): (x.hits, x.serious) for x in sweep.collect()} == want
    best = {x.setting: (x.margin, x.hits, x.serious) for x in M.best_margins(sweep, 20).collect()}
    for name in settings:
        fine = [(-h, s, m) for (n, m), (h, s) in want.items() if n == name and s <= 20]
        assert best.get(name) == ((min(fine)[2], -min(fine)[0], min(fine)[1]) if fine else None)


def test_running_sums_over_slices(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randrange(50), r.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, v int").groupBy("g", "k").sum("v").withColumnRenamed("sum(v)", "v")
    got = running_sums(df.repartition(7), ["g"], [df["k"].desc()], {"s": df["v"]}).collect()
    assert len(got) == df.count() and all(x.s == sum(v for g, k, v in rows if g == x.g and k >= x.k) for x in got)


def test_backward_model_sees_what_follows(spark):
    """Two words that only what stands after them tells apart."""
    texts = ["x p y", "x p y", "x q z", "x q z", "x p y", "x q z"]
    s = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    tokens = spark.createDataFrame([(9, ["x", "p", "z"])], "id int, w array<string>")
    points = spark.createDataFrame([("p", "p"), ("p", "q")], "form string, candidate string")
    forward = M.scored_candidates(tokens, points, ["id"], M.kneser_ney(s, "text", 2), 2)
    back = M.kneser_ney(s.select("id", M.reversed_words(s["text"]).alias("text")), "text", 2)
    backward = M.scored_candidates(tokens.selectExpr("id", "reverse(w) AS w"), points, ["id"], back, 2)
    scores = M.combined_scores({"f": forward, "b": backward}, ["id", "candidate"], {"both": {"f": 0.5, "b": 0.5}, "gap": {"f": 1.0, "b": -1.0}})
    by = {r.candidate: r for r in scores.collect()}
    assert by["q"].b > by["p"].b and by["q"].both > by["p"].both
    assert by["p"].gap == pytest.approx(by["p"].f - by["p"].b)
