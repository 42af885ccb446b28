"""Alignment by content shuffles sentences once, to their document, and neither words nor pairs of sentences."""

import random

from isogloss.operators import pairs as R
from isogloss.plans import pairs


def by_hand(a, b, least=0.2):
    """Mutual best sentences of one document: (i, j, similarity)."""
    sets = lambda rows: {k: [i for i, t in rows if frozenset(t.split()) == k] for k in {frozenset(t.split()) for _, t in rows if t}}
    x, y = sets(a), sets(b)
    likeness = {(p, q): len(p & q) / len(p | q) for p in x for q in y if len(p & q) / len(p | q) >= least and not (p != q and p in y and q in x)}
    top = lambda k, s: max((v for pq, v in likeness.items() if pq[k] == s), default=0)
    found = [(i, j, v) for (p, q), v in likeness.items() if v == top(0, p) == top(1, q) for i, j in zip(x[p], y[q])]
    off = lambda i, j: abs(j - i * len(b) // len(a))
    return {(i, j, round(v, 6)) for i, j, v in found if (off(i, j), j) == min((off(i, q), q) for p, q, _ in found if p == i) and (off(i, j), i) == min((off(p, j), p) for p, q, _ in found if q == j)}


def test_as_by_hand(spark):
    r = random.Random(3)
    text = lambda: " ".join(r.choice("abcdefg") for _ in range(r.randrange(0, 5)))
    docs = {d: ([(i, text()) for i in range(r.randrange(1, 9))], [(i, text()) for i in range(r.randrange(1, 9))]) for d in range(60)}
    table = lambda k: spark.createDataFrame([(d, i, t) for d, sides in docs.items() for i, t in sides[k]] + [(None, 0, "a b")], "doc int, no int, text string")
    got = {}
    for row in R.align_by_content(table(0), table(1)).collect():
        got.setdefault(row.doc, set()).add((row.i, row.j, round(row.similarity, 6)))
    assert got == {d: want for d, (a, b) in docs.items() if (want := by_hand(a, b))}


def test_shuffles(spark, sf):
    """Words were shuffled to each other, and pairs of sentences to be counted; each use of a side made its sentences anew."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # documents are not dealt so already
    try:
        plan = pairs.content_alignment(spark, sf).select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert plan.count("Generate posexplode(split(text") == 2
    shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert not any(", w#" in line or "a#" in line and "b#" in line for line in shuffled)
