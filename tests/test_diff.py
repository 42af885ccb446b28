"""Differences by common blocks against the standard library's."""

from __future__ import annotations

import difflib
import random

import numpy as np

from isogloss.operators import pairs as R


def want(a, b):
    return [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]


def test_blocks_are_the_longest_first(spark):
    r = random.Random(7)
    rows = [([r.choice("abcde"[: r.randrange(1, 6)]) for _ in range(r.randrange(0, 14))], [r.choice("abcdef") for _ in range(r.randrange(0, 14))]) for _ in range(600)]
    rows += [("of de x".split(), "de of x".split()), ([], []), (list("abc"), list("abc")), (list("abc"), list("xyz")), ([], ["a"]), (["a"], []), (["é"] * 300, ["é"] * 299 + ["x"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id int, ta array<string>, tb array<string>")
    for x in R.diff_ops(df).collect():
        ops = [tuple(o) for o in x.ops]
        assert ops == want(*rows[x.id]), rows[x.id]
        assert round(x.ratio, 9) == round(difflib.SequenceMatcher(None, *rows[x.id], autojunk=False).ratio(), 9)


def test_a_missing_side_has_no_difference(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, ["a"], None), (3, ["a", "b"], ["b", "c"])], "id int, ta array<string>, tb array<string>")
    got = {r.id: (r.ops, r.ratio) for r in R.diff_ops(df).collect()}
    assert got[1] == got[2] == (None, None) and [tuple(o) for o in got[3][0]] == want(["a", "b"], ["b", "c"])


def test_common_blocks():
    assert R.common_blocks(np.array([1, 2, 3, 4]), np.array([9, 2, 3, 1])) == [(1, 1, 2)]
    assert R.common_blocks(np.zeros(0, int), np.array([1])) == []


