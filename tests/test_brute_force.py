"""Queries without SQL against plain Python, over whole tables."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import pytest
from isogloss.functions import segment
from isogloss.plans import evaluation, index, pairs, registry

registry.load()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def systems(spark, sf):
    return evaluation.scored(spark, sf).select("id", "hypothesis", "reference").collect()


def words(text):
    return re.findall(r"[^\W\d_]+(?:[·-][^\W\d_]+)*", text.lower())


def test_longest_hits(spark, sf, documents):
    phrases = {tuple(p.split()): (p, side) for p, side in index.PHRASES}
    exp = Counter()
    for d, text in documents:
        t, i = words(text), 0
        while i < len(t):
            n = next((n for n in (3, 2, 1) if tuple(t[i : i + n]) in phrases), 0)
            if n:
                exp[d, *phrases[tuple(t[i : i + n])]] += 1
            i += n or 1
    got = {(r.doc_id, r.phrase, r.side): r.n for r in registry.QUERIES["jon_03_longest_hits"](spark, sf).collect()}
    assert got == exp


def test_rejoined_sentences(spark, sf, documents):
    exp = {}
    for d, text in documents:
        lines = [x.strip(" ") for x in text.split("\n")]
        for k, line in enumerate(x for x in lines if x):
            out = []
            for part in (x.strip(" ") for x in re.split(segment.QUOTE_BREAK, line, flags=re.ASCII)):
                if not part:
                    continue
                m = re.search(r"([A-Za-zÀ-ÿ]+)\.?$", out[-1]) if out else None
                word = m[1].lower() if m else ""
                if out and (word in segment.ABBREVIATIONS or len(word) <= 1 and out[-1].endswith(".")):
                    out[-1] += " " + part
                else:
                    out.append(part)
            exp |= {(d, k, i): x for i, x in enumerate(out)}
    got = {(r.doc_id, r.par_no, r.sent_no): r.text for r in registry.QUERIES["seg_03_rejoined_sentences"](spark, sf).collect()}
    assert got == exp


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_edits(spark, sf, systems):
    exp = {r.id: (distance(r.hypothesis.split(), r.reference.split()), len(r.reference.split())) for r in systems if len(r.reference) < 2000}
    got = {r.id: (r.edits, r.ref_words) for r in registry.QUERIES["met_02_word_edits"](spark, sf).collect()}
    assert set(got) == {r.id for r in systems} and all(got[i] == x for i, x in exp.items())


def test_word_edits_of_many_words(spark):
    from isogloss.operators import evaluate as E
    from pyspark.sql import functions as F

    many = " ".join(f"w{i}" for i in range(1500))
    got = spark.createDataFrame([("x y", "y x"), (many, ""), ("", many), ("a b c", "a c")], "a string, b string").select(E.word_edits(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [2, 1500, 1500, 1]


def test_bleu_and_chrf(spark, sf, systems):
    def bleu(h, r):
        h, r, logs, zeros = h.lower().split(), r.lower().split(), [], 0
        for n in range(1, 5):
            x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (h, r))
            if x:
                both = (x & y).total()
                zeros += not both
                logs.append(math.log(both / x.total() if both else 1 / (2**zeros * x.total())))
        return 100 * math.exp(sum(logs) / len(logs) + min(0, 1 - len(r) / len(h))) if logs else 0.0

    def chrf(h, r, orders):
        f = []
        for x, y, most in orders:
            for n in range(1, most + 1):
                a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (x, y))
                if a or b:
                    m = (a & b).total()
                    p, c = m / a.total() if a else 0, m / b.total() if b else 0
                    f.append(5 * p * c / (4 * p + c) if p + c else 0)
        return 100 * sum(f) / len(f) if f else 0.0

    got = {r.id: r.bleu for r in registry.QUERIES["met_03_bleu"](spark, sf).collect()}
    two = {r.id: (r.chrf, r.chrf_pp) for r in registry.QUERIES["met_04_chrf"](spark, sf).collect()}
    assert set(got) == set(two) == {r.id for r in systems}
    for r in systems:
        assert abs(got[r.id] - bleu(r.hypothesis, r.reference)) < 1e-5
    for r in systems[::7]:
        chars = ("".join(r.hypothesis.split()), "".join(r.reference.split()), 6)
        assert abs(two[r.id][0] - chrf(r.hypothesis, r.reference, [chars])) < 1e-5
        assert abs(two[r.id][1] - chrf(r.hypothesis, r.reference, [chars, (r.hypothesis.split(), r.reference.split(), 2)])) < 1e-5


def test_diff_ops(spark, sf):
    """The operations turn one side into the other, and the ratio counts what they leave."""
    sides = {r.id: (r.ta, r.tb) for r in pairs.tokens(spark, sf).collect()}
    got = registry.QUERIES["dif_01_diff_ops"](spark, sf).collect()
    assert {r.id for r in got} == set(sides)
    for r in got:
        a, b = sides[r.id]
        ops, out, at = json.loads(r.ops), [], 0
        for o in ops:
            assert o["i1"] >= at and a[o["i1"] : o["i2"]] != b[o["j1"] : o["j2"]]
            out += a[at : o["i1"]] + b[o["j1"] : o["j2"]]
            at = o["i2"]
        assert out + a[at:] == b and len(ops) == r.n_ops
        same = len(a) - sum(o["i2"] - o["i1"] for o in ops)
        assert abs(r.ratio - (2 * same / (len(a) + len(b)) if a or b else 1)) < 1e-6


def test_mined(spark, sf):
    n, kinds = Counter(), {}
    for r in pairs.edited(spark, sf).collect():
        runs, i = [], 0
        while i < len(r.ta):
            j = i
            while j < len(r.ta) and r.ta[j] != r.tb[j]:
                j += 1
            if 0 < j - i <= 4:
                runs.append((" ".join(r.ta[i:j]), " ".join(r.tb[i:j])))
            i = max(j, i + 1)
        n.update(runs)
    got = {(r["from"], r["to"]): (r.n, r.kind) for r in registry.QUERIES["dif_03_mined"](spark, sf).collect()}
    for a, b in n:
        stem = next((a[: -len(c)] == b[: -len(p)] for c, p in (("tion", "cio"), ("ion", "io")) if a.endswith(c) and b.endswith(p)), False)
        kinds[a, b] = "known" if (a, b) == ("the", "le") else "rule" if stem else "new"
    assert got == {k: (n[k], kinds[k]) for k in n}


def test_kneser_ney_sums_to_one(spark):
    """After any history the words that can follow, one unknown among them, have a probability of one."""
    from isogloss.operators import language_model as M

    rows = [(i, t) for i, t in enumerate(["a b c", "a b d", "a b", "c a b c", "d d d", "b c a b", "a", "c d a b c d", "b a", "a b c d"] * 3)]
    s = spark.createDataFrame(rows, "id long, text string")
    model = M.kneser_ney(s, "text", 3)
    words = ["a", "b", "c", "d", "</s>", "unknown"]
    for history in (["<s>"], ["<s>", "a"], ["a", "b"], ["d", "q"], ["q", "q"]):
        at = spark.createDataFrame([(w, [*history, w], len(history) + 1, len(history) + 1) for w in words], "word string, w array<string>, lo int, hi int")
        p = {r.word: math.exp(r.logprob) for r in M.scored_places(at, ["word"], model, 3).collect()}
        assert abs(sum(p.values()) - 1) < 1e-4 and p["unknown"] < min(p[w] for w in "abcd")
    local = M.scored_candidates(spark.createDataFrame([(1, ["c", "a", "b", "d", "a"])], "id long, w array<string>"), spark.createDataFrame([("a", "a"), ("a", "d")], "form string, candidate string"), ["id"], model, 3)
    gap = {(r.i, r.candidate): r.logprob for r in local.collect()}
    whole = {r.id: r.logprob for r in M.scored_sentences(spark.createDataFrame([(1, "c a b d a"), (2, "c d b d a"), (3, "c a b d d")], "id long, text string"), ["id"], "text", model, 3).collect()}
    assert abs(gap[1, "a"] - gap[1, "d"] - (whole[1] - whole[2])) < 1e-5 and abs(gap[4, "a"] - gap[4, "d"] - (whole[1] - whole[3])) < 1e-5
