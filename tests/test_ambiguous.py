"""Forms of ambiguous keys by counts, against lists of candidates; collocations of a few markers."""

import random

from isogloss.operators import lexicon as L
from isogloss.operators import markers as M
from isogloss.plans import registry
from pyspark.sql import functions as F

registry.load()


def test_forms(spark, sf):
    r = random.Random(4)
    rows = [(f"s{r.randint(0, 60)}", f"d{r.randint(0, 90)}", k) for k in range(150)]
    pairs = spark.createDataFrame(rows, "src string, dst string, seq long")
    want = {x.form for x in L.candidate_forms(L.ambiguity_points(pairs)).collect()}
    got = [x.form for x in L.forms_of_ambiguous(pairs).collect()]
    assert sorted(got) == sorted(want) and len({x[0] for x in rows}) > len(want) > 5
    # No list of all that stands beside a word is made.
    assert "collect_list" not in registry.QUERIES["lex_14_candidate_forms"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_collocations(spark):
    texts = spark.createDataFrame([(1, "a b the c")], "id long, text string").repartition(2)
    markers = F.broadcast(spark.createDataFrame([("the",), ("the",)], "form string"))
    out = M.collocations(texts, markers, F.broadcast(spark.createDataFrame([("b",)], "word string")))
    assert sorted(map(tuple, out.select("marker", "word", "n").collect())) == [("the", "a", 1), ("the", "c", 1)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "hashpartitioning(form" not in out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
