"""Tables of a few rows go to all tasks, whatever Spark knows of their size; sets of words go by a number."""

from isogloss.plans import registry

registry.load()


def plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_tokens_stay(spark, sf):
    for name in ("agg_03_corpus_index", "agg_01_text_index", "rwt_01_lexicon", "rwt_17_glossary", "lmd_08_detected"):
        p = plan(spark, registry.QUERIES[name](spark, sf))
        assert "hashpartitioning(form" not in p and "SortMergeJoin" not in p, name


def test_phenomena(spark, sf):
    """All n-grams of the target were shuffled, twice."""
    p = plan(spark, registry.QUERIES["jon_16_phenomena"](spark, sf))
    assert p.count("BroadcastHashJoin [gram") >= 2


def test_content_alignment(spark, sf):
    """Each word of a sentence carried all of its words."""
    p = plan(spark, registry.QUERIES["jon_06_content_alignment"](spark, sf))
    assert "hashpartitioning(doc" in p and "hashpartitioning(doc#0L, sa" not in p and ", sa#" not in p
