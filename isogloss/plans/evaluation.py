"""Queries of evaluation: sentences stand for inputs, edited sentences for hypotheses and references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import evaluate as E
from .pairs import _ED, edited
from .registry import query


def rows(spark, sf_dir):
    """id, input, hypothesis (articles changed only; none for some), reference."""
    e = edited(spark, sf_dir)
    hyp = F.array_join(F.transform("ta", lambda w: F.when(w == "the", "le").otherwise(w)), " ")
    return e.select("id", F.array_join("ta", " ").alias("input"), F.when(F.col("id") % 11 != 0, hyp).alias("hypothesis"), F.array_join("tb", " ").alias("reference"))


def scored(spark, sf_dir):
    r = rows(spark, sf_dir)
    return E.evaluated(r.select("id", "input", "reference"), r.select("id", "hypothesis"))


_RW = f"""{_ED}, rw AS (SELECT id, doc_id, ta, tb, id % 11 = 0 AS failed, CASE WHEN id % 11 = 0 THEN ta ELSE [CASE WHEN w = 'the' THEN 'le' ELSE w END FOR w IN ta] END AS h FROM ed),
ev AS (SELECT id, doc_id, failed, array_to_string(h, ' ') = array_to_string(tb, ' ') AS exact, len([1 FOR i IN range(1, len(h) + 1) IF h[i] <> tb[i]]) AS edits, len(tb) AS ref_words FROM rw)"""


@query("met_01_exact", f"WITH {_RW} SELECT id, exact FROM ev")
def exact(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "exact")


# No word that a reference has changed is left in any reference, so places that differ are all there is to edit.
@query("met_02_word_edits", f"WITH {_RW} SELECT id, edits, ref_words FROM ev")
def word_edits(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "edits", "ref_words")


@query(
    "met_03_bleu",
    f"""WITH {_RW}, gr AS (SELECT id, n, unnest([array_to_string(h[i:i + n - 1], ' ') FOR i IN range(1, len(h) - n + 2)]) AS g, 1 AS hyp FROM rw, (SELECT unnest([1, 2, 3, 4]) AS n) UNION ALL SELECT id, n, unnest([array_to_string(tb[i:i + n - 1], ' ') FOR i IN range(1, len(tb) - n + 2)]), 0 FROM rw, (SELECT unnest([1, 2, 3, 4]) AS n)),
ct AS (SELECT id, n, g, sum(hyp) AS h, sum(1 - hyp) AS r FROM gr GROUP BY id, n, g), od AS (SELECT id, n, sum(least(h, r)) AS m, sum(h) AS hyp, sum(r) AS ref FROM ct GROUP BY id, n HAVING sum(h) > 0),
lp AS (SELECT *, ln(CASE WHEN m > 0 THEN m / hyp ELSE 1 / (2 ** (sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n)) * hyp) END) AS l FROM od)
SELECT id, round(100 * CASE WHEN max(hyp) < max(ref) THEN exp(1 - max(ref) / max(hyp)) ELSE 1 END * exp(avg(l)), 6) AS bleu FROM lp GROUP BY id""",
)
def bleu(spark, sf_dir):
    return E.bleu(scored(spark, sf_dir), "id", "hypothesis", "reference").withColumn("bleu", F.round("bleu", 6))


@query(
    "met_04_chrf",
    f"""WITH {_RW}, sd AS (SELECT id, 1 AS hyp, array_to_string(h, '') AS c, h AS w FROM rw WHERE h <> tb UNION ALL SELECT id, 0, array_to_string(tb, ''), tb FROM rw WHERE h <> tb),
gr AS (SELECT id, n, hyp, unnest([substr(c, i, n) FOR i IN range(1, length(c) - n + 2)]) AS g FROM sd, (SELECT unnest(range(1, 7)) AS n) UNION ALL SELECT id, 6 + n, hyp, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) FROM sd, (SELECT unnest([1, 2]) AS n)),
ct AS (SELECT id, n, g, sum(hyp) AS h, sum(1 - hyp) AS r FROM gr GROUP BY id, n, g), od AS (SELECT id, n, sum(least(h, r)) AS m, sum(h) AS nh, sum(r) AS nr FROM ct GROUP BY id, n),
fs AS (SELECT id, n, CASE WHEN m > 0 THEN 5 * (m / nh) * (m / nr) / (4 * (m / nh) + m / nr) ELSE 0.0 END AS f FROM od), sc AS (SELECT id, 100 * avg(f) FILTER (WHERE n <= 6) AS chrf, 100 * avg(f) AS chrf_pp FROM fs GROUP BY id)
SELECT id, round(coalesce(chrf, 100.0), 6) AS chrf, round(coalesce(chrf_pp, 100.0), 6) AS chrf_pp FROM rw LEFT JOIN sc USING (id)""",
)
def chrf(spark, sf_dir):
    both = E.chrf(scored(spark, sf_dir), "id", "hypothesis", "reference", {"chrf": 0, "chrf_pp": 2})
    return both.select("id", F.round("chrf", 6).alias("chrf"), F.round("chrf_pp", 6).alias("chrf_pp"))


@query("met_05_evaluated", f"WITH {_RW} SELECT id, failed, exact FROM ev")
def evaluated(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "failed", "exact")


@query("agg_34_summary", f"WITH {_RW} SELECT count(*) AS n, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE exact) AS exact, round(100 * sum(edits) / sum(ref_words), 6) AS wer FROM ev")
def summary(spark, sf_dir):
    return E.summary(scored(spark, sf_dir))


@query("agg_35_by_group", f"WITH {_RW} SELECT doc_id % 4 AS category, ref_words // 10 AS difficulty, count(*) AS n, count(*) FILTER (WHERE exact) AS exact FROM ev GROUP BY GROUPING SETS ((category), (difficulty), ())")
def by_group(spark, sf_dir):
    s = scored(spark, sf_dir).select((F.expr("id div 10000000") % 4).alias("category"), F.expr("ref_words div 10").alias("difficulty"), "exact")
    return s.groupingSets([["category"], ["difficulty"], []], "category", "difficulty").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"))


@query("agg_36_leaderboard", f"WITH {_RW}, b AS (SELECT 'changed' AS system, exact FROM ev UNION ALL SELECT 'input', array_to_string(ta, ' ') = array_to_string(tb, ' ') FROM rw UNION ALL SELECT 'reference', true FROM rw) SELECT system, count(*) AS n, count(*) FILTER (WHERE exact) AS exact, row_number() OVER (ORDER BY count(*) FILTER (WHERE exact) DESC, system) AS place FROM b GROUP BY system")
def leaderboard(spark, sf_dir):
    s = scored(spark, sf_dir)
    systems = s.select(F.lit("changed").alias("system"), "exact").union(s.select(F.lit("input"), E.exact(F.col("input"), F.col("reference")))).union(s.select(F.lit("reference"), F.lit(True)))
    g = systems.groupBy("system").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("exact"), "system")))


@query("agg_37_judge_scores", f"WITH {_RW} SELECT id, greatest(0.0, 100.0 - 10.0 * edits - CASE WHEN failed THEN 2.5 ELSE 0.0 END)::DOUBLE AS score FROM ev")
def judge_scores(spark, sf_dir):
    r = rows(spark, sf_dir)
    s = E.evaluated(r.select("id", "input", "reference"), r.select("id", "hypothesis"))
    spans = F.concat(F.array_repeat(F.lit("major"), F.col("edits")), F.when(F.col("failed"), F.array(F.lit("minor"))).otherwise(F.expr("cast(array() as array<string>)")))
    return s.select("id", E.judge_score(spans).alias("score"))


_CLS = "CASE WHEN y = x THEN 'needless' WHEN h = x THEN 'untranslated' ELSE 'wrong' END"


@query("agg_38_error_classes", f"WITH {_RW}, o AS (SELECT unnest(ta) AS x, unnest(tb) AS y, unnest(h) AS h FROM rw) SELECT CASE WHEN h = y THEN 'hit' ELSE {_CLS} END AS cls, count(*) AS n FROM o WHERE x IN ('the', 'of', 'and') GROUP BY cls")
def error_classes(spark, sf_dir):
    e = edited(spark, sf_dir).select(F.when(F.col("id") % 11 == 0, F.col("ta")).otherwise(F.transform("ta", lambda w: F.when(w == "the", "le").otherwise(w))).alias("h"), "ta", "tb")
    o = e.select(F.explode(F.arrays_zip("ta", "tb", "h")).alias("p")).select("p.*").filter(F.col("ta").isin("the", "of", "and"))
    return o.groupBy(P.error_class(F.col("ta"), F.col("tb"), F.col("h")).alias("cls")).agg(F.count("*").alias("n"))


@query("jon_18_contrast", f"WITH {_RW}, s AS (SELECT id, -edits AS x, -len([1 FOR i IN range(1, len(ta) + 1) IF ta[i] <> tb[i]]) AS y FROM ev JOIN rw USING (id)) SELECT count(*) FILTER (WHERE x > y) AS wins, count(*) FILTER (WHERE x = y) AS ties, count(*) FILTER (WHERE x < y) AS losses, round(avg(x - y), 6) AS gap FROM s")
def contrast(spark, sf_dir):
    s = scored(spark, sf_dir)
    base = s.select("id", (-E.word_edits(F.col("input"), F.col("reference"))).alias("score"))
    return E.contrast(s.select("id", (-F.col("edits")).alias("score")), base, "id", "score")


@query("agg_44_base_and_final", f"WITH {_RW} SELECT count(*) FILTER (WHERE array_to_string(ta, ' ') = array_to_string(tb, ' ')) AS base_exact, count(*) FILTER (WHERE exact) AS final_exact, count(*) FILTER (WHERE array_to_string(ta, ' ') = array_to_string(tb, ' ') AND NOT exact) AS regressions FROM ev JOIN rw USING (id)")
def base_and_final(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("base", E.exact(F.col("input"), F.col("reference")))
    return s.agg(F.count_if("base").alias("base_exact"), F.count_if("exact").alias("final_exact"), F.count_if(F.col("base") & ~F.col("exact")).alias("regressions"))


@query("dif_04_failed_items", f"WITH {_RW} SELECT id, edits FROM ev WHERE NOT exact AND edits <= 2")
def failed_items(spark, sf_dir):
    return scored(spark, sf_dir).filter("not exact and edits <= 2").select("id", "edits")


@query("agg_42_pseudo_systems", f"WITH {_RW} SELECT 'reference' AS system, count(*) AS n, sum(len(tb))::BIGINT AS words FROM rw UNION ALL SELECT 'input', count(*), sum(len(ta))::BIGINT FROM rw UNION ALL SELECT 'changed', count(*), sum(len(h))::BIGINT FROM rw")
def pseudo_systems(spark, sf_dir):
    s = scored(spark, sf_dir)
    words = lambda c: F.size(F.split(c, " "))
    systems = [s.select(F.lit(name).alias("system"), words(c).alias("w")) for name, c in (("reference", "reference"), ("input", "input"), ("changed", "hypothesis"))]
    return systems[0].union(systems[1]).union(systems[2]).groupBy("system").agg(F.count("*").alias("n"), F.sum("w").alias("words"))


@query("agg_43_points_by_type", f"WITH {_RW}, o AS (SELECT failed, unnest(ta) AS x, unnest(tb) AS y, unnest(h) AS h FROM rw) SELECT x AS type, CASE WHEN failed THEN 'default' ELSE 'rule' END AS decided_by, count(*) AS n, count(*) FILTER (WHERE h = y) AS hits FROM o WHERE x IN ('the', 'of') GROUP BY ALL")
def points_by_type(spark, sf_dir):
    failed = F.col("id") % 11 == 0
    e = edited(spark, sf_dir).select(failed.alias("failed"), F.when(failed, F.col("ta")).otherwise(F.transform("ta", lambda w: F.when(w == "the", "le").otherwise(w))).alias("h"), "ta", "tb")
    o = e.select("failed", F.explode(F.arrays_zip("ta", "tb", "h")).alias("p")).select("failed", "p.*").filter(F.col("ta").isin("the", "of"))
    return o.groupBy(F.col("ta").alias("type"), F.when(F.col("failed"), "default").otherwise("rule").alias("decided_by")).agg(F.count("*").alias("n"), F.count_if(F.col("h") == F.col("tb")).alias("hits"))


@query("agg_40_layer_bookkeeping", f"WITH {_RW}, o AS (SELECT unnest(ta) AS x, unnest(tb) AS y, unnest(h) AS h FROM rw) SELECT count(*) AS points, count(*) FILTER (WHERE h <> x) AS changed, count(*) FILTER (WHERE x = y) AS default_hits, count(*) FILTER (WHERE h = y) AS layer_hits FROM o WHERE x IN ('the', 'of', 'and')")
def layer_bookkeeping(spark, sf_dir):
    e = edited(spark, sf_dir).select(F.when(F.col("id") % 11 == 0, F.col("ta")).otherwise(F.transform("ta", lambda w: F.when(w == "the", "le").otherwise(w))).alias("h"), "ta", "tb")
    o = e.select(F.explode(F.arrays_zip("ta", "tb", "h")).alias("p")).select("p.*").filter(F.col("ta").isin("the", "of", "and"))
    return o.agg(F.count("*").alias("points"), F.count_if(F.col("h") != F.col("ta")).alias("changed"), F.count_if(F.col("ta") == F.col("tb")).alias("default_hits"), F.count_if(F.col("h") == F.col("tb")).alias("layer_hits"))


@query("met_06_metric_rows", f"WITH {_RW}, s AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (WHERE failed))::DOUBLE AS failed, (count(*) FILTER (WHERE exact))::DOUBLE AS exact, round(100 * sum(edits) / sum(ref_words), 6)::DOUBLE AS wer FROM ev) SELECT 'changed' AS system, metric, value FROM (UNPIVOT s ON n, failed, exact, wer INTO NAME metric VALUE value)")
def metric_rows(spark, sf_dir):
    return E.metric_rows(E.summary(scored(spark, sf_dir)).withColumn("system", F.lit("changed")), ["system"])
