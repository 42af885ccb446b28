"""Queries of language models, decisions and classifiers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import language_model as M
from ..operators import selection as S
from . import sql
from .common import sentences, small
from .registry import query
from .selection import _NEAR, evaluation_items, word_sets


def lm_sentences(spark, sf_dir):
    """Sentences of all languages; model is the struct of lang, which unlike a null lang joins with itself."""
    return sentences(spark, sf_dir).select((F.col("doc_id") * 10_000_000 + F.col("sent_no")).alias("id"), "doc_id", F.struct("lang").alias("model"), T.lm_text(F.col("text")).alias("text"))


def named(df, model="model"):
    """The lang of each model as a column."""
    return df.withColumn("lang", F.col(f"{model}.lang")).drop(model)


_LM = f"""{sql.SENT}, lm AS (SELECT doc_id * 10000000 + sent_no AS id, doc_id, {{'lang': lang}} AS model, [CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' ELSE x END FOR x IN {sql.find('lower(' + sql.fold('text') + ')', T.LM_UNITS)}] AS t FROM sent),
mk AS (SELECT id, doc_id, model, list_concat(['<s>'], t, ['</s>']) AS w FROM lm), nn AS (SELECT model, w, unnest([1, 2, 3]) AS n FROM mk), gg AS (SELECT model, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS gram FROM nn),
ct AS (SELECT model, n, gram, count(*) AS count FROM gg GROUP BY model, n, gram HAVING n = 1 OR count(*) > 1)"""


@query("lmd_01_ngram_counts", f"WITH {_LM} SELECT model.lang AS lang, n, gram, count FROM ct")
def ngram_counts(spark, sf_dir):
    return named(M.ngram_counts(lm_sentences(spark, sf_dir), "text", 3, "model").withColumn("n", F.col("n").cast("int")))


@query(
    "lmd_02_log_probability",
    f"""WITH {_LM}, tt AS (SELECT model, sum(count) AS total FROM ct WHERE n = 1 AND gram <> '<s>' GROUP BY model),
ps AS (SELECT id, model, w, unnest(range(2, len(w) + 1)) AS i FROM mk), hs AS (SELECT id, model, i, n, array_to_string(w[i - n + 1:i], ' ') AS gram, CASE WHEN n > 1 THEN array_to_string(w[i - n + 1:i - 1], ' ') END AS history FROM ps, (SELECT unnest([1, 2, 3]) AS n) WHERE n <= i),
jn AS (SELECT hs.*, a.count AS c, b.count AS ch FROM hs LEFT JOIN ct a ON hs.gram = a.gram AND hs.model = a.model LEFT JOIN ct b ON hs.history = b.gram AND hs.model = b.model),
bs AS (SELECT id, model, i, max(n) AS longest, max(CASE WHEN c IS NOT NULL AND (n = 1 OR ch IS NOT NULL) THEN n END) AS bn, arg_max(c, CASE WHEN c IS NOT NULL AND (n = 1 OR ch IS NOT NULL) THEN n END) AS c, arg_max(ch, CASE WHEN c IS NOT NULL AND n > 1 AND ch IS NOT NULL THEN n END) AS ch FROM jn GROUP BY id, model, i)
SELECT id, model.lang AS lang, count(*) AS words, round(sum(ln(CASE WHEN bn IS NULL THEN 0.5 / total WHEN bn = 1 THEN c / total ELSE c / ch END) + (longest - coalesce(bn, 1)) * ln(0.4)), 6) AS logprob FROM bs JOIN tt USING (model) GROUP BY id, model""",
)
def log_probability(spark, sf_dir):
    s = lm_sentences(spark, sf_dir)
    return named(M.log_probability(s, "id", "text", M.ngram_counts(s, "text", 3, "model"), 3, by=("model",)).withColumn("logprob", F.round("logprob", 6)))


def _model_sql(order: int) -> str:
    """The Kneser-Ney model over mk (model, w): kk (model, n, gram, a) and kh (model, n, hist, gamma, size)."""
    d = lambda k: f"CASE WHEN t1 > 0 AND t2 > 0 AND t{k} > 0 AND t{k + 1} > 0 AND {k} - {k + 1} * y * t{k + 1} / t{k} > 0 THEN {k} - {k + 1} * y * t{k + 1} / t{k} ELSE y END"
    return f"""kg AS (SELECT model, n, unnest([w[i:i + n - 1] FOR i IN range(1, len(w) - n + 2)]) AS g FROM (SELECT model, w, unnest(range(1, {order + 1})) AS n FROM mk)),
kr AS (SELECT model, n, array_to_string(g, ' ') AS gram, coalesce(array_to_string(g[1:n - 1], ' '), '') AS hist, coalesce(array_to_string(g[2:], ' '), '') AS suf, g[1] = '<s>' AS st, count(*) AS c FROM kg GROUP BY ALL),
kb AS (SELECT model, n - 1 AS n, suf AS gram, count(*) AS k FROM kr WHERE n > 1 GROUP BY ALL),
kc AS (SELECT r.model, r.n, r.gram, r.hist, r.c > 1 AS twice, CASE WHEN r.n = {order} OR r.st THEN r.c ELSE k END AS c FROM kr r LEFT JOIN kb ON r.model = kb.model AND r.n = kb.n AND r.gram = kb.gram WHERE NOT (r.n = 1 AND r.st)),
kt AS (SELECT *, CASE WHEN t1 > 0 THEN t1 / (t1 + 2 * t2) ELSE 0.5 END AS y FROM (SELECT model, n, count(*) FILTER (WHERE c = 1) AS t1, count(*) FILTER (WHERE c = 2) AS t2, count(*) FILTER (WHERE c = 3) AS t3, count(*) FILTER (WHERE c = 4) AS t4 FROM kc GROUP BY model, n)),
ks AS (SELECT model, n, hist, sum(c) AS s, count(*) AS kinds FROM kc GROUP BY model, n, hist),
kk AS (SELECT kc.model, kc.n, kc.gram, kc.hist, (c - CASE WHEN c = 1 THEN {d(1)} WHEN c = 2 THEN {d(2)} ELSE {d(3)} END) / s AS a FROM kc JOIN kt USING (model, n) JOIN ks USING (model, n, hist) WHERE n = 1 OR twice),
kh AS (SELECT ks.model, ks.n, ks.hist, 1 - coalesce(used, 0) AS gamma, CASE WHEN ks.n = 1 THEN kinds + 1 END AS size FROM ks LEFT JOIN (SELECT model, n, hist, sum(a) AS used FROM kk GROUP BY model, n, hist) USING (model, n, hist))"""


def _score_sql(order: int, rows: str, keys: str) -> str:
    """kp (keys, model, words, logprob) of the words from lo to hi of w in rows."""
    p = "p1"
    for n in range(2, order + 1):
        p = f"CASE WHEN g{n} IS NULL THEN {p} ELSE a{n} + g{n} * ({p}) END"
    of = ", ".join(f"max(CASE WHEN n = {n} THEN a END) AS a{n}, max(CASE WHEN n = {n} THEN gamma END) AS g{n}" for n in range(2, order + 1))
    return f"""k0 AS (SELECT {keys}, model, w, unnest(range(lo, hi + 1)) AS j FROM {rows}),
k1 AS (SELECT {keys}, model, j, n, array_to_string(w[j - n + 1:j], ' ') AS gram, CASE WHEN n > 1 THEN array_to_string(w[j - n + 1:j - 1], ' ') ELSE '' END AS hist FROM k0, (SELECT unnest(range(1, {order + 1})) AS n) WHERE n <= j),
k2 AS (SELECT k1.*, coalesce(kk.a, 0) AS a, kh.gamma, kh.size FROM k1 LEFT JOIN kk ON k1.model = kk.model AND k1.n = kk.n AND k1.gram = kk.gram LEFT JOIN kh ON k1.model = kh.model AND k1.n = kh.n AND k1.hist = kh.hist),
k3 AS (SELECT {keys}, model, j, max(CASE WHEN n = 1 THEN a + gamma / size END) AS p1, {of} FROM k2 GROUP BY {keys}, model, j),
kp AS (SELECT {keys}, model, count(*) AS words, round(sum(ln({p})), 6) AS logprob FROM k3 GROUP BY {keys}, model)"""


@query("lmd_02_kneser_ney", f"WITH {_LM}, {_model_sql(5)}, ks0 AS (SELECT id, model, w, 2 AS lo, len(w) AS hi FROM mk), {_score_sql(5, 'ks0', 'id')} SELECT id, model.lang AS lang, words, logprob FROM kp")
def kneser_ney(spark, sf_dir):
    s = lm_sentences(spark, sf_dir)
    return named(M.scored_by_themselves(s, ["id"], "text", 5, ("model",)))


@query("lmd_03_prior", f"WITH {_LM}, t AS (SELECT model, sum(count) AS total FROM ct WHERE n = 1 GROUP BY model) SELECT model.lang AS lang, gram AS form, round(ln((count + 1) / total), 6) AS prior FROM ct JOIN t USING (model) WHERE n = 1 AND gram IN ('the', 'of', 'and')")
def prior(spark, sf_dir):
    u = M.ngram_counts(lm_sentences(spark, sf_dir), "text", 1, "model")
    total = u.groupBy("model").agg(F.sum("count").alias("total"))
    p = u.filter(F.col("gram").isin("the", "of", "and")).join(total, "model")
    return named(p.select("model", F.col("gram").alias("form"), F.round(M.prior(F.col("count"), F.col("total")), 6).alias("prior")))


@query("lmd_04_lm_export", f"WITH {_LM} SELECT id, array_to_string(t, ' ') AS line FROM lm WHERE len(t) >= 3")
def lm_export(spark, sf_dir):
    return lm_sentences(spark, sf_dir).filter(F.size(F.split("text", " ")) >= 3).select("id", F.col("text").alias("line"))


POINTS = [("the", "the"), ("the", "thee"), ("of", "of"), ("of", "off")]


def token_arrays(spark, sf_dir):
    return lm_sentences(spark, sf_dir).select("id", "model", F.split("text", " ").alias("w"))


@query("lmd_08_detected", f"WITH {_LM}, x AS (SELECT id, unnest(t) AS form, generate_subscripts(t, 1) - 1 AS i FROM lm) SELECT id, i, form FROM x WHERE form IN ('the', 'of')")
def detected(spark, sf_dir):
    points = small(spark, sorted({(f,) for f, _ in POINTS}), "form string")
    return token_arrays(spark, sf_dir).select("id", F.posexplode("w").alias("i", "form")).join(points, "form").select("id", "i", "form")


@query("lmd_09_candidate_texts", f"WITH {_LM}, x AS (SELECT id, t, unnest(t) AS form, generate_subscripts(t, 1) AS i FROM lm), p(form, candidate) AS (VALUES ('the', 'the'), ('the', 'thee'), ('of', 'of'), ('of', 'off')) SELECT id, i - 1 AS i, candidate, array_to_string(list_concat(t[1:i - 1], [candidate], t[i + 1:]), ' ') AS text FROM x JOIN p USING (form)")
def candidate_texts(spark, sf_dir):
    points = small(spark, POINTS, "form string, candidate string")
    return M.candidate_texts(token_arrays(spark, sf_dir), points, "id").select("id", "i", "candidate", "text")


#: Words that a decision's model looks at.
ORDER = 3


def scored_candidates(spark, sf_dir, points=POINTS):
    """Candidates of all ambiguous words with the model's score of the words that they change, and their own priors."""
    s = lm_sentences(spark, sf_dir)
    points = small(spark, points, "form string, candidate string")
    c = M.scored_candidates(token_arrays(spark, sf_dir), points, ["id"], M.kneser_ney(s, "text", ORDER, ("model",)), ORDER, ("model",))
    # Counts of words are the model's own. A word goes by its count too, as a filter for candidates below the sums would count the text again.
    w = M.word_counts(s, "text", ORDER, "model")
    total = w.groupBy("model").agg(F.sum("count").alias("total"))
    n = w.select("model", F.when(F.col("count") > 0, F.col("gram")).alias("candidate"), "count").join(F.broadcast(points.select("candidate").distinct()), "candidate")
    c = c.join(F.broadcast(n), ["model", "candidate"], "left").join(F.broadcast(total), "model")
    return c.select("id", "i", "candidate", "form", "words", "logprob", F.round(M.prior(F.coalesce("count", F.lit(0)), F.col("total")), 6).alias("prior"), (F.col("candidate") == F.col("form")).alias("is_default"))


def _decisions(points: list[tuple[str, str]]) -> str:
    return f"""{_LM}, {_model_sql(ORDER)}, p(form, candidate) AS (VALUES {', '.join(map(str, points))}), x AS (SELECT id, model, w, unnest(w) AS form, generate_subscripts(w, 1) AS j FROM mk),
cd AS (SELECT id, j - 2 AS i, model, form, candidate, list_concat(w[1:j - 1], [candidate], w[j + 1:]) AS w, j AS lo, least(j + {ORDER - 1}, len(w)) AS hi FROM x JOIN p USING (form)), {_score_sql(ORDER, 'cd', 'id, i, form, candidate')},
tl AS (SELECT model, sum(count) AS total FROM ct WHERE n = 1 GROUP BY model),
sc AS (SELECT id, i, candidate, form, words, logprob, prior, logprob - 0.5 * prior AS score, candidate = form AS d FROM (SELECT kp.*, round(ln((coalesce(ct.count, 0) + 1) / total), 6) AS prior FROM kp JOIN tl ON kp.model = tl.model LEFT JOIN ct ON ct.model = kp.model AND ct.n = 1 AND ct.gram = kp.candidate)),
dg AS (SELECT id, i, arg_max(candidate, (score, candidate)) AS best, max(score) AS top, max(CASE WHEN d THEN candidate END) AS "default", max(CASE WHEN d THEN score END) AS base FROM sc GROUP BY id, i)"""


_DEC = _decisions(POINTS)


@query("lmd_06_decided", f'WITH {_DEC} SELECT id, i, "default", best, round(top - base, 6) AS gap, CASE WHEN top - base > 2 THEN best ELSE "default" END AS chosen FROM dg')
def decided(spark, sf_dir):
    return M.decided(scored_candidates(spark, sf_dir), ["id", "i"], 0.5, 2.0).withColumn("gap", F.round("gap", 6))


@query("lmd_10_applied", f"""WITH {_DEC}, ch AS (SELECT id, i, CASE WHEN top - base > 2 THEN best ELSE "default" END AS chosen FROM dg), y AS (SELECT id, unnest(t) AS form, generate_subscripts(t, 1) - 1 AS i FROM lm) SELECT id, string_agg(coalesce(chosen, form), ' ' ORDER BY i) AS text FROM y LEFT JOIN ch USING (id, i) GROUP BY id""")
def applied(spark, sf_dir):
    return M.applied(lm_sentences(spark, sf_dir), "id", M.decided(scored_candidates(spark, sf_dir), ["id", "i"], 0.5, 2.0))


@query("lmd_11_grid", f"""WITH {_DEC}, g AS (SELECT m AS margin, l AS lam FROM (SELECT unnest([0.0, 1.0, 2.0, 4.0]) AS m), (SELECT unnest([0.0, 0.5]) AS l)), r AS (SELECT margin, lam, CASE WHEN top - base - lam > margin THEN best ELSE "default" END AS chosen, "default", CASE WHEN id % 2 = 0 THEN best ELSE "default" END AS expected FROM dg, g) SELECT margin, lam, count(*) FILTER (WHERE chosen = expected) AS hits, count(*) FILTER (WHERE chosen <> expected AND expected = "default") AS serious FROM r GROUP BY margin, lam""")
def grid(spark, sf_dir):
    d = M.decided(scored_candidates(spark, sf_dir), ["id", "i"], 0.5, 2.0)
    d = d.select("default", "best", F.col("gap").alias("gap0"), F.lit(1.0).alias("dprior"), F.when(F.col("id") % 2 == 0, F.col("best")).otherwise(F.col("default")).alias("expected"))
    parameters = small(spark, [(m, l) for m in (0.0, 1.0, 2.0, 4.0) for l in (0.0, 0.5)], "margin double, lam double")  # noqa: E741
    return M.grid(d, parameters)


def examples(spark, sf_dir):
    """Slots of `the` (class 0) and `of` (class 1) as examples of a group for each language."""
    w = lm_sentences(spark, sf_dir).select("id", "model", F.split("text", " ").alias("w"))
    # Features are made inside the array, so no slot carries its sentence along.
    slots = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("form"), F.when(x.isin("the", "of"), M.slot_features(F.col("w"), i)).alias("features"))), lambda s: s["features"].isNotNull())
    s = w.select("id", "model", F.explode(slots).alias("s")).select("id", "model", "s.*")
    return s.select(F.col("model").alias("group"), "id", "i", F.when(F.col("form") == "the", 0).otherwise(1).alias("cls"), "features")


_EXAMPLES = f"""sl AS (SELECT id, model, t, unnest(t) AS form, generate_subscripts(t, 1) AS i FROM lm),
ft AS (SELECT id, model, i, CASE WHEN form = 'the' THEN 0 ELSE 1 END AS cls, list_concat(['L1=' || coalesce(CASE WHEN i > 1 THEN t[i - 1] END, '_'), 'L2=' || coalesce(CASE WHEN i > 2 THEN t[i - 2] END, '_'), 'R1=' || coalesce(t[i + 1], '_'), 'R2=' || coalesce(t[i + 2], '_'),
 'LL=' || coalesce(CASE WHEN i > 2 THEN t[i - 2] END, '_') || ' ' || coalesce(CASE WHEN i > 1 THEN t[i - 1] END, '_'), 'RR=' || coalesce(t[i + 1], '_') || ' ' || coalesce(t[i + 2], '_')], ['B=' || x FOR x IN list_distinct(list_concat(t[greatest(1, i - 8):i - 1], t[i + 1:i + 8]))]) AS f FROM sl WHERE form IN ('the', 'of')),
fe AS (SELECT model, cls, unnest(f) AS feature FROM ft), md AS (SELECT model, feature, count(*) FILTER (WHERE cls = 0) AS n0, count(*) FILTER (WHERE cls = 1) AS n1 FROM fe GROUP BY model, feature HAVING count(*) >= 2), mt AS (SELECT model, sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM md GROUP BY model)"""
_EX = f"{_LM}, {_EXAMPLES}"


@query("nbc_01_slot_features", f"WITH {_EX} SELECT id, i - 1 AS i, cls, len(f) AS n FROM ft")
def slot_features(spark, sf_dir):
    return examples(spark, sf_dir).select("id", "i", "cls", F.size("features").alias("n"))


@query("nbc_03_train", f"WITH {_EX} SELECT model.lang AS lang, feature, n0, n1, t0::BIGINT AS t0, t1::BIGINT AS t1, v FROM md JOIN mt USING (model)")
def train(spark, sf_dir):
    return named(M.bayes_train(examples(spark, sf_dir)), "group")


@query("nbc_04_logodds", f"WITH {_EX}, fl AS (SELECT id, model, i - 1 AS i, unnest(f) AS feature FROM ft) SELECT id, i, round(sum(ln((n0 + 0.5) / (t0 + 0.5 * v)) - ln((n1 + 0.5) / (t1 + 0.5 * v))), 6) AS logodds FROM fl JOIN md USING (model, feature) JOIN mt USING (model) GROUP BY id, i")
def logodds(spark, sf_dir):
    e = examples(spark, sf_dir)
    return M.bayes_logodds(e, ["id", "i"], M.bayes_train(e))


@query("nbc_05_balanced_accuracy", f"WITH {_EX}, fl AS (SELECT id, model, i, cls, unnest(f) AS feature FROM ft), lo AS (SELECT id, model, i, cls, sum(ln((n0 + 0.5) / (t0 + 0.5 * v)) - ln((n1 + 0.5) / (t1 + 0.5 * v))) AS o FROM fl JOIN md USING (model, feature) JOIN mt USING (model) GROUP BY id, model, i, cls), rc AS (SELECT model, cls, avg(CASE WHEN (CASE WHEN round(o, 6) > 0 THEN 0 ELSE 1 END) = cls THEN 1 ELSE 0 END) AS r FROM lo GROUP BY model, cls) SELECT model.lang AS lang, round(avg(r), 6) AS accuracy FROM rc GROUP BY model")
def balanced_accuracy(spark, sf_dir):
    e = examples(spark, sf_dir)
    s = M.bayes_logodds(e.withColumn("model", F.col("group")), ["id", "i", "cls", "model"], M.bayes_train(e))
    return named(M.balanced_accuracy(s, "model"))


@query("nbc_06_informative", f"WITH {_EX}, o AS (SELECT model, feature, round(ln((n0 + 0.5) / (t0 + 0.5 * v)) - ln((n1 + 0.5) / (t1 + 0.5 * v)), 6) AS odds FROM md JOIN mt USING (model) WHERE n0 + n1 >= 20) SELECT model.lang AS lang, feature, odds FROM o QUALIFY row_number() OVER (PARTITION BY model ORDER BY odds DESC, feature) <= 10 OR row_number() OVER (PARTITION BY model ORDER BY odds, feature) <= 10")
def informative(spark, sf_dir):
    return named(M.informative(M.bayes_train(examples(spark, sf_dir))), "group")


@query("agg_39_log_contrast", f"WITH t AS (SELECT lang = 'en' AS a, unnest({sql.tokens('text')}) AS form FROM documents), c AS (SELECT form, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE NOT a) AS nb FROM t GROUP BY form), s AS (SELECT sum(na) AS ta, sum(nb) AS tb FROM c) SELECT form, round(ln((na + 1) / ta) - ln((nb + 1) / tb), 6) AS contrast FROM c, s WHERE na + nb >= 50")
def log_contrast(spark, sf_dir):
    from .common import documents

    t = documents(spark, sf_dir).select((F.col("lang") == "en").alias("a"), F.explode(T.tokens(F.col("text"))).alias("form"))
    c = t.groupBy("form").agg(F.count_if("a").alias("na"), F.count_if(~F.col("a")).alias("nb"))
    s = t.agg(F.count_if("a").alias("ta"), F.count_if(~F.col("a")).alias("tb"))
    return c.filter("na + nb >= 50").crossJoin(s).select("form", F.round(F.log((F.col("na") + 1) / F.col("ta")) - F.log((F.col("nb") + 1) / F.col("tb")), 6).alias("contrast"))


@query(
    "nbc_02_labelled_examples",
    f"WITH {_EX}, {_NEAR}, o AS (SELECT id, model FROM ft GROUP BY id, model HAVING count(DISTINCT cls) = 1) SELECT id, i - 1 AS i, cls FROM ft JOIN o USING (id, model) WHERE id NOT IN (SELECT id FROM nr WHERE jaccard >= 0.6) QUALIFY row_number() OVER (PARTITION BY model, cls ORDER BY md5('e:' || id || ':' || (i - 1)), id, i) <= 500",
)
def labelled_examples(spark, sf_dir):
    """Sentences near the evaluation are left out first."""
    near = S.near_evaluation(word_sets(spark, sf_dir), evaluation_items(spark, sf_dir), "id", "words").select("id").distinct()
    e = examples(spark, sf_dir).drop("features").join(near, "id", "left_anti")
    return M.labelled_examples(e, "id", 500, "e").select("id", "i", "cls")


@query("nbc_07_choices", f"WITH {_EX}, fl AS (SELECT id, model, i - 1 AS i, unnest(f) AS feature FROM ft), lo AS (SELECT id, i, round(sum(ln((n0 + 0.5) / (t0 + 0.5 * v)) - ln((n1 + 0.5) / (t1 + 0.5 * v))), 6) AS o FROM fl JOIN md USING (model, feature) JOIN mt USING (model) GROUP BY id, i) SELECT id, i, CASE WHEN o > 0 THEN 'the' ELSE 'of' END AS choice FROM lo")
def choices(spark, sf_dir):
    e = examples(spark, sf_dir)
    return M.bayes_choice(M.bayes_logodds(e, ["id", "i"], M.bayes_train(e)), F.lit("the"), F.lit("of")).select("id", "i", "choice")


@query("nbc_08_gold_labels", f"WITH {_LM} SELECT id, CASE WHEN list_contains(t, 'the') AND NOT list_contains(t, 'thee') THEN 'the' WHEN list_contains(t, 'thee') AND NOT list_contains(t, 'the') THEN 'thee' END AS label FROM lm")
def gold_labels(spark, sf_dir):
    return lm_sentences(spark, sf_dir).select("id", M.gold_label(F.lit(None).cast("string"), F.array(F.lit("the"), F.lit("thee")), F.split("text", " ")).alias("label"))


@query("lmd_13_lemmatised", f"WITH {_LM}, x AS (SELECT id, unnest(t) AS form, generate_subscripts(t, 1) AS i FROM lm), l AS (SELECT id, i, form, CASE WHEN form IN ('the', 'of') OR NOT regexp_matches(form, '[a-z]') OR NOT ends_with(form, 's') THEN form ELSE substr(form, 1, length(form) - 1) END AS o FROM x) SELECT id, string_agg(o, ' ' ORDER BY i) AS text, count(*) FILTER (WHERE o <> form) AS n_changed FROM l GROUP BY id")
def lemmatised(spark, sf_dir):
    t = lm_sentences(spark, sf_dir).filter("text <> ''").select("id", F.posexplode(F.split("text", " ")).alias("i", "form"))
    lemma = F.when(F.col("form").endswith("s"), F.expr("substring(form, 1, length(form) - 1)"))
    t = t.withColumn("lemma", lemma).withColumn("pos", F.when(F.col("form").rlike("[a-z]"), "WORD").otherwise("PUNCT"))
    return M.lemmatised(t, "id", small(spark, [("the",), ("of",)], "form string"))


@query("lmd_14_mixed_scores", f"WITH {_DEC} SELECT id, i, candidate, round(0.75 * logprob + 0.25 * prior, 9) AS score FROM sc")
def mixed_scores(spark, sf_dir):
    """The model of ORDER words mixed with that of one word."""
    c = scored_candidates(spark, sf_dir)
    other = c.select("id", "i", "candidate", F.col("prior").alias("logprob"))
    return M.mixed_scores([(c, 0.75), (other, 0.25)], ["id", "i", "candidate"]).withColumn("score", F.round("score", 9))


@query("lmd_16_labelled_benchmark", f"WITH {_LM}, x AS (SELECT id, t, unnest(t) AS form, generate_subscripts(t, 1) AS i FROM lm) SELECT id, i - 1 AS i, array_to_string(list_concat(t[1:i - 1], ['thee'], t[i + 1:]), ' ') AS text FROM x WHERE form = 'the'")
def labelled_benchmark(spark, sf_dir):
    points = small(spark, [("the", "thee")], "form string, candidate string")
    return M.candidate_texts(token_arrays(spark, sf_dir), points, "id").select("id", "i", "text")


@query("lmd_07_pos_veto", f"WITH {_LM}, x AS (SELECT id, unnest(t) AS form, generate_subscripts(t, 1) - 1 AS i FROM lm) SELECT id, i, CASE WHEN ends_with(form, 'ing') THEN 'verb' WHEN ends_with(form, 'tion') THEN 'noun' END AS reading FROM x WHERE length(form) > 4")
def pos_veto(spark, sf_dir):
    t = lm_sentences(spark, sf_dir).select("id", F.posexplode(F.split("text", " ")).alias("i", "form")).filter(F.length("form") > 4)
    pos = F.when(F.col("form").endswith("ing"), "VERB").when(F.col("form").endswith("tion"), "NOUN")
    return t.select("id", "i", M.pos_veto(pos, F.lit(None).cast("string"), F.lit("noun"), F.lit("verb")).alias("reading"))


@query("lmd_05_scores", f"WITH {_DEC} SELECT id, i, candidate, round(logprob / words - CASE WHEN d THEN 0.25 ELSE 0.75 END * prior, 9) AS score FROM sc")
def candidate_scores(spark, sf_dir):
    """Types of points are stood in for by whether a candidate is the default."""
    c = scored_candidates(spark, sf_dir).withColumn("type", F.when(F.col("is_default"), "collision").otherwise("unresolvable"))
    return M.candidate_scores(c, {"collision": 0.25, "unresolvable": 0.75}, 0.5, True).select("id", "i", "candidate", F.round("score", 9).alias("score"))


@query("lmd_12_prior_swapped", f"WITH {_DEC}, fr AS (SELECT form, count(*) AS n FROM (SELECT unnest({sql.tokens('text')}) AS form FROM documents) GROUP BY form) SELECT id, i, candidate, round(ln((coalesce(n, 0) + 1) / (SELECT sum(n) FROM fr)), 6) AS prior FROM sc LEFT JOIN fr ON candidate = fr.form")
def prior_swapped(spark, sf_dir):
    from .common import documents

    n = documents(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    return M.prior_swapped(scored_candidates(spark, sf_dir), n).select("id", "i", "candidate", F.round("prior", 6).alias("prior"))


#: Two words that stand for each other: what the text has is right, so decisions can be judged.
CONFUSED = [("the", "the"), ("the", "of"), ("of", "of"), ("of", "the")]
_ODDS = f"{_EXAMPLES}, fl AS (SELECT id, model, i - 1 AS i, unnest(f) AS feature FROM ft), lo AS (SELECT id, i, round(sum(ln((n0 + 0.5) / (t0 + 0.5 * v)) - ln((n1 + 0.5) / (t1 + 0.5 * v))), 6) AS o FROM fl JOIN md USING (model, feature) JOIN mt USING (model) GROUP BY id, i)"
_SLOTS = """st AS (SELECT id, j - 2 AS i, form, CASE WHEN j % 2 = 0 THEN 'collision' ELSE 'unresolvable' END AS type, CASE right(w[j + 1], 1) WHEN 's' THEN 'the' WHEN 't' THEN 'of' END AS reading FROM x WHERE form IN ('the', 'of'))"""


def slots(spark, sf_dir):
    """Slots of both words. The engine writes `the` everywhere; types go by place, and the part of speech is stood in for by the end of the next word."""
    place = lambda x, i: F.struct(i.alias("i"), x.alias("form"), F.substring(F.try_element_at("w", i + 2), -1, 1).alias("end"))
    s = token_arrays(spark, sf_dir).select("id", F.explode(F.filter(F.transform("w", place), lambda p: p["form"].isin("the", "of"))).alias("p")).select("id", "p.*")
    return s.select(
        "id", "i", "form", F.when(F.col("i") % 2 == 0, "collision").otherwise("unresolvable").alias("type"), F.lit("the").alias("engine"),
        F.when(F.col("end") == "s", "the").when(F.col("end") == "t", "of").alias("reading"),
    )


def senses(spark, sf_dir):
    """The classifier's log-odds and choice for each slot."""
    e = examples(spark, sf_dir)
    return M.bayes_choice(M.bayes_logodds(e, ["id", "i"], M.bayes_train(e)), F.lit("the"), F.lit("of")).withColumnRenamed("choice", "sense")


@query(
    "lmd_06_cascade",
    f"""WITH {_decisions(CONFUSED)}, {_ODDS}, {_SLOTS},
cv AS (SELECT id, i, st.type, reading, candidate, logprob - CASE st.type WHEN 'collision' THEN 0.25 ELSE 0.5 END * prior AS raw FROM sc JOIN st USING (id, i)),
cw AS (SELECT *, row_number() OVER (PARTITION BY id, i ORDER BY raw DESC, candidate) AS r FROM cv),
cx AS (SELECT id, i, any_value(type) AS type, any_value(reading) AS reading, max(CASE WHEN r = 1 THEN candidate END) AS best, max(CASE WHEN r = 1 THEN raw END) - max(CASE WHEN r = 2 THEN raw END) AS gap, max(CASE WHEN r = 1 THEN raw END) - max(CASE WHEN candidate = 'the' THEN raw END) AS lead FROM cw GROUP BY id, i),
cy AS (SELECT cx.*, CASE WHEN o > 0 THEN 'the' WHEN o IS NOT NULL THEN 'of' END AS sense FROM cx LEFT JOIN lo USING (id, i)),
cz AS (SELECT *, CASE WHEN type = 'unresolvable' AND reading IS NOT NULL THEN 'pos' WHEN gap < 1 AND sense IS NOT NULL THEN 'classifier' WHEN best <> 'the' AND lead <= 2 THEN 'engine' ELSE 'model' END AS decided FROM cy)
SELECT id, i, decided, CASE decided WHEN 'pos' THEN reading WHEN 'classifier' THEN sense WHEN 'engine' THEN 'the' ELSE best END AS chosen, best, round(gap, 9) AS gap, round(lead, 9) AS lead FROM cz""",
)
def cascade(spark, sf_dir):
    """Part of speech, model, classifier and default of all slots, each from its own model."""
    s = slots(spark, sf_dir).join(senses(spark, sf_dir).select("id", "i", "sense"), ["id", "i"], "left")
    criteria = M.Criteria(lam=0.5, lams={"collision": 0.25}, tie=1.0, margin=2.0, veto=("unresolvable",))
    out = M.cascade(s, scored_candidates(spark, sf_dir, CONFUSED).drop("form"), ["id", "i"], criteria)
    return out.withColumns({n: F.round(n, 9) for n in ("gap", "lead")})


@query(
    "lmd_11_sweep",
    f"""WITH {_decisions(CONFUSED)}, sg(setting, l) AS (VALUES ('plain', 0.0), ('half', 0.5), ('whole', 1.0)),
gs AS (SELECT setting, id, i, form, arg_max(candidate, (logprob - l * prior, CASE candidate WHEN 'of' THEN 1 ELSE 0 END)) AS best, round(max(logprob - l * prior) - max(CASE WHEN candidate = 'the' THEN logprob - l * prior END), 9) AS lead FROM sc, sg GROUP BY ALL),
ge AS (SELECT setting, lead AS margin, count(*) FILTER (WHERE form = 'the') AS kept, sum(CASE WHEN best <> 'the' THEN (best = form)::INT - (form = 'the')::INT ELSE 0 END) AS gain, count(*) FILTER (WHERE best <> 'the' AND best <> form) AS wrong FROM gs GROUP BY ALL UNION ALL SELECT setting, 0.0, 0, 0, 0 FROM sg),
gm AS (SELECT setting, margin, sum(kept) AS kept, sum(gain) AS gain, sum(wrong) AS wrong FROM ge GROUP BY ALL),
gr AS (SELECT setting, margin, (sum(kept) OVER (PARTITION BY setting) + coalesce(sum(gain) OVER w, 0))::BIGINT AS hits, coalesce(sum(wrong) OVER w, 0)::BIGINT AS serious FROM gm WINDOW w AS (PARTITION BY setting ORDER BY margin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT setting, margin, hits, serious, (row_number() OVER (PARTITION BY setting ORDER BY hits DESC, serious, margin))::INT AS rank FROM gr WHERE serious <= 100 QUALIFY rank <= 3""",
)
def sweep(spark, sf_dir):
    """The three best margins of each weight of the prior, with a hundred serious errors at most; the engine writes `the`, and the text is right."""
    c = scored_candidates(spark, sf_dir, CONFUSED).select("id", "i", "candidate", "logprob", "prior", F.lit("all").alias("type"), (F.col("candidate") == "the").alias("is_default"), F.col("form").alias("expected"))
    found = M.margin_sweep(c, ["id", "i"], {"plain": {"all": 0.0}, "half": {"all": 0.5}, "whole": {"all": 1.0}})
    return M.best_margins(found, 100, 3)


def _renamed(text: str, mark: str) -> str:
    """SQL of a model or its scores with tables of its own."""
    return re.sub(r"\b(k[grbctskhp0-3]|mk|cd)\b", rf"\g<1>{mark}", text)


def _candidates_of(mark: str, place: str) -> str:
    rows = f"cd AS (SELECT id, {place} AS i, model, form, candidate, list_concat(w[1:j - 1], [candidate], w[j + 1:]) AS w, j AS lo, least(j + {ORDER - 1}, len(w)) AS hi FROM (SELECT id, model, w, unnest(w) AS form, generate_subscripts(w, 1) AS j FROM mk) JOIN p USING (form))"
    return _renamed(f"{_model_sql(ORDER)}, {rows}, {_score_sql(ORDER, 'cd', 'id, i, form, candidate')}", mark)


@query(
    "lmd_14_combined",
    f"""WITH {_decisions(CONFUSED)}, mkb AS (SELECT id, model, list_concat(['<s>'], list_reverse(t), ['</s>']) AS w FROM lm), {_candidates_of('b', 'len(w) - 1 - j')},
mka AS (SELECT id, 0 AS model, w FROM mk), {_candidates_of('a', 'j - 2')}
SELECT id, i, candidate, f.logprob AS forward, b.logprob AS backward, a.logprob AS general, round((f.logprob + b.logprob) / 2, 9) AS bidirectional, round(f.logprob + 0.5 * a.logprob, 9) AS mixed, round(f.logprob - a.logprob, 9) AS difference
FROM kp f JOIN kpb b USING (id, i, candidate) JOIN kpa a USING (id, i, candidate)""",
)
def combined(spark, sf_dir):
    """Candidates under models of what stands before and of what stands after, and under one of all languages: their mean, a mix, and a difference."""
    s, w = lm_sentences(spark, sf_dir), token_arrays(spark, sf_dir)
    points = small(spark, CONFUSED, "form string, candidate string")
    forward = M.scored_candidates(w, points, ["id"], M.kneser_ney(s, "text", ORDER, ("model",)), ORDER, ("model",))
    # Places are counted from the other end there.
    turned = w.select("id", "model", F.reverse("w").alias("w"), F.size("w").alias("length"))
    backward = M.scored_candidates(turned, points, ["id", "length"], M.kneser_ney(s.withColumn("text", M.reversed_words(F.col("text"))), "text", ORDER, ("model",)), ORDER, ("model",))
    backward = backward.withColumn("i", F.col("length") - 1 - F.col("i"))
    general = M.scored_candidates(w.drop("model"), points, ["id"], M.kneser_ney(s.drop("model"), "text", ORDER), ORDER)
    sums = {"bidirectional": {"forward": 0.5, "backward": 0.5}, "mixed": {"forward": 1.0, "general": 0.5}, "difference": {"forward": 1.0, "general": -1.0}}
    out = M.combined_scores({"forward": forward, "backward": backward, "general": general}, ["id", "i", "candidate"], sums)
    return out.withColumns({n: F.round(n, 9) for n in sums})


@query(
    "lmd_15_fusion",
    f"""WITH {_decisions(CONFUSED)}, {_ODDS}, cs AS (SELECT id % 2 AS grp, max(CASE WHEN candidate = 'the' THEN score END) - max(CASE WHEN candidate = 'of' THEN score END) AS gap, any_value(o) AS o, any_value(sc.form) = 'the' AS r FROM sc JOIN lo USING (id, i) GROUP BY id, i),
fu AS (SELECT 'sum' AS rule, w AS value, grp, gap + w * o > 0 AS says, r FROM cs, (SELECT unnest([0.5, 1.0]) AS w) UNION ALL SELECT 'below', 2.0, grp, CASE WHEN abs(gap) < 2.0 THEN o > 0 ELSE gap > 0 END, r FROM cs) SELECT rule, value::DOUBLE AS value, grp, round(avg(CASE WHEN says = r THEN 1 ELSE 0 END), 6) AS accuracy FROM fu GROUP BY ALL""",
)
def fusion(spark, sf_dir):
    """The model's gap and the classifier's log-odds of all slots, in two groups by sentence."""
    c = scored_candidates(spark, sf_dir, CONFUSED).withColumn("score", F.col("logprob") - 0.5 * F.col("prior"))
    of = lambda word: F.max(F.when(F.col("candidate") == word, F.col("score")))
    cases = c.groupBy("id", "i").agg((of("the") - of("of")).alias("gap"), F.max("form").alias("form")).join(senses(spark, sf_dir), ["id", "i"])
    return M.fusion(cases.select((F.col("id") % 2).alias("grp"), "gap", "logodds", (F.col("form") == "the").alias("first_right")), [0.5, 1.0], [2.0])
