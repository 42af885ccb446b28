"""Queries of alignment, differences and mining; pairs are turns of conversations and their next."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import segment
from ..functions import text as T
from ..operators import pairs as R
from . import sql
from .common import documents, small, turn_pairs
from .registry import query, table


def tokens(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("id", T.pair_tokens(F.col("a")).alias("ta"), T.pair_tokens(F.col("b")).alias("tb"))


def edited(spark, sf_dir):
    """All sentences of documents that have a word, and a version of each in which some words are changed."""
    s = segment.explode_sentences(documents(spark, sf_dir).select("doc_id", "text")).withColumn("id", F.col("doc_id") * 10_000_000 + F.col("sent_no"))
    t = s.select("id", "doc_id", T.tokens(F.col("text")).alias("ta")).filter(F.size("ta") > 0)
    return t.withColumn("tb", F.transform("ta", lambda w: F.when(w == "the", "le").when(w.endswith("tion"), F.regexp_replace(w, "tion$", "cio")).when(w == "of", "de").otherwise(w)))


_TK = f"tk AS (SELECT id, {sql.pair_tokens('a')} AS ta, {sql.pair_tokens('b')} AS tb FROM pair)"
_ED = f"""{sql.SENT}, ed0 AS (SELECT doc_id * 10000000 + sent_no AS id, doc_id, {sql.tokens('text')} AS ta FROM sent), ed AS (SELECT id, doc_id, ta, [CASE WHEN w = 'the' THEN 'le' WHEN ends_with(w, 'tion') THEN regexp_replace(w, 'tion$', 'cio') WHEN w = 'of' THEN 'de' ELSE w END FOR w IN ta] AS tb FROM ed0 WHERE len(ta) > 0),
po AS (SELECT id, doc_id, generate_subscripts(ta, 1) - 1 AS i, unnest(ta) AS x, unnest(tb) AS y FROM ed), df AS (SELECT id, doc_id, i, x AS "from", y AS "to" FROM po WHERE x <> y)"""


@query("jon_07_jaccard", f"WITH {sql.PAIR}, {_TK} SELECT id, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) ELSE 0.0 END AS similarity FROM tk")
def jaccard(spark, sf_dir):
    return tokens(spark, sf_dir).select("id", P.jaccard(F.col("ta"), F.col("tb")).alias("similarity"))


def _paragraphs(spark, sf_dir, shift):
    d = segment.explode_paragraphs(documents(spark, sf_dir).select("doc_id", "text"))
    s = d.select((F.col("doc_id") - shift).alias("doc"), "par_no", F.filter(segment.sentences(F.col("text")), lambda x: x != "").alias("sentences"))
    return s.filter(F.col("doc") % 2 == 0)


_PAR = """ln AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS par_no FROM (SELECT doc_id, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS p FROM documents)),
pa AS (SELECT doc_id AS doc, par_no, [x FOR x IN {s} IF x <> ''] AS s FROM ln WHERE doc_id % 2 = 0), pb AS (SELECT doc_id - 1 AS doc, par_no, [x FOR x IN {s} IF x <> ''] AS s FROM ln WHERE doc_id % 2 = 1)""".format(s=sql.sentences("text"))


@query(
    "jon_05_positional_alignment",
    f"""WITH {_PAR}, ev AS (SELECT a.doc FROM (SELECT doc, count(*) AS n FROM pa GROUP BY doc) a JOIN (SELECT doc, count(*) AS n FROM pb GROUP BY doc) b USING (doc, n)),
j AS (SELECT doc, par_no, pa.s AS x, pb.s AS y FROM pa JOIN pb USING (doc, par_no) JOIN ev USING (doc)), u AS (SELECT doc, par_no, CASE WHEN len(x) = len(y) THEN x ELSE [array_to_string(x, ' ')] END AS x, CASE WHEN len(x) = len(y) THEN y ELSE [array_to_string(y, ' ')] END AS y FROM j)
SELECT doc, par_no, generate_subscripts(x, 1) - 1 AS sent_no, unnest(x) AS text_a, unnest(y) AS text_b FROM u""",
)
def positional_alignment(spark, sf_dir):
    return R.align_by_position(_paragraphs(spark, sf_dir, 0), _paragraphs(spark, sf_dir, 1))


_SETS = f"list_sort(list_distinct({sql.pair_tokens('text')}))"


@query(
    "jon_06_content_alignment",
    f"""WITH {sql.SENT}, x AS (SELECT doc_id AS doc, sent_no AS i, {_SETS} AS s FROM sent), y AS (SELECT doc_id AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) - 1 AS j, {_SETS} AS s FROM sent WHERE sent_no % 7 <> 3),
na AS (SELECT doc, count(*) AS n FROM x GROUP BY doc), nb AS (SELECT doc, count(*) AS m FROM y GROUP BY doc),
l AS (SELECT *, row_number() OVER (PARTITION BY doc, s ORDER BY i) AS k, min(i) OVER (PARTITION BY doc, s) AS a FROM x WHERE len(s) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc, s ORDER BY j) AS k, min(j) OVER (PARTITION BY doc, s) AS b FROM y WHERE len(s) > 0),
lw AS (SELECT doc, a, len(s) AS p, unnest(s) AS w FROM l WHERE k = 1), rw AS (SELECT doc, b, len(s) AS q, unnest(s) AS w FROM r WHERE k = 1),
sm AS (SELECT doc, a, b, count(*) / (any_value(p) + any_value(q) - count(*)) AS similarity FROM lw JOIN rw USING (doc, w) GROUP BY doc, a, b), sn AS (SELECT * FROM sm WHERE similarity >= 0.2),
mu AS (SELECT * FROM sn QUALIFY similarity = max(similarity) OVER (PARTITION BY doc, a) AND similarity = max(similarity) OVER (PARTITION BY doc, b)),
rs AS (SELECT mu.doc, i, j, similarity, abs(j - floor(i * m / n)) AS off FROM mu JOIN l ON l.doc = mu.doc AND l.a = mu.a JOIN r ON r.doc = mu.doc AND r.b = mu.b AND r.k = l.k JOIN na ON na.doc = mu.doc JOIN nb ON nb.doc = mu.doc)
SELECT doc, i, j, similarity FROM rs QUALIFY row_number() OVER (PARTITION BY doc, i ORDER BY off, j) = 1 AND row_number() OVER (PARTITION BY doc, j ORDER BY off, i) = 1""",
)
def content_alignment(spark, sf_dir):
    """Sentences of each document against those of a copy without every seventh."""
    s = segment.explode_sentences(documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text")).withColumnRenamed("sent_no", "no")
    b = s.filter("no % 7 <> 3").withColumn("no", F.row_number().over(Window.partitionBy("doc").orderBy("no")) - 1)
    return R.align_by_content(s, b)


@query("dif_01_positional_ops", f'WITH {_ED} SELECT id, i, "from", "to" FROM df')
def positional_ops(spark, sf_dir):
    return R.positional_ops(edited(spark, sf_dir)).select("id", "i", "from", "to")


@query("dif_01_diff_ops")
def diff_ops(spark, sf_dir):
    d = R.diff_ops(tokens(spark, sf_dir))
    return d.select("id", F.size("ops").alias("n_ops"), F.round("ratio", 6).alias("ratio"), F.to_json("ops").alias("ops"))


@query("dif_02_substitutions", f'WITH {_ED} SELECT "from", "to", count(*) AS n, min(id) AS example FROM df GROUP BY "from", "to"')
def substitutions(spark, sf_dir):
    return R.positional_ops(edited(spark, sf_dir)).groupBy("from", "to").agg(F.count("*").alias("n"), F.min("id").alias("example"))


@query(
    "dif_03_mined",
    f"""WITH {_ED}, ru AS (SELECT id, i - row_number() OVER (PARTITION BY id ORDER BY i) AS k, i, "from" AS x, "to" AS y FROM df), rn AS (SELECT id, count(*) AS k, string_agg(x, ' ' ORDER BY i) AS x, string_agg(y, ' ' ORDER BY i) AS y FROM ru GROUP BY id, k),
sn AS (SELECT id, sum(k) AS gone, count(*) AS ops FROM rn GROUP BY id), g AS (SELECT x, y, count(*) AS n, round(avg((2 * len(ta) - 2 * gone) / (2 * len(ta))), 6) AS mean_ratio, round(avg(CASE WHEN ops = 1 THEN 1 ELSE 0 END), 6) AS isolated FROM rn JOIN sn USING (id) JOIN ed USING (id) WHERE k <= 4 GROUP BY x, y),
r AS (SELECT *, CASE WHEN ends_with(x, 'tion') AND ends_with(y, 'cio') AND left(x, -4) = left(y, -3) THEN 1 WHEN ends_with(x, 'ion') AND ends_with(y, 'io') AND left(x, -3) = left(y, -2) THEN 2 END AS rule FROM g)
SELECT x AS "from", y AS "to", n, mean_ratio, isolated, rule, CASE WHEN x = 'the' AND y = 'le' THEN 'known' WHEN rule IS NOT NULL THEN 'rule' ELSE 'new' END AS kind FROM r""",
)
def mined(spark, sf_dir):
    subs = R.substitutions(R.diff_ops(edited(spark, sf_dir)))
    known = small(spark, [("the", "le")], "src string, dst string")
    rules = small(spark, [("tion", "cio", 1), ("ion", "io", 2)], "cut string, put string, number int")
    return R.mined(subs, known, rules)


@query("dif_05_context", f"WITH {_ED} SELECT id, i, array_to_string(ed.ta[greatest(1, i - 1):i + 3], ' ') AS context FROM df JOIN ed USING (id)")
def context(spark, sf_dir):
    e = edited(spark, sf_dir)
    d = e.withColumn("p", F.explode(F.filter(F.transform(F.arrays_zip("ta", "tb"), lambda x, i: F.struct(i.alias("i"), (x["ta"] != x["tb"]).alias("d"))), lambda x: x["d"])))
    i = F.col("p.i")
    return d.select("id", i.alias("i"), F.array_join(F.slice("ta", F.greatest(F.lit(1), i - 1), F.least(i, F.lit(2)) + F.when(i == 0, 3).when(i == 1, 3).otherwise(3)), " ").alias("context"))


@query("jon_15_explained", f"""WITH {_ED}, g AS (SELECT "from" AS f, "to" AS t, count(*) AS n FROM df GROUP BY ALL) SELECT f AS "from", t AS "to", n, CASE WHEN f = 'the' THEN 'known' WHEN ends_with(f, 'tion') THEN 'rule' ELSE 'new' END AS kind FROM g""")
def explained(spark, sf_dir):
    s = R.positional_ops(edited(spark, sf_dir)).withColumn("ratio", F.lit(1.0)).withColumn("ops", F.array(F.lit(1)))
    known = small(spark, [("the", "le")], "src string, dst string")
    rules = small(spark, [("tion", "cio", 1)], "cut string, put string, number int")
    return R.mined(s, known, rules).select("from", "to", "n", "kind")


@query("prd_13_structural", f"WITH {_ED}, g AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM df), h AS (SELECT id, i - r AS k, count(*) AS n FROM g GROUP BY id, k) SELECT id, max(n) <= 2 AS structural FROM h GROUP BY id")
def structural(spark, sf_dir):
    # Pairs that are the same have no operations.
    d = R.diff_ops(edited(spark, sf_dir).filter(F.col("ta") != F.col("tb")))
    return d.select("id", R.structural(F.col("ops")).alias("structural"))


@query("prd_14_strict_pairs", f"""WITH {_ED} SELECT id, bool_and("from" = 'the' OR "from" = 'of') AS strict FROM df GROUP BY id""")
def strict_pairs(spark, sf_dir):
    lexicon = small(spark, [("the", "le"), ("of", "de")], "src string, dst string")
    return R.explained(R.positional_ops(edited(spark, sf_dir)), "id", lexicon)


@query("jon_16_phenomena", f"WITH {_ED} SELECT DISTINCT id, CASE WHEN list_contains(ta, 'the') THEN 'article' END AS label FROM ed WHERE list_contains(ta, 'the') AND NOT list_contains(tb, 'the') UNION SELECT id, 'preposition' FROM ed WHERE list_contains(ta, 'of') AND NOT list_contains(tb, 'of')")
def phenomena(spark, sf_dir):
    e = edited(spark, sf_dir).select("id", F.array_join("ta", " ").alias("a"), F.array_join("tb", " ").alias("b"))
    lexicon = small(spark, [("the", "le", "article"), ("of", "de", "preposition")], "src string, dst string, label string")
    return R.phenomena(e, lexicon)


@query("jon_17_text_phenomena", f"WITH {_ED} SELECT DISTINCT id, 'article' AS label FROM ed WHERE list_contains(ta, 'the') UNION SELECT id, 'preposition' FROM ed WHERE list_contains(ta, 'of')")
def text_phenomena(spark, sf_dir):
    lexicon = small(spark, [("the", "article"), ("of", "preposition")], "form string, label string")
    return edited(spark, sf_dir).select("id", F.explode("ta").alias("form")).join(lexicon, "form").select("id", "label").distinct()


@query("jon_23_confirmed", f"WITH {_ED} SELECT DISTINCT id, 'the' AS form, 'le' AS put FROM ed WHERE list_contains(ta, 'the') AND NOT list_contains(ta, 'le')")
def confirmed(spark, sf_dir):
    e = edited(spark, sf_dir)
    grams = lambda c: e.select("id", F.explode(F.array_distinct(c)).alias("gram"))
    proposals = grams("ta").filter("gram = 'the'").select("id", F.col("gram").alias("form"), F.lit("le").alias("put"))
    return R.confirmed(proposals, grams("ta"), grams("tb"))


@query(
    "agg_17_alignment_quality",
    f"WITH {sql.PAIR}, {_TK}, s AS (SELECT id // 1000000000 AS doc, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) ELSE 0.0 END AS s FROM tk) SELECT least(floor(s * 10), 9)::BIGINT AS decile, count(*) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median FROM s GROUP BY decile",
)
def alignment_quality(spark, sf_dir):
    s = tokens(spark, sf_dir).select(P.jaccard(F.col("ta"), F.col("tb")).alias("s"))
    return s.groupBy(F.least(F.floor(F.col("s") * 10), F.lit(9)).alias("decile")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.percentile("s", 0.5), 6).alias("median"))


@query("agg_29_rule_outcome", f"""WITH {_ED}, t AS (SELECT x, y FROM po WHERE x IN ('the', 'of', 'and') OR ends_with(x, 'tion')) SELECT CASE WHEN ends_with(x, 'tion') THEN 'tion' ELSE x END AS rule, CASE WHEN x = y THEN 'kept' ELSE 'changed' END AS outcome, count(*) AS n FROM t GROUP BY ALL""")
def rule_outcome(spark, sf_dir):
    p = edited(spark, sf_dir).select(F.explode(F.arrays_zip("ta", "tb")).alias("p")).select("p.ta", "p.tb")
    rule = F.when(F.col("ta").endswith("tion"), "tion").when(F.col("ta").isin("the", "of", "and"), F.col("ta"))
    return p.select(rule.alias("rule"), F.when(F.col("ta") == F.col("tb"), "kept").otherwise("changed").alias("outcome")).filter("rule is not null").groupBy("rule", "outcome").agg(F.count("*").alias("n"))


@query("agg_32_suspicion_report", f"WITH {sql.PAIR}, f AS (SELECT unnest([CASE WHEN length(b) / greatest(length(a), 1) < 0.5 OR length(b) / greatest(length(a), 1) > 1.8 THEN 'length' END, CASE WHEN trim(lower(a)) = trim(lower(b)) THEN 'untranslated' END]) AS flag FROM pair) SELECT flag, count(*) AS n FROM f WHERE flag IS NOT NULL GROUP BY flag")
def suspicion_report(spark, sf_dir):
    f = turn_pairs(spark, sf_dir).select(F.explode(P.suspicions(F.col("a"), F.col("b"), [], [], ["translation:"])).alias("flag"))
    return f.groupBy("flag").agg(F.count("*").alias("n"))
