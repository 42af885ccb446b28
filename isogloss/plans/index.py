"""Queries of marker matching, the variety index and its reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import markers as M
from . import sql
from .common import documents, sentences, small
from .registry import query, table

#: A small lexicon of frequent tokens, half on each side.
FORMS = [("the", "occ"), ("of", "occ"), ("is", "occ"), ("la", "occ"), ("der", "occ"), ("el", "occ"), ("que", "occ"), ("nicht", "occ"), ("and", "or"), ("to", "or"), ("with", "or"), ("le", "or"), ("und", "or"), ("en", "or"), ("les", "or"), ("de", "or")]
PHRASES = [("of the", "occ"), ("in the", "or"), ("the and", "occ"), ("the", "occ"), ("de la", "or"), ("and the of", "or"), ("is to", "occ"), ("with the", "or")]


def forms(spark):
    return small(spark, FORMS, "form string, side string")


def phrases(spark):
    return small(spark, PHRASES, "phrase string, side string")


_V = ", ".join(f"({sql.lit(a)}, {sql.lit(b)})" for a, b in FORMS)
FORM_SQL = f"forms(form, side) AS (VALUES {_V})"
PHRASE_SQL = "phrases(phrase, side) AS (VALUES " + ", ".join(f"({sql.lit(a)}, {sql.lit(b)})" for a, b in PHRASES) + ")"
#: Token rows of documents and of sentences; counts per sentence (sc) and per document (dc).
DTOK = f"dt AS (SELECT doc_id, lang, source, t, unnest(t) AS form, generate_subscripts(t, 1) - 1 AS i FROM (SELECT doc_id, lang, source, {sql.tokens('text')} AS t FROM documents))"
_IN = {side: "(" + ", ".join(sql.lit(f) for f, s in FORMS if s == side) + ")" for side in ("occ", "or")}
SC = f"""{sql.SENT}, sc AS (SELECT doc_id, lang, source, sent_no, len(t)::BIGINT AS words, len([x FOR x IN t IF x IN {_IN['occ']}])::BIGINT AS occ, len([x FOR x IN t IF x IN {_IN['or']}])::BIGINT AS other, t
  FROM (SELECT doc_id, lang, source, sent_no, {sql.tokens('text')} AS t FROM sent))"""
DC = "dc AS (SELECT doc_id, lang, source, sum(words)::BIGINT AS words, sum(occ)::BIGINT AS occ, sum(other)::BIGINT AS other FROM sc GROUP BY ALL)"
_INDEX = "CASE WHEN occ + other > 0 THEN occ / (occ + other) END"
KEYS = ["doc_id", "lang", "source", "sent_no"]


def sentence_counts(spark, sf_dir):
    return M.counted(sentences(spark, sf_dir), KEYS, forms(spark))


def document_counts(spark, sf_dir):
    return M.counted(documents(spark, sf_dir), ["doc_id", "lang", "source"], forms(spark))


@query("jon_01_marker_tokens", f"WITH {DTOK}, {FORM_SQL} SELECT form, side, count(*) AS n FROM dt JOIN forms USING (form) GROUP BY form, side")
def marker_tokens(spark, sf_dir):
    return M.matched(M.token_rows(documents(spark, sf_dir), ["doc_id"]), forms(spark)).filter("side is not null").groupBy("form", "side").agg(F.count("*").alias("n"))


@query(
    "agg_01_text_index",
    f"""WITH {SC} SELECT doc_id, sent_no, words, occ, other, {_INDEX} AS index, array_to_string([x FOR x IN t IF x IN {_IN['occ']}], ' ') AS occ_markers, array_to_string([x FOR x IN t IF x IN {_IN['or']}], ' ') AS other_markers FROM sc""",
)
def text_index(spark, sf_dir):
    s = M.scored(sentences(spark, sf_dir), ["doc_id", "sent_no"], forms(spark))
    return s.select("doc_id", "sent_no", "words", "occ", "other", "index", F.array_join("occ_markers", " ").alias("occ_markers"), F.array_join("other_markers", " ").alias("other_markers"))


@query("agg_02_shares", f"WITH {SC}, {DC} SELECT doc_id, CASE WHEN words > 0 THEN 1 - other / words ELSE 1.0 END AS gdv, CASE WHEN words > 0 THEN 1 - occ / words ELSE 1.0 END AS gdc FROM dc")
def shares(spark, sf_dir):
    c = document_counts(spark, sf_dir)
    return c.select("doc_id", M.share(F.col("other"), F.col("words")).alias("gdv"), M.share(F.col("occ"), F.col("words")).alias("gdc"))


@query(
    "agg_03_corpus_index",
    f"""WITH {SC} SELECT lang, source, count(*) AS texts, sum(words)::BIGINT AS words, sum(occ)::BIGINT AS occ, sum(other)::BIGINT AS other, round(sum(CASE WHEN occ + other > 0 THEN occ * 1000000000 // (occ + other) END)::DOUBLE / count(CASE WHEN occ + other > 0 THEN 1 END) / 1e9, 6) AS mean_index,
  CASE WHEN sum(occ) + sum(other) > 0 THEN sum(occ) / (sum(occ) + sum(other)) END AS index, CASE WHEN sum(words) > 0 THEN 1 - sum(other) / sum(words) END AS gdv, CASE WHEN sum(words) > 0 THEN 1 - sum(occ) / sum(words) END AS gdc
  FROM sc WHERE words >= 3 GROUP BY lang, source""",
)
def corpus_index(spark, sf_dir):
    """Sentences of three words or more, scored and summed by language and source."""
    return M.corpus_index(sentence_counts(spark, sf_dir).filter("words >= 3"), "lang", "source")


@query("agg_04_document_rollup", f"WITH {SC}, {DC} SELECT doc_id, words, occ, other, {_INDEX} AS index FROM dc")
def document_rollup(spark, sf_dir):
    c = sentence_counts(spark, sf_dir).groupBy("doc_id").agg(*[F.sum(x).alias(x) for x in ("words", "occ", "other")])
    return c.withColumn("index", M.index(F.col("occ"), F.col("other")))


@query(
    "agg_05_profile",
    f"""WITH d AS (SELECT lang, source, least(floor(n_chars / 2000.0), 9)::BIGINT AS bucket, len({sql.sentences('text')}) AS s, len({sql.tokens('text')}) AS w FROM documents)
SELECT lang, source, bucket, count(*) AS docs, sum(s)::BIGINT AS sentences, sum(w)::BIGINT AS words FROM d GROUP BY GROUPING SETS ((lang), (source), (bucket), ())""",
)
def profile(spark, sf_dir):
    from ..functions import segment

    d = table(spark, sf_dir, "documents").select("lang", "source", F.least(F.floor(F.col("n_chars") / 2000.0), F.lit(9)).alias("bucket"), F.size(segment.sentences(F.col("text"))).alias("s"), F.size(T.tokens(F.col("text"))).alias("w"))
    return d.groupingSets([["lang"], ["source"], ["bucket"], []], "lang", "source", "bucket").agg(F.count("*").alias("docs"), F.sum("s").alias("sentences"), F.sum("w").alias("words"))


_BAND = "CASE WHEN ix IS NULL THEN 'none' WHEN ix = 0 THEN '0' WHEN ix < 0.25 THEN '0-0.25' WHEN ix < 0.5 THEN '0.25-0.5' WHEN ix < 0.75 THEN '0.5-0.75' WHEN ix < 1 THEN '0.75-1' ELSE '1' END"


@query(
    "agg_06_subsets",
    f"""WITH {SC}, x AS (SELECT *, {_INDEX} AS ix, unnest(CASE WHEN words >= 8 AND occ + other >= 2 THEN ['all', 'long', 'marked'] WHEN words >= 8 THEN ['all', 'long'] WHEN occ + other >= 2 THEN ['all', 'marked'] ELSE ['all'] END) AS subset FROM sc)
SELECT subset, {_BAND} AS band, count(*) AS n, count(*) FILTER (WHERE ix = 1 AND occ >= 2) AS pure FROM x GROUP BY subset, band""",
)
def subsets(spark, sf_dir):
    c = sentence_counts(spark, sf_dir).withColumn("ix", M.index(F.col("occ"), F.col("other")))
    labels = F.filter(F.array(F.lit("all"), F.when(F.col("words") >= 8, "long"), F.when(F.col("occ") + F.col("other") >= 2, "marked")), lambda x: x.isNotNull())
    return c.withColumn("subset", F.explode(labels)).groupBy("subset", P.band(F.col("ix")).alias("band")).agg(F.count("*").alias("n"), F.count_if((F.col("ix") == 1) & (F.col("occ") >= 2)).alias("pure"))


@query(
    "agg_07_top_sources",
    f"WITH {SC}, g AS (SELECT source, sum(occ)::BIGINT AS occ, sum(other)::BIGINT AS other FROM sc GROUP BY source) SELECT source, occ, other, occ / (occ + other) AS index FROM g WHERE occ + other >= 100 ORDER BY occ / (occ + other) DESC, occ + other DESC, source LIMIT 15",
)
def top_sources(spark, sf_dir):
    g = document_counts(spark, sf_dir).groupBy("source").agg(F.sum("occ").alias("occ"), F.sum("other").alias("other")).filter("occ + other >= 100")
    return g.withColumn("index", M.index(F.col("occ"), F.col("other"))).orderBy(F.desc("index"), F.desc(F.col("occ") + F.col("other")), "source").limit(15)


@query("agg_07_tld", r"WITH d AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*\.([^./?#:]+)', 1) AS tld FROM pages) SELECT tld, count(*) AS pages FROM d GROUP BY tld ORDER BY pages DESC, tld LIMIT 15")
def by_tld(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.tld(F.expr("parse_url(url, 'HOST')")).alias("tld")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "tld").limit(15)


@query("agg_08_marker_frequency", f"WITH {DTOK}, {FORM_SQL} SELECT form, count(*) AS n FROM dt JOIN forms USING (form) WHERE side = 'occ' GROUP BY form ORDER BY n DESC, form LIMIT 60")
def marker_frequency(spark, sf_dir):
    hits = M.matched(M.token_rows(documents(spark, sf_dir), ["doc_id"]), forms(spark)).filter("side = 'occ'")
    return hits.groupBy("form").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form").limit(60)


_GRAMS = f"""tk AS (SELECT doc_id, lang, {sql.tokens('text')} AS t FROM documents), nn AS (SELECT *, unnest([1, 2, 3]) AS n FROM tk),
gr AS (SELECT doc_id, lang, n, unnest([array_to_string(t[i:i + n - 1], ' ') FOR i IN range(1, len(t) - n + 2)]) AS phrase, unnest(range(0, len(t) - n + 1)) AS i FROM nn WHERE len(t) >= n)"""


@query("jon_02_phrase_hits", f"WITH {_GRAMS}, {PHRASE_SQL} SELECT doc_id, phrase, side, count(*) AS n FROM gr JOIN phrases USING (phrase) GROUP BY doc_id, phrase, side")
def phrase_hits(spark, sf_dir):
    return M.phrase_hits(documents(spark, sf_dir), ["doc_id"], phrases(spark)).groupBy("doc_id", "phrase", "side").agg(F.count("*").alias("n"))


@query(
    "jon_03_longest_hits",
    f"""WITH {PHRASE_SQL}, ph AS (SELECT *, string_split(phrase, ' ')[1] AS head, len(string_split(phrase, ' ')) AS n FROM phrases), pl AS (SELECT doc_id, unnest([{{'i': i, 'g': t[i:i + 2]}} FOR i IN range(1, len(t) + 1)]) AS p FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)),
ht AS (SELECT doc_id, p.i AS i, n, phrase, side, max(n) OVER (PARTITION BY doc_id, p.i) AS most FROM pl JOIN ph ON p.g[1] = head WHERE array_to_string(p.g[1:n], ' ') = phrase), bs AS (SELECT * FROM ht WHERE n = most),
st AS (SELECT doc_id, list_sort(list(DISTINCT {{'i': i, 'n': n, 'kept': []::BIGINT[]}})) AS s FROM bs GROUP BY doc_id),
kp AS (SELECT doc_id, unnest(list_reduce(s, lambda a, x: CASE WHEN x.i >= a.i THEN {{'i': x.i + x.n, 'n': 0, 'kept': list_append(a.kept, x.i)}} ELSE a END, {{'i': 0, 'n': 0, 'kept': []::BIGINT[]}}).kept) AS i FROM st)
SELECT doc_id, phrase, side, count(*) AS n FROM bs JOIN kp USING (doc_id, i) GROUP BY doc_id, phrase, side""",
)
def longest_hits(spark, sf_dir):
    hits = M.phrase_hits(documents(spark, sf_dir), ["doc_id"], phrases(spark))
    return M.longest_hits(hits, ["doc_id"]).groupBy("doc_id", "phrase", "side").agg(F.count("*").alias("n"))


@query("agg_09_lexicon_usage", f"WITH {_GRAMS}, {PHRASE_SQL} SELECT phrase, count(*) AS n_all, count(*) FILTER (WHERE lang = 'en') AS n_good FROM gr JOIN phrases USING (phrase) GROUP BY phrase")
def lexicon_usage(spark, sf_dir):
    return M.phrase_hits(documents(spark, sf_dir), ["doc_id", "lang"], phrases(spark), 3).groupBy("phrase").agg(F.count("*").alias("n_all"), F.count_if(F.col("lang") == "en").alias("n_good"))


#: Forms of FORMS that are words of both sides.
HOMOGRAPHS = ["de", "le", "en"]
_SURE = "(" + ", ".join(sql.lit(f) for f, s in FORMS if s == "or" and f not in HOMOGRAPHS) + ")"


@query(
    "prd_15_prefilter",
    f"WITH {SC}, b AS (SELECT doc_id, lang, source, sent_no, occ, len([x FOR x IN t IF x IN {_SURE}]) AS least FROM sc) SELECT doc_id, sent_no FROM b WHERE occ >= 1 AND occ / (occ + least) > 0.4",
)
def prefilter(spark, sf_dir):
    both = small(spark, [(f,) for f in HOMOGRAPHS], "form string")
    return M.could_pass(sentences(spark, sf_dir), KEYS, forms(spark), both, over=0.4).select("doc_id", "sent_no")


@query("prd_16_index_filter", f"WITH {SC} SELECT doc_id, sent_no, occ > 0 AS western FROM sc WHERE (occ >= 2 AND {_INDEX} > 0.8) OR ({_INDEX} = 0 AND other >= 2)")
def index_filter(spark, sf_dir):
    c = sentence_counts(spark, sf_dir).withColumn("ix", M.index(F.col("occ"), F.col("other")))
    return c.filter("(occ >= 2 and ix > 0.8) or (ix = 0 and other >= 2)").select("doc_id", "sent_no", (F.col("occ") > 0).alias("western"))


@query(
    "prd_18_proper_nouns",
    f"""WITH t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {sql.find('text', T.LETTERS)} AS w FROM documents)) SELECT w, count(*) AS n FROM t WHERE i > 1 AND regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}+$') GROUP BY w HAVING count(*) > 3""",
)
def proper_nouns(spark, sf_dir):
    w = documents(spark, sf_dir).select("doc_id", F.posexplode(T.matches(F.col("text"), T.LETTERS)).alias("i", "w"))
    return w.filter((F.col("i") > 0) & F.col("w").rlike(r"^\p{Lu}\p{Ll}+$")).groupBy("w").agg(F.count("*").alias("n")).filter("n > 3")


@query(
    "agg_10_token_cube",
    f"WITH {DTOK} SELECT lang, source, count(*) AS tokens, count(DISTINCT form) AS vocabulary FROM dt GROUP BY GROUPING SETS ((lang), (lang, source))",
)
def token_cube(spark, sf_dir):
    t = documents(spark, sf_dir).select("lang", "source", F.explode(T.tokens(F.col("text"))).alias("form"))
    each = t.groupBy("lang", "source", "form").agg(F.count("*").alias("n"))  # distinct counts on what is left
    fine = each.groupBy("lang", "source").agg(F.sum("n").alias("tokens"), F.count("*").alias("vocabulary"))
    by_lang = each.groupBy("lang", "form").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("vocabulary"))
    return fine.unionByName(by_lang.withColumn("source", F.lit(None).cast("string")))


@query("agg_11_form_sums", f"WITH {DTOK}, {FORM_SQL} SELECT side, count(*) AS n, count(DISTINCT form) AS kinds FROM dt JOIN forms USING (form) GROUP BY side")
def form_sums(spark, sf_dir):
    n = M.matched(M.token_rows(documents(spark, sf_dir), ["doc_id"]), forms(spark)).filter("side is not null").groupBy("side", "form").agg(F.count("*").alias("n"))
    return n.groupBy("side").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


#: Pairs of forms, the first proper to sources with an even number, the second to others.
USAGE = [("the", "of"), ("is", "to"), ("la", "le"), ("der", "und")]


@query(
    "agg_12_usage_matrix",
    f"WITH {DTOK}, p(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in USAGE) + """), e AS (SELECT a, b, form, lang = 'en' AS own, count(*) AS n FROM dt JOIN p ON form IN (a, b) GROUP BY ALL),
m AS (SELECT a, b, coalesce(sum(CASE WHEN own AND form = a THEN n END), 0)::BIGINT AS own_a, coalesce(sum(CASE WHEN own AND form = b THEN n END), 0)::BIGINT AS own_b, coalesce(sum(CASE WHEN NOT own AND form = a THEN n END), 0)::BIGINT AS other_a, coalesce(sum(CASE WHEN NOT own AND form = b THEN n END), 0)::BIGINT AS other_b FROM e GROUP BY a, b)
SELECT *, round(CASE WHEN own_a + own_b > 0 THEN 100.0 * own_a / (own_a + own_b) END, 6) AS fidelity FROM m""",
)
def usage_matrix(spark, sf_dir):
    p = small(spark, USAGE, "a string, b string").select("a", "b", F.explode(F.array("a", "b")).alias("form"))
    n = documents(spark, sf_dir).select((F.col("lang") == "en").alias("own"), F.explode(T.tokens(F.col("text"))).alias("form")).groupBy("own", "form").agg(F.count("*").alias("n"))
    cell = lambda own, side: F.coalesce(F.sum(F.when((F.col("own") == F.lit(own)) & (F.col("form") == F.col(side)), F.col("n"))), F.lit(0))
    m = n.join(p, "form").groupBy("a", "b").agg(cell(True, "a").alias("own_a"), cell(True, "b").alias("own_b"), cell(False, "a").alias("other_a"), cell(False, "b").alias("other_b"))
    return m.withColumn("fidelity", F.round(F.when(F.col("own_a") + F.col("own_b") > 0, 100.0 * F.col("own_a") / (F.col("own_a") + F.col("own_b"))), 6))


@query("agg_14_suffix_usage", f"WITH {DTOK}, r(suffix) AS (VALUES ('tion'), ('ing'), ('eau'), ('heit')), n AS (SELECT form, count(*) AS n FROM dt GROUP BY form) SELECT suffix, sum(n)::BIGINT AS n, count(*) AS kinds FROM n JOIN r ON ends_with(form, suffix) GROUP BY suffix")
def suffix_usage(spark, sf_dir):
    rules = small(spark, [("tion",), ("ing",), ("eau",), ("heit",)], "suffix string")
    n = documents(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    ends = n.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.substring(F.col("form"), -k, k)))).filter(F.length("suffix") <= F.length("form")).distinct()
    return ends.join(rules, "suffix").groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


@query(
    "agg_15_yearly_share",
    f"WITH {DTOK}, y AS (SELECT 2000 + doc_id % 10 AS year, form FROM dt WHERE form IN ('the', 'of')) SELECT year, round(count(*) FILTER (WHERE form = 'the') / count(*), 6) AS share, count(*) AS n FROM y GROUP BY year",
)
def yearly_share(spark, sf_dir):
    t = documents(spark, sf_dir).select((2000 + F.col("doc_id") % 10).alias("year"), F.explode(T.tokens(F.col("text"))).alias("form")).filter(F.col("form").isin("the", "of"))
    return t.groupBy("year").agg(F.round(F.count_if(F.col("form") == "the") / F.count("*"), 6).alias("share"), F.count("*").alias("n"))


_CLASS = "CASE WHEN occ + other = 0 THEN 'undetermined' WHEN ix >= 0.75 THEN 'western' WHEN ix <= 0.25 THEN 'eastern' WHEN occ + other < 5 THEN 'assumed' ELSE 'mixed' END"


@query("agg_18_class_shares", f"WITH {SC}, {DC}, x AS (SELECT *, {_INDEX} AS ix FROM dc) SELECT {_CLASS} AS cls, count(*) AS docs, round(sum(words) / (SELECT sum(words) FROM dc), 6) AS token_share, round(avg(ix), 6) AS mean_index FROM x GROUP BY cls")
def class_shares(spark, sf_dir):
    x = classified(spark, sf_dir)
    g = x.groupBy("cls").agg(F.count("*").alias("docs"), F.sum("words").alias("w"), F.round(F.avg("ix"), 6).alias("mean_index"))
    return g.withColumn("token_share", F.round(F.col("w") / F.sum("w").over(Window.partitionBy()), 6)).drop("w")


def classified(spark, sf_dir):
    x = document_counts(spark, sf_dir).withColumn("ix", M.index(F.col("occ"), F.col("other")))
    n = F.col("occ") + F.col("other")
    return x.withColumn("cls", F.when(n == 0, "undetermined").when(F.col("ix") >= 0.75, "western").when(F.col("ix") <= 0.25, "eastern").when(n < 5, "assumed").otherwise("mixed"))


@query("agg_19_document_classes", f"WITH {SC}, {DC}, x AS (SELECT *, {_INDEX} AS ix FROM dc) SELECT doc_id, {_CLASS} AS cls FROM x")
def document_classes(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", "cls")


@query("jon_14_labelled_corpus", f"WITH {SC}, {DC}, x AS (SELECT *, {_INDEX} AS ix FROM dc) SELECT lang, count(*) AS docs, sum(words)::BIGINT AS words FROM x WHERE {_CLASS} IN ('western', 'eastern', 'mixed') GROUP BY lang")
def labelled_corpus(spark, sf_dir):
    labels = classified(spark, sf_dir).filter(F.col("cls").isin("western", "eastern", "mixed")).select("doc_id", "words")
    return documents(spark, sf_dir).select("doc_id", "lang").join(labels, "doc_id").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("words").alias("words"))


@query(
    "agg_20_collocations",
    f"""WITH {DTOK}, {FORM_SQL}, h AS (SELECT doc_id, i, form AS marker, t FROM dt JOIN forms USING (form)),
n AS (SELECT marker, unnest(list_concat(t[greatest(1, i - 2):i], t[i + 2:i + 4])) AS word FROM h),
c AS (SELECT marker, word, count(*) AS n FROM n WHERE word NOT IN ('the', 'of', 'and', 'to') GROUP BY marker, word)
SELECT marker, word, n FROM c QUALIFY row_number() OVER (PARTITION BY marker ORDER BY n DESC, word) <= 20""",
)
def collocations(spark, sf_dir):
    stop = small(spark, [("the",), ("of",), ("and",), ("to",)], "word string")
    return M.collocations(documents(spark, sf_dir), forms(spark), stop)


@query(
    "agg_21_new_markers",
    f"""WITH {DTOK}, n AS (SELECT form, count(*) FILTER (WHERE lang = 'en') AS n_in, count(*) AS n_all FROM dt GROUP BY form), t AS (SELECT count(*) FILTER (WHERE lang = 'en') AS t_in, count(*) AS t_all FROM dt)
SELECT form, n_in, n_all, (n_in * t_all) / (n_all * t_in) AS ratio FROM n, t WHERE n_in > 50 AND (n_in * t_all) / (n_all * t_in) > 1.5 ORDER BY ratio DESC, form LIMIT 100""",
)
def new_markers(spark, sf_dir):
    t = documents(spark, sf_dir).select("lang", F.explode(T.tokens(F.col("text"))).alias("form"))
    return M.new_markers(t, F.col("lang") == "en")


@query(
    "agg_22_concordance",
    f"""WITH {DTOK}, c AS (SELECT source, form, array_to_string(t[greatest(1, i - 1):i], ' ') AS left_context FROM dt WHERE form IN ('ti', 'sh', 'wh')), g AS (SELECT source, form, left_context, count(*) AS n FROM c GROUP BY ALL)
SELECT source, form, left_context, n FROM g QUALIFY row_number() OVER (PARTITION BY source, form ORDER BY n DESC, left_context) <= 12""",
)
def concordance(spark, sf_dir):
    terms = small(spark, [("ti",), ("sh",), ("wh",)], "form string")
    n = M.concordance(documents(spark, sf_dir), ["doc_id", "source"], terms).groupBy("source", "form", "left_context").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("source", "form").orderBy(F.desc("n"), "left_context"))).filter("r <= 12").drop("r")


@query("agg_23_term_index", f"WITH {SC}, h AS (SELECT DISTINCT doc_id, sent_no, unnest(t) AS form, {_INDEX} AS ix FROM sc) SELECT form, round(avg(ix), 6) AS mean_index, count(*) AS n FROM h WHERE form IN ('ti', 'sh', 'wh') GROUP BY form")
def term_index(spark, sf_dir):
    s = sentences(spark, sf_dir)
    hits = s.select("doc_id", "sent_no", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("form")).filter(F.col("form").isin("ti", "sh", "wh"))
    ix = M.counted(s, ["doc_id", "sent_no"], forms(spark)).select("doc_id", "sent_no", M.index(F.col("occ"), F.col("other")).alias("ix"))
    return hits.join(ix, ["doc_id", "sent_no"]).groupBy("form").agg(F.round(F.avg("ix"), 6).alias("mean_index"), F.count("*").alias("n"))


@query(
    "agg_24_western_profile",
    f"""WITH {SC}, w AS (SELECT * FROM sc WHERE occ >= 1 AND {_INDEX} >= 0.5), r AS (SELECT words, row_number() OVER (ORDER BY words) AS r, count(*) OVER () AS n FROM w)
SELECT count(*) AS sentences, count(*) FILTER (WHERE occ = 1) AS single, count(*) FILTER (WHERE other > 0) AS mixed, round(avg(words), 6) AS mean_words, (SELECT words FROM r WHERE r = floor(0.1 * n) + 1) AS p10, (SELECT words FROM r WHERE r = floor(0.5 * n) + 1) AS p50, count(DISTINCT source) AS sources FROM w""",
)
def western_profile(spark, sf_dir):
    w = sentence_counts(spark, sf_dir).filter((F.col("occ") >= 1) & (M.index(F.col("occ"), F.col("other")) >= 0.5))
    sizes = w.groupBy("words").agg(F.count("*").alias("k"))  # nearest ranks from counts, not from all rows in one order
    upto = sizes.withColumn("upto", F.sum("k").over(Window.orderBy("words"))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    rank = lambda p: F.min(F.when(F.col("upto") >= F.floor(p * F.col("n")) + 1, F.col("words")))
    p = upto.agg(rank(0.1).alias("p10"), rank(0.5).alias("p50"))
    return w.agg(F.count("*").alias("sentences"), F.count_if(F.col("occ") == 1).alias("single"), F.count_if(F.col("other") > 0).alias("mixed"), F.round(F.avg("words"), 6).alias("mean_words"), F.count_distinct("source").alias("sources")).crossJoin(p)


@query("agg_25_regex_counts", r"SELECT sum(len(regexp_extract_all(lower(text), '\bthe\b')))::BIGINT AS the, sum(len(regexp_extract_all(lower(text), '[a-z]{2,}tion[ .,]')))::BIGINT AS tion FROM documents")
def regex_counts(spark, sf_dir):
    t = F.lower("text")
    return documents(spark, sf_dir).agg(F.sum(F.regexp_count(t, F.lit(r"\bthe\b"))).alias("the"), F.sum(F.regexp_count(t, F.lit(r"[a-z]{2,}tion[ .,]"))).alias("tion"))


@query(
    "agg_26_repeats",
    f"WITH {sql.SENT}, k AS (SELECT {sql.repeat_text('text')} AS k FROM sent), g AS (SELECT k, count(*) AS n FROM k GROUP BY k) SELECT sum(n)::BIGINT AS sentences, count(*) AS uniques, sum(n - 1)::BIGINT AS repeated, (SELECT count(*) - count(DISTINCT text) FROM documents) AS repeated_docs FROM g",
)
def repeats(spark, sf_dir):
    g = sentences(spark, sf_dir).groupBy(T.repeat_text(F.col("text")).alias("k")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("sentences"), F.count("*").alias("uniques"), F.sum(F.col("n") - 1).alias("repeated"))
    d = documents(spark, sf_dir).groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_docs"))
    return g.crossJoin(d)


_RK = sql.repeat_text("text")


@query(
    "agg_27_document_selection",
    f"""WITH {SC}, {DC}, keep AS (SELECT doc_id FROM dc WHERE {_INDEX} >= 0.5), k AS (SELECT doc_id, sent_no, {_RK} AS k FROM sent), lk AS (SELECT DISTINCT {_RK} AS k FROM (SELECT unnest({sql.sentences('text')}) AS text FROM benchmark)),
f AS (SELECT doc_id, sent_no FROM sc JOIN keep USING (doc_id) JOIN k USING (doc_id, sent_no) WHERE occ >= other AND words >= 5 AND k NOT IN (SELECT k FROM lk) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, sent_no) = 1) SELECT * FROM f""",
)
def document_selection(spark, sf_dir):
    """Sentences of leaning documents that lean so themselves, are no benchmark's and occur first; each different text is scored once."""
    from .selection import benchmark_keys

    k = T.repeat_text(F.col("text")).alias("k")
    s = sentences(spark, sf_dir).select("doc_id", "sent_no", "text", k)
    texts = s.select("text").distinct()
    c = s.join(M.counted(texts.withColumn("one", F.col("text")), ["one"], forms(spark)), F.col("text") == F.col("one")).drop("text", "one")
    keep = c.groupBy("doc_id").agg(F.sum("occ").alias("o"), F.sum("other").alias("e")).filter(M.index(F.col("o"), F.col("e")) >= 0.5)
    good = c.join(keep, "doc_id", "left_semi").filter("occ >= other and words >= 5").join(benchmark_keys(spark, sf_dir), "k", "left_anti")
    return good.groupBy("k").agg(F.min(F.struct("doc_id", "sent_no")).alias("m")).select("m.doc_id", "m.sent_no")


@query("agg_41_net_share", f"WITH {SC} SELECT round(count(*) FILTER (WHERE occ >= 2 AND {_INDEX} > 0.6) / count(*), 6) AS net, round(count(*) FILTER (WHERE occ + other = 1) / count(*), 6) AS single FROM sc WHERE words >= 8")
def net_share(spark, sf_dir):
    c = sentence_counts(spark, sf_dir).filter("words >= 8").withColumn("ix", M.index(F.col("occ"), F.col("other")))
    return c.agg(F.round(F.count_if((F.col("occ") >= 2) & (F.col("ix") > 0.6)) / F.count("*"), 6).alias("net"), F.round(F.count_if(F.col("occ") + F.col("other") == 1) / F.count("*"), 6).alias("single"))


#: Rules with a normative and another variant, each a form before a word of a kind.
RULES = [("article", "the", "a", "^[^aeiou]"), ("relative", "that", "which", "^[a-z]{2,3}$")]


@query(
    "agg_28_rule_compliance",
    f"""WITH {DTOK}, r(rule, good, bad, nxt) AS (VALUES ('article', 'the', 'a', '^[^aeiou]'), ('relative', 'that', 'which', '^[a-z]{{2,3}}$')), w AS (SELECT form, t[i + 2] AS after FROM dt), h AS (SELECT rule, form = good AS ok FROM w JOIN r ON form IN (good, bad) WHERE regexp_matches(after, nxt)) SELECT rule, count(*) AS n, round(count(*) FILTER (WHERE ok) / count(*), 6) AS share FROM h GROUP BY rule""",
)
def rule_compliance(spark, sf_dir):
    r = small(spark, RULES, "rule string, good string, bad string, next string")
    variants = r.select("rule", "next", F.explode(F.array(F.struct(F.col("good").alias("form"), F.lit(True).alias("ok")), F.struct(F.col("bad").alias("form"), F.lit(False).alias("ok")))).alias("v")).select("rule", "next", "v.*")
    t = documents(spark, sf_dir).select(T.tokens(F.col("text")).alias("t"))
    pairs = t.select(F.explode(F.transform("t", lambda x, i: F.struct(x.alias("form"), F.try_element_at("t", i + 2).alias("after")))).alias("p")).select("p.*")
    n = pairs.join(variants.select("form").distinct(), "form", "left_semi").groupBy("form", "after").agg(F.count("*").alias("n")).join(variants, "form").filter("after rlike next")
    return n.groupBy("rule").agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share"))


@query("agg_13_specific_forms", f"WITH {DTOK}, {FORM_SQL} SELECT form, count(*) FILTER (WHERE lang = 'en') AS own, count(*) FILTER (WHERE lang <> 'en') AS other FROM dt JOIN forms USING (form) WHERE side = 'or' GROUP BY form")
def specific_forms(spark, sf_dir):
    t = documents(spark, sf_dir).select("lang", F.explode(T.tokens(F.col("text"))).alias("form")).join(forms(spark).filter("side = 'or'"), "form")
    return t.groupBy("form").agg(F.count_if(F.col("lang") == "en").alias("own"), F.count_if(F.col("lang") != "en").alias("other"))


@query("agg_16_phrase_usage", f"WITH {_GRAMS}, {PHRASE_SQL} SELECT phrase, round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 6) AS fidelity, count(*) AS n FROM gr JOIN phrases USING (phrase) WHERE n >= 2 GROUP BY phrase")
def phrase_usage(spark, sf_dir):
    h = M.phrase_hits(documents(spark, sf_dir), ["doc_id", "lang"], phrases(spark), 3).filter("n >= 2")
    return h.groupBy("phrase").agg(F.round(100.0 * F.count_if(F.col("lang") == "en") / F.count("*"), 6).alias("fidelity"), F.count("*").alias("n"))
