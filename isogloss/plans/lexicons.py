"""Queries of lexicon tables, mined from the documents: pairs of neighbouring tokens stand for entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicon as L
from . import sql
from .common import documents, sentences
from .registry import query


def pairs(spark, sf_dir):
    """src, dst, category, canonical, seq, place, topic, source: all neighbouring tokens of all sentences; seq is document, sentence and place, and place the same as one number."""
    s = sentences(spark, sf_dir).select("doc_id", "lang", "source", "sent_no", T.tokens(F.col("text")).alias("t"))
    both = F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    e = s.filter(F.size("t") >= 2).select("doc_id", "lang", "source", "sent_no", F.posexplode(both).alias("k", "p"))
    # Sentence and place are below 2^31, so the product holds for any doc_id and keeps the order.
    place = F.col("doc_id").cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + (F.shiftleft(F.col("sent_no").cast("long"), 31) + F.col("k")).cast("decimal(19,0)")
    return e.select("p.src", "p.dst", F.when(F.col("doc_id") % 3 == 0, "n").otherwise("v").alias("category"), (F.col("doc_id") % 5 == 0).alias("canonical"), F.struct("doc_id", "sent_no", "k").alias("seq"), place.alias("place"), F.col("lang").alias("topic"), "source")


P = f"""{sql.SENT}, w AS (SELECT doc_id, lang, source, sent_no, {sql.tokens('text')} AS t FROM sent), e AS (SELECT doc_id, lang, source, sent_no, unnest(range(0, len(t) - 1)) AS k, unnest(t[1:len(t) - 1]) AS src, unnest(t[2:]) AS dst FROM w WHERE len(t) >= 2),
p AS (SELECT src, dst, CASE WHEN doc_id % 3 = 0 THEN 'n' ELSE 'v' END AS category, doc_id % 5 = 0 AS canonical, {{'doc_id': doc_id, 'sent_no': sent_no, 'k': k}} AS seq, lang AS topic, source FROM e)"""
_INV = "SELECT dst, CASE WHEN count(DISTINCT src) = 1 THEN min(src) WHEN count(DISTINCT CASE WHEN canonical THEN src END) = 1 THEN min(CASE WHEN canonical THEN src END) END AS src FROM {} GROUP BY dst"


@query("lex_01_invert", f"WITH {P}, i AS ({_INV.format('p')}) SELECT * FROM i WHERE src IS NOT NULL")
def invert(spark, sf_dir):
    return L.invert(pairs(spark, sf_dir))


_FWD = "SELECT src, CASE WHEN count(DISTINCT CASE WHEN canonical THEN dst END) = 1 THEN min(CASE WHEN canonical THEN dst END) ELSE arg_min(dst, seq) END AS dst FROM p GROUP BY src"


@query("lex_02_forward", f"WITH {P} {_FWD}")
def forward(spark, sf_dir):
    return L.forward(pairs(spark, sf_dir))


@query("lex_03_lookup", f"WITH {P}, i AS ({_INV.format(chr(40) + 'SELECT * FROM p WHERE category = ' + sql.lit('v') + ' AND topic <> ' + sql.lit('es') + chr(41))}) SELECT src, dst, len(string_split(src, ' ')) AS words FROM i WHERE src IS NOT NULL AND src <> dst")
def lookup(spark, sf_dir):
    return L.lookup(pairs(spark, sf_dir), ["v"], ["es"])


@query("lex_04_one_to_one", f"WITH {P}, a AS (SELECT src FROM p GROUP BY src HAVING count(DISTINCT dst) = 1), b AS (SELECT dst FROM p GROUP BY dst HAVING count(DISTINCT src) = 1) SELECT src, dst, seq.doc_id AS doc_id, seq.sent_no AS sent_no, seq.k AS k FROM p JOIN a USING (src) JOIN b USING (dst)")
def one_to_one(spark, sf_dir):
    return L.one_to_one(pairs(spark, sf_dir)).select("src", "dst", "seq.doc_id", "seq.sent_no", "seq.k")


@query("lex_05_collided", f"WITH {P} SELECT DISTINCT src FROM p WHERE dst IN (SELECT dst FROM p GROUP BY dst HAVING count(DISTINCT src) > 1)")
def collided(spark, sf_dir):
    return L.collided(pairs(spark, sf_dir))


@query("lex_06_verb_collision", f"WITH {P} SELECT DISTINCT src, dst, (regexp_matches(src, 'en$') AND regexp_matches(dst, '[iï]n$')) OR src = dst || 'o' AS collides FROM p")
def verb_collision(spark, sf_dir):
    return pairs(spark, sf_dir).select("src", "dst", L.verb_collision(F.col("src"), F.col("dst")).alias("collides")).distinct()


@query("lex_09_neutral", f"WITH {P} SELECT DISTINCT src AS form FROM p WHERE src = dst")
def neutral(spark, sf_dir):
    return L.neutral(pairs(spark, sf_dir))


@query("lex_10_marker_index", f"WITH {P}, u AS (SELECT DISTINCT src AS form, 'occ' AS side FROM p UNION SELECT DISTINCT dst, 'or' FROM p), s AS (SELECT form, min(side) AS side FROM u GROUP BY form HAVING count(*) = 1) SELECT * FROM s WHERE form NOT IN (SELECT src FROM p WHERE src = dst)")
def marker_index(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return L.marker_index(p.select(F.col("src").alias("form")), p.select(F.col("dst").alias("form")), L.neutral(p))


@query("lex_11_homographs", f"WITH {P} SELECT src AS form, count(DISTINCT CASE WHEN category = 'n' THEN dst END) = 1 AS resolvable, CASE WHEN count(DISTINCT CASE WHEN category = 'n' THEN dst END) = 1 THEN min(CASE WHEN category = 'n' THEN dst END) END AS reading FROM p GROUP BY src HAVING count(DISTINCT dst) > 1")
def homographs(spark, sf_dir):
    r = pairs(spark, sf_dir).select(F.col("src").alias("form"), F.col("dst").alias("lemma"), F.col("category").alias("reading_category"), F.lit("n").alias("category"))
    return L.homographs(r)


@query("lex_12_noun_only", f"WITH {P} SELECT src AS form FROM p GROUP BY src HAVING count(*) = count(*) FILTER (WHERE category = 'n')")
def noun_only(spark, sf_dir):
    return L.noun_only(pairs(spark, sf_dir))


_ALT = "SELECT {k}, array_to_string(list(v ORDER BY s), ',') AS c, count(*) AS n FROM (SELECT {k}, {v} AS v, min(seq) AS s FROM p GROUP BY {k}, {v}) GROUP BY {k}"


@query("lex_13_ambiguity_points", f"WITH {P}, a AS ({_ALT.format(k='dst', v='src')}) SELECT dst, c AS candidates FROM a WHERE n > 1")
def ambiguity_points(spark, sf_dir):
    return L.ambiguity_points(pairs(spark, sf_dir), order="place").select("dst", F.array_join("candidates", ",").alias("candidates"))


@query("lex_14_candidate_forms", f"WITH {P} SELECT DISTINCT src AS form FROM p WHERE dst IN (SELECT dst FROM p GROUP BY dst HAVING count(DISTINCT src) > 1)")
def candidate_forms(spark, sf_dir):
    return L.forms_of_ambiguous(pairs(spark, sf_dir))


@query("lex_15_mood_pairs", f"WITH {P}, x AS (SELECT DISTINCT src, x.v AS dst FROM p, (SELECT unnest(['i', 'o']) AS s) y, LATERAL (SELECT dst || y.s AS v) x), g AS (SELECT src, list_sort(list(dst)) AS l FROM x GROUP BY src HAVING count(*) = 2) SELECT src, l[1] AS in_i, l[2] AS in_o FROM g")
def mood_pairs(spark, sf_dir):
    p = pairs(spark, sf_dir).select("src", F.explode(F.array(F.concat("dst", F.lit("i")), F.concat("dst", F.lit("o")))).alias("dst")).distinct()
    return L.mood_pairs(p)


@query("lex_16_flag_within_file", f"WITH {P} SELECT DISTINCT source, src AS form, (SELECT count(DISTINCT q.dst) FROM p q WHERE q.source = p.source AND q.src = p.src) > 1 AS ambiguous FROM p")
def flag_within_file(spark, sf_dir):
    e = pairs(spark, sf_dir).select("source", F.col("src").alias("form"), F.col("dst").alias("partner"))
    return L.flag_within_file(e).select("source", "form", "ambiguous").distinct()


@query("lex_17_merge_sources", f"WITH {P} SELECT src, dst, source FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY regexp_extract(source, '[0-9]+')::INT, seq) = 1")
def merge_sources(spark, sf_dir):
    e = pairs(spark, sf_dir).withColumn("priority", F.regexp_extract("source", "[0-9]+", 0).cast("int"))
    return L.merge_sources(e, ["src"]).select("src", "dst", "source")


@query("lex_18_difference", f"WITH {P}, o AS (SELECT src, dst FROM p WHERE topic IN ('en', 'fr')), n AS (SELECT src, dst FROM p WHERE topic IN ('en', 'de')) (SELECT *, 'added' AS change FROM (FROM n EXCEPT ALL FROM o)) UNION ALL (SELECT *, 'removed' FROM (FROM o EXCEPT ALL FROM n))")
def difference(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return L.difference(p.filter(F.col("topic").isin("en", "fr")).select("src", "dst"), p.filter(F.col("topic").isin("en", "de")).select("src", "dst"))


@query("lex_19_alternatives", f"WITH {P}, a AS ({_ALT.format(k='src', v='dst')}) SELECT src, c AS alternatives FROM a")
def alternatives(spark, sf_dir):
    return L.alternatives(pairs(spark, sf_dir), order="place").select("src", F.array_join("alternatives", ",").alias("alternatives"))


@query("lex_20_labels", f"WITH {P}, r(label, rank) AS (VALUES ('fr', 1), ('de', 2), ('en', 3), ('es', 4)) SELECT src, dst, arg_min(label, rank) AS label FROM p JOIN r ON topic = label GROUP BY src, dst")
def labels(spark, sf_dir):
    rank = spark.createDataFrame([("fr", 1), ("de", 2), ("en", 3), ("es", 4)], "label string, rank int")
    return L.labelled(pairs(spark, sf_dir).withColumn("label", F.col("topic")), rank)


@query("lex_21_sense_groups", f"WITH {P} SELECT DISTINCT src AS form, CASE WHEN regexp_matches(src, '.s$') THEN substr(src, 1, length(src) - 1) ELSE src END AS \"group\" FROM p")
def sense_groups(spark, sf_dir):
    points = pairs(spark, sf_dir).select(F.col("src").alias("form")).distinct()
    lemmas = points.filter(F.col("form").rlike(".s$")).select("form", F.expr("substring(form, 1, length(form) - 1)").alias("lemma"))
    return L.sense_groups(points, lemmas).select("form", "group")


@query("lex_22_clean_words", f"SELECT doc_id, len([x FOR x IN {sql.find('text', T.LETTERS)} IF NOT (length(x) <= 2 AND regexp_matches(x, '^\\p{{Ll}}+$'))]) AS kept FROM documents")
def clean_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(L.clean_words(T.matches(F.col("text"), T.LETTERS))).alias("kept"))


@query("lex_23_phrases", f"WITH {P}, x AS (SELECT src || ' ' || dst AS phrase FROM p UNION SELECT src FROM p) SELECT DISTINCT phrase, len(string_split(phrase, ' ')) AS words FROM x WHERE len(string_split(phrase, ' ')) >= 2")
def phrases(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return L.phrases_by_length(p.select(F.concat_ws(" ", "src", "dst").alias("phrase")).union(p.select("src")))


@query("lex_07_inverse_canonical", f"WITH {P}, q AS (SELECT dst, src, bool_or(canonical) AS c FROM p GROUP BY dst, src), k AS (SELECT *, bool_or(c) OVER (PARTITION BY dst) AS some_c FROM q) SELECT dst, string_agg(src, ',' ORDER BY src) AS partners FROM k WHERE c OR NOT some_c GROUP BY dst")
def inverse_canonical(spark, sf_dir):
    g = pairs(spark, sf_dir).groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("all"), F.array_sort(F.collect_set(F.when(F.col("canonical"), F.col("src")))).alias("canon"))
    return g.select("dst", F.array_join(F.when(F.size("canon") > 0, F.array_intersect("all", "canon")).otherwise(F.col("all")), ",").alias("partners"))


@query("lex_08_first_wins", f"WITH {P} SELECT src, arg_min(dst, seq) AS dst FROM p GROUP BY src")
def first_wins(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("src").agg(F.min_by("dst", "seq").alias("dst"))

