"""Queries of joins between sets, keep-first, samples, splits and set operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import segment
from ..functions import text as T
from ..operators import markers as M
from ..operators import selection as S
from . import sql
from .common import documents, sentences, small
from .index import SC, forms, sentence_counts
from .registry import query, table

_RK = sql.repeat_text("text")


@query("win_01_keep_first", f"WITH {sql.SENT}, k AS (SELECT doc_id, sent_no, {_RK} AS k FROM sent) SELECT doc_id, sent_no FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, sent_no) = 1")
def keep_first(spark, sf_dir):
    s = sentences(spark, sf_dir).select(T.repeat_text(F.col("text")).alias("k"), "doc_id", "sent_no")
    return S.keep_first(s, ["k"], ["doc_id", "sent_no"]).select("doc_id", "sent_no")


@query("win_02_numbering", f"WITH {sql.SENT} SELECT doc_id, sent_no, doc_id || '.s' || sent_no AS id FROM sent")
def numbering(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "sent_no", F.concat(F.col("doc_id").cast("string"), F.lit(".s"), F.col("sent_no").cast("string")).alias("id"))


@query("win_03_at_most", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def at_most(spark, sf_dir):
    return S.at_most(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], 5, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "source")


@query("win_04_context", f"WITH {sql.SENT} SELECT doc_id, sent_no, length(lag(text) OVER w) AS prev_len, length(lead(text) OVER w) AS next_len FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY sent_no)")
def context(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("sent_no")
    s = sentences(spark, sf_dir).select("doc_id", "sent_no", F.length("text").alias("n"))
    return s.select("doc_id", "sent_no", F.lag("n").over(w).alias("prev_len"), F.lead("n").over(w).alias("next_len"))


@query(
    "win_05_split_by_document",
    f"""WITH {sql.SENT}, g AS (SELECT doc_id, count(*) AS n, md5('s:' || doc_id) AS h FROM sent GROUP BY doc_id), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, sum(n) OVER () AS total FROM g),
t AS (SELECT *, (SELECT coalesce(sum(n), 0) FROM c WHERE c.c < floor(total * 0.1)) AS n_test FROM c)
SELECT doc_id, sent_no, CASE WHEN c < floor(total * 0.1) THEN 'test' WHEN c - n_test < floor(total * 0.1) THEN 'dev' ELSE 'train' END AS split FROM sent JOIN t USING (doc_id)""",
)
def split_by_document(spark, sf_dir):
    return S.split_by_group(sentences(spark, sf_dir).select("doc_id", "sent_no"), "doc_id", "s", 0.1, 0.1).select("doc_id", "sent_no", "split")


@query(
    "win_06_balanced_split",
    "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('b:' || doc_id), doc_id) AS r FROM labels), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) SELECT doc_id, quality, CASE WHEN r <= 20 THEN 'valid' ELSE 'train' END AS split FROM r, m WHERE r <= n",
)
def balanced_split(spark, sf_dir):
    return S.balanced_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", "b", 20)


@query("smp_01_bernoulli", "SELECT doc_id FROM documents WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000000 < 250000")
def bernoulli(spark, sf_dir):
    return documents(spark, sf_dir).filter(S.bernoulli(F.col("doc_id"), 0.25)).select("doc_id")


@query("smp_02_dev_flag", "SELECT doc_id, (('0x' || substr(md5(text), 1, 16))::UBIGINT % 10 * 6 + ('0x' || substr(md5(text), 17, 16))::UBIGINT % 10) % 10 = 0 AS dev FROM documents")
def dev_flag(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", (S.md5_mod10(F.col("text")) == 0).alias("dev"))


@query("smp_03_shards", "SELECT ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 4 AS shard, count(*) AS n FROM documents GROUP BY shard")
def shards(spark, sf_dir):
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    return documents(spark, sf_dir).groupBy(F.pmod(h, F.lit(4)).alias("shard")).agg(F.count("*").alias("n"))


@query("smp_04_reservoir", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('r:' || doc_id), doc_id) <= 25")
def reservoir(spark, sf_dir):
    return S.at_most(documents(spark, sf_dir).select("doc_id", "lang"), ["lang"], 25, S.seeded("r", "doc_id"), F.col("doc_id"))


@query("smp_05_random_n", "SELECT doc_id FROM documents ORDER BY md5('n:' || doc_id), doc_id LIMIT 100")
def random_n(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id").orderBy(S.seeded("n", "doc_id"), "doc_id").limit(100)


@query(
    "smp_06_stratified",
    "WITH o AS (SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5('t:' || doc_id), doc_id) = 1) SELECT doc_id, lang, source FROM o QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('t:' || doc_id), doc_id) <= 10",
)
def stratified(spark, sf_dir):
    one = S.at_most(documents(spark, sf_dir).select("doc_id", "lang", "source"), ["lang", "source"], 1, S.seeded("t", "doc_id"), F.col("doc_id"))
    return S.at_most(one, ["lang"], 10, S.seeded("t", "doc_id"), F.col("doc_id"))


@query(
    "smp_07_rule_quota",
    f"""WITH d AS (SELECT doc_id, list_distinct({sql.tokens('text')}) AS t FROM documents), e AS (SELECT doc_id, unnest([x FOR x IN t IF x IN ('ti', 'sh', 'wh', 'the', 'of')]) AS rule FROM d),
f AS (SELECT rule, count(*) AS f FROM e GROUP BY rule), a AS (SELECT doc_id, rule FROM e JOIN f USING (rule) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY f, rule) = 1)
SELECT doc_id, rule FROM a QUALIFY row_number() OVER (PARTITION BY rule ORDER BY doc_id) <= 30""",
)
def rule_quota(spark, sf_dir):
    rules = F.array(*[F.lit(x) for x in ("ti", "sh", "wh", "the", "of")])
    e = documents(spark, sf_dir).select("doc_id", F.explode(F.array_intersect(rules, T.tokens(F.col("text")))).alias("rule"))
    f = e.groupBy("rule").agg(F.count("*").alias("f"))
    rarest = e.join(f, "rule").groupBy("doc_id").agg(F.min(F.struct("f", "rule")).alias("m")).select("doc_id", "m.rule")
    return S.at_most(rarest, ["rule"], 30, F.col("doc_id"))


@query("smp_08_coverage")
def coverage(spark, sf_dir):
    """Sentences that cover seven words, each with the word after it as a pair; two of a document and twenty of a source at most."""
    rules = F.array(*[F.lit(x) for x in ("ti", "sh", "wh", "the", "of", "est", "mi")])
    s = sentences(spark, sf_dir).select(F.concat_ws(":", F.col("doc_id").cast("string"), "sent_no").alias("id"), "doc_id", "source", T.tokens(F.col("text")).alias("t"))
    after = F.transform("t", lambda x, i: F.when(F.array_contains(rules, x), F.concat_ws(" ", x, F.try_element_at("t", i + 2))))
    pool = s.select("id", "doc_id", "source", F.array_intersect(rules, "t").alias("labels"), F.filter(after, lambda x: x.isNotNull()).alias("pairs")).filter(F.size("labels") > 0)
    return S.coverage(pool, "id", "labels", 60, 15, pairs="pairs", caps={"doc_id": 2, "source": 20})


@query("smp_09_hand_out", "SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1) % 2 AS reviewer FROM (SELECT doc_id, source FROM documents ORDER BY md5('h:' || doc_id), doc_id LIMIT 200)")
def hand_out(spark, sf_dir):
    pool = documents(spark, sf_dir).select("doc_id", "source").orderBy(S.seeded("h", "doc_id"), "doc_id").limit(200)
    return pool.select("doc_id", F.pmod(F.row_number().over(Window.orderBy("source", "doc_id")) - 1, F.lit(2)).cast("long").alias("reviewer"))


#: Sentences of the benchmark as keys, and sentences of documents outside it.
_LEAK = f"lk AS (SELECT DISTINCT {_RK} AS k FROM (SELECT unnest({sql.sentences('text')}) AS text FROM benchmark))"


def benchmark_keys(spark, sf_dir):
    return segment.explode_sentences(table(spark, sf_dir, "benchmark").select("text")).select(T.repeat_text(F.col("text")).alias("k")).distinct()


@query("smp_10_context_blocks", f"WITH {sql.SENT}, {_LEAK}, s AS (SELECT doc_id, sent_no, text, {sql.tokens('text')} AS t FROM sent WHERE {_RK} NOT IN (SELECT k FROM lk)), g AS (SELECT doc_id, sent_no, text, t FROM s WHERE len(t) BETWEEN 6 AND 30 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) <= 3), b AS (SELECT doc_id, string_agg(text, ' ' ORDER BY sent_no) AS block, sum(len(t)) AS n, bool_or(list_contains(t, 'of')) AS bad FROM g GROUP BY doc_id) SELECT doc_id, block FROM b WHERE n BETWEEN 30 AND 60 AND NOT bad")
def context_blocks(spark, sf_dir):
    s = sentences(spark, sf_dir).select("doc_id", "sent_no", "text", T.tokens(F.col("text")).alias("t"), T.repeat_text(F.col("text")).alias("k")).filter(F.size("t").between(6, 30))
    g = S.at_most(s.join(benchmark_keys(spark, sf_dir), "k", "left_anti"), ["doc_id"], 3, F.col("sent_no"))
    b = g.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "text"))), lambda x: x["text"]), " ").alias("block"), F.sum(F.size("t")).alias("n"), F.max(F.array_contains("t", "of")).alias("bad"))
    return b.filter(F.col("n").between(30, 60) & ~F.col("bad")).select("doc_id", "block")


@query("ord_01_top_k", f"WITH t AS (SELECT unnest({sql.tokens('text')}) AS form FROM documents) SELECT form, count(*) AS n FROM t GROUP BY form ORDER BY n DESC, form LIMIT 50")
def top_k(spark, sf_dir):
    return documents(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("form")).groupBy("form").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form").limit(50)


@query("ord_02_multi_key", "SELECT doc_id, source FROM documents ORDER BY CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, regexp_extract(source, '[0-9]+')::INT, doc_id LIMIT 80")
def multi_key(spark, sf_dir):
    rank = F.when(F.col("source") == "src3", 0).when(F.col("source") == "src1", 1).otherwise(2)
    return documents(spark, sf_dir).select("doc_id", "source").orderBy(rank, F.regexp_extract("source", "[0-9]+", 0).cast("int"), "doc_id").limit(80)


@query("set_01_union", "SELECT doc_id AS id, text, 'documents' AS origin FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark")
def union(spark, sf_dir):
    a = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("origin"))
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("origin")))


def _vocab(spark, sf_dir, lang):
    return documents(spark, sf_dir).filter(F.col("lang") == lang).select(F.explode(T.tokens(F.col("text"))).alias("form"))


_VOC = lambda lang: f"SELECT unnest({sql.tokens('text')}) AS form FROM documents WHERE lang = '{lang}'"


@query("set_02_intersection", f"({_VOC('en')}) INTERSECT ({_VOC('es')})")
def intersection(spark, sf_dir):
    return _vocab(spark, sf_dir, "en").intersect(_vocab(spark, sf_dir, "es"))


@query("set_03_difference", f"({_VOC('es')}) EXCEPT ({_VOC('fr')})")
def difference(spark, sf_dir):
    return _vocab(spark, sf_dir, "es").subtract(_vocab(spark, sf_dir, "fr"))


@query(
    "jon_04_document_match",
    "SELECT coalesce(c.doc_id, l.doc_id) AS id, c.doc_id IS NOT NULL AS in_a, l.doc_id IS NOT NULL AS in_b FROM documents c FULL JOIN labels l ON c.doc_id = l.doc_id",
)
def document_match(spark, sf_dir):
    a = documents(spark, sf_dir).select("doc_id", F.lit(True).alias("in_a"))
    b = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("in_b"))
    return a.join(b, "doc_id", "full_outer").select(F.col("doc_id").alias("id"), F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def word_sets(spark, sf_dir):
    return sentences(spark, sf_dir).select((F.col("doc_id") * 10_000_000 + F.col("sent_no")).alias("id"), "doc_id", T.word_set(F.col("text")).alias("words"))


def evaluation_items(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select((F.col("item_id") * 1_000_000_000).alias("item0"), F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("k", "text")).select((F.col("item0") + F.col("k")).alias("item"), T.word_set(F.col("text")).alias("words"))


_NEAR = f"""sw AS (SELECT doc_id * 10000000 + sent_no AS id, doc_id, list_sort(list_distinct({sql.bare('text')})) AS w FROM sent),
ew AS (SELECT item_id * 1000000000 + generate_subscripts(p, 1) - 1 AS item, unnest(p) AS text FROM (SELECT item_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM benchmark)),
iw AS (SELECT item, list_distinct({sql.bare('text')}) AS w FROM ew WHERE len(list_distinct({sql.bare('text')})) >= 4),
ex AS (SELECT item, len(w) AS n, unnest(w) AS word FROM iw), sx AS (SELECT id, len(w) AS n, unnest(w) AS word FROM sw WHERE len(w) >= 4),
sh AS (SELECT id, item, sx.n AS a, ex.n AS b, count(*) AS common FROM sx JOIN ex USING (word) WHERE sx.n >= 0.6 * ex.n AND ex.n >= 0.6 * sx.n GROUP BY ALL), nr AS (SELECT id, item, common / (a + b - common) AS jaccard FROM sh)"""


@query("jon_08_near_evaluation", f"WITH {sql.SENT}, {_NEAR} SELECT id, item, jaccard FROM nr WHERE jaccard >= 0.6")
def near_evaluation(spark, sf_dir):
    return S.near_evaluation(word_sets(spark, sf_dir), evaluation_items(spark, sf_dir), "id", "words")


@query("jon_12_banned_documents", f"WITH {sql.SENT}, {_NEAR} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id // 10000000 FROM nr WHERE jaccard >= 0.6)")
def banned_documents(spark, sf_dir):
    near = S.near_evaluation(word_sets(spark, sf_dir), evaluation_items(spark, sf_dir), "id", "words")
    return documents(spark, sf_dir).select("doc_id").join(near.select(F.expr("id div 10000000").alias("doc_id")).distinct(), "doc_id", "left_anti")


@query("jon_10_exact_leaks", f"WITH {sql.SENT} SELECT doc_id, sent_no FROM sent WHERE {_RK} NOT IN (SELECT {_RK} FROM (SELECT unnest({sql.sentences('text')}) AS text FROM benchmark))")
def exact_leaks(spark, sf_dir):
    keys = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r'(?<=[.!?])\s+(?=[«"“A-ZÀ-Ý])')).alias("text")).select(T.repeat_text(F.col("text")).alias("k")).distinct()
    s = sentences(spark, sf_dir).select("doc_id", "sent_no", T.repeat_text(F.col("text")).alias("k"))
    return s.join(keys, "k", "left_anti").select("doc_id", "sent_no")


@query("jon_11_pair_leaks", f"WITH {sql.PAIR} SELECT id FROM pair WHERE id % 10 <> 0 AND lower(trim(a)) || '|' || lower(trim(b)) NOT IN (SELECT lower(trim(a)) || '|' || lower(trim(b)) FROM pair WHERE id % 10 = 0)")
def pair_leaks(spark, sf_dir):
    from .common import turn_pairs

    p = turn_pairs(spark, sf_dir).select("id", F.lower(F.trim("a")).alias("ka"), F.lower(F.trim("b")).alias("kb"))
    test = F.col("id") % 10 == 0
    return p.filter(~test).join(p.filter(test).select("ka", "kb").distinct(), ["ka", "kb"], "left_anti").select("id")


@query("jon_13_net_documents", f"WITH {SC} SELECT doc_id, sent_no FROM sc WHERE doc_id IN (SELECT doc_id FROM sc WHERE occ >= 4)")
def net_documents(spark, sf_dir):
    c = sentence_counts(spark, sf_dir)
    return c.join(c.filter("occ >= 4").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "sent_no")


@query("jon_19_two_columns", f"WITH {sql.PAIR} SELECT id, len([x FOR x IN {sql.tokens('a')} IF x IN ('the', 'of', 'is', 'la', 'der', 'el', 'que', 'nicht')])::BIGINT AS occ_a, len([x FOR x IN {sql.tokens('b')} IF x IN ('the', 'of', 'is', 'la', 'der', 'el', 'que', 'nicht')])::BIGINT AS occ_b FROM pair")
def two_columns(spark, sf_dir):
    from .common import turn_pairs

    p = turn_pairs(spark, sf_dir)
    tall = p.select("id", F.explode(F.array(F.struct(F.lit("a").alias("side_col"), F.col("a").alias("text")), F.struct(F.lit("b").alias("side_col"), F.col("b").alias("text")))).alias("x")).select("id", "x.*")
    c = M.counted(tall, ["id", "side_col"], forms(spark))
    return c.groupBy("id").agg(F.max(F.when(F.col("side_col") == "a", F.col("occ"))).alias("occ_a"), F.max(F.when(F.col("side_col") == "b", F.col("occ"))).alias("occ_b"))


@query("jon_20_review_merge", "SELECT source, count(*) FILTER (WHERE l.quality = 1) AS valid, count(*) FILTER (WHERE l.quality IS NULL) AS pending, count(*) FILTER (WHERE l.quality = 0) AS rejected FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def review_merge(spark, sf_dir):
    q = F.col("quality")
    d = documents(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("source").agg(F.count_if(q == 1).alias("valid"), F.count_if(q.isNull()).alias("pending"), F.count_if(q == 0).alias("rejected"))


@query("jon_21_zero_filled", f"WITH f(form) AS (VALUES ('the'), ('of'), ('qqqq')), t AS (SELECT unnest({sql.tokens('text')}) AS form FROM documents), c AS (SELECT form, count(*) AS n FROM t GROUP BY form) SELECT form, coalesce(n, 0)::BIGINT AS n FROM f LEFT JOIN c USING (form)")
def zero_filled(spark, sf_dir):
    counts = documents(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    return S.zero_filled(small(spark, [("the",), ("of",), ("qqqq",)], "form string"), counts)


@query("jon_22_missing_forms", f"WITH b AS (SELECT DISTINCT unnest({sql.tokens('text')}) AS form FROM benchmark), t AS (SELECT DISTINCT lang, unnest({sql.tokens('text')}) AS form FROM documents), l AS (SELECT DISTINCT lang FROM t) SELECT l.lang, form FROM b, l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.form = b.form AND t.lang IS NOT DISTINCT FROM l.lang)")
def missing_forms(spark, sf_dir):
    """Forms of the benchmark that the documents of a language lack, for every language."""
    forms = documents(spark, sf_dir).select(F.struct("lang").alias("l"), F.explode(T.tokens(F.col("text"))).alias("form"))
    known = forms.distinct()
    b = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("form")).distinct()
    # A form has as many languages as there are at most; the list of all is one row.
    have = b.join(known, "form", "left").groupBy("form").agg(F.collect_set("l").alias("have"))
    every = known.agg(F.collect_set("l").alias("every"))
    return have.join(every).select("form", F.explode(F.array_except("every", "have")).alias("l")).select("l.lang", "form")


_REASON = "CASE WHEN words < 8 THEN 'short' WHEN words > 40 THEN 'long' WHEN occ + other = 0 THEN 'unmarked' WHEN occ < other THEN 'eastern' ELSE 'kept' END"


@query("agg_31_funnel", f"WITH {SC} SELECT source, {_REASON} AS reason, count(*) AS n FROM sc GROUP BY source, reason")
def funnel(spark, sf_dir):
    r = F.when(F.col("words") < 8, "short").when(F.col("words") > 40, "long").when(F.col("occ") + F.col("other") == 0, "unmarked").when(F.col("occ") < F.col("other"), "eastern").otherwise("kept")
    return sentence_counts(spark, sf_dir).groupBy("source", r.alias("reason")).agg(F.count("*").alias("n"))


@query("agg_30_coverage", f"WITH d AS (SELECT lang, list_distinct([x FOR x IN {sql.tokens('text')} IF x IN ('ti', 'sh', 'wh', 'est', 'mi')]) AS l FROM documents), e AS (SELECT lang, unnest(l) AS label FROM d) SELECT label, lang, count(*) AS n FROM e GROUP BY label, lang")
def label_coverage(spark, sf_dir):
    rules = F.array(*[F.lit(x) for x in ("ti", "sh", "wh", "est", "mi")])
    e = documents(spark, sf_dir).select("lang", F.explode(F.array_intersect(rules, T.tokens(F.col("text")))).alias("label"))
    return e.groupBy("label", "lang").agg(F.count("*").alias("n"))


@query("agg_33_unique_sentences", f"WITH {sql.SENT}, k AS (SELECT {_RK} AS k, doc_id FROM sent) SELECT md5(k) AS id, count(*) AS n, min(doc_id) AS first_doc FROM k GROUP BY k")
def unique_sentences(spark, sf_dir):
    g = sentences(spark, sf_dir).select(T.repeat_text(F.col("text")).alias("k"), "doc_id").groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return g.select(F.md5("k").alias("id"), "n", "first_doc")


@query("prd_20_integrity", "WITH r AS (SELECT item_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents), i AS (SELECT 'repeated_id' AS issue, count(*) AS n FROM (SELECT item_id FROM r GROUP BY item_id HAVING count(*) > 1) UNION ALL SELECT 'repeated_text', count(*) FROM (SELECT text FROM r GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'stray_blanks', count(*) FROM r WHERE trim(text) <> text UNION ALL SELECT 'blank', count(*) FROM r WHERE trim(text) = '') SELECT * FROM i")
def integrity(spark, sf_dir):
    r = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text").union(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    twice = lambda c, issue: r.groupBy(c).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit(issue).alias("issue"), "n")
    flags = r.agg(F.count_if(F.trim("text") != F.col("text")).alias("stray_blanks"), F.count_if(F.trim("text") == "").alias("blank"))
    rest = flags.select(F.explode(F.create_map(F.lit("stray_blanks"), "stray_blanks", F.lit("blank"), "blank")).alias("issue", "n"))
    return twice("id", "repeated_id").union(twice("text", "repeated_text")).union(rest)


@query(
    "jon_09_all_near",
    f"""WITH {sql.SENT}, a AS (SELECT doc_id * 10000000 + sent_no AS id, [x FOR x IN list_distinct({sql.bare('text')}) IF length(x) >= 3] AS w FROM sent),
e AS (SELECT item_id * 1000000000 + generate_subscripts(p, 1) - 1 AS item, unnest(p) AS text FROM (SELECT item_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM benchmark)),
b AS (SELECT item, [x FOR x IN list_distinct({sql.bare('text')}) IF length(x) >= 3] AS w FROM e), j AS (SELECT id, item, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u FROM a JOIN b ON list_has_any(a.w, b.w))
SELECT id, item, i / u AS jaccard FROM j WHERE i / u >= 0.6""",
)
def all_near(spark, sf_dir):
    return S.near_evaluation_exact(word_sets(spark, sf_dir), evaluation_items(spark, sf_dir), "id", "words")
