"""Queries of text functions, segmentation and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import segment as S
from ..functions import text as T
from . import sql
from .common import documents, sentences, small, turn_pairs
from .registry import query, table

_join = lambda c: F.array_join(c, " ")
_jsql = lambda e: f"array_to_string({e}, ' ')"


def _column(name: str, make, sql_expr: str, source: str = "documents", key: str = "doc_id") -> None:
    """Register a query that adds one computed column, out."""

    @query(name, f"SELECT {key}, {sql_expr} AS out FROM {source}")
    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, make().alias("out"))


_column("txt_01_tokens", lambda: _join(T.tokens(F.col("text"))), _jsql(sql.tokens("text")))
_column("txt_02_word_set", lambda: _join(T.word_set(F.col("text"))), _jsql(f"list_sort(list_distinct({sql.bare('text')}))"))
_column("txt_03_pair_tokens", lambda: _join(T.pair_tokens(F.col("text"))), _jsql(sql.pair_tokens("text")))
_column("txt_04_hyphen_words", lambda: _join(T.hyphen_words(F.col("text"))), _jsql(sql.find(sql.fold("lower(text)"), T.HYPHEN_WORDS)))
_LOSSLESS = r"(?s)[0-9]+(?:[.,][0-9]+)*|[A-Za-zÀ-ÖØ-öø-ÿ·]+(?:['’ʼ\-][A-Za-zÀ-ÖØ-öø-ÿ·]+)*|\s+|."
_column("txt_05_lossless", lambda: F.concat_ws(":", F.size(T.lossless(F.col("text"))), T.detokenise(T.lossless(F.col("text")))), f"len({sql.find('text', _LOSSLESS)}) || ':' || text")
_column("txt_06_pair_lossless", lambda: F.array_join(F.filter(T.lossless(F.col("text")), lambda x: ~x.rlike(r"^\s")), "|"), f"array_to_string([x FOR x IN {sql.find('text', _LOSSLESS)} IF NOT regexp_matches(x, '^\\s')], '|')")
_column("txt_07_lm_text", lambda: T.lm_text(F.col("text")), f"array_to_string([CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' ELSE x END FOR x IN {sql.find('lower(' + sql.fold('text') + ')', T.LM_UNITS)}], ' ')")
_column("txt_08_apostrophes", lambda: T.fold_apostrophes(F.col("text")), sql.fold("text"))
_column("txt_09_repeat_key", lambda: F.md5(T.repeat_text(F.col("text"))), f"md5({sql.repeat_text('text')})")
_column("txt_11_ids", lambda: F.concat_ws("/", T.sentence_id(F.col("text")), T.numbered_id(F.col("doc_id"), F.lit(7))), "substr(sha1(lower(trim(text))), 1, 16) || '/' || doc_id || '-0007'")
_column("txt_11_url_ids", lambda: T.url_id(F.col("url")), "substr(md5(url), 1, 12)", "pages", "page_id")
_column("txt_13_rejoin_lines", lambda: T.rejoin_lines(F.col("text")), sql.sub("text", r"\s*\n\s*(\p{Ll})", r" \1"))
_column("txt_14_join_open_lines", lambda: T.join_open_lines(F.col("text")), sql.sub("text", r"([^.!?:\n \t])[ \t]*\n[ \t]*", r"\1 "))
_column("txt_14_bracketed", lambda: F.array_join(T.bracketed(F.replace("text", F.lit(" | "), F.lit("] ["))), "|"), r"array_to_string(regexp_extract_all(replace(text, ' | ', '] ['), '\[([^\[\]\n]+)\]', 1), '|')")
_column("txt_16_drop_lines", lambda: T.drop_lines(F.col("text"), ["^[^a-z]*$", "license"]), r"trim(array_to_string([x FOR x IN [trim(y) FOR y IN string_split(text, chr(10))] IF x <> '' AND NOT regexp_matches(x, '(?:^[^a-z]*$)|(?:license)')], ' '))")
_column("txt_24_tld", lambda: T.tld(F.expr("parse_url(url, 'HOST')")), r"regexp_extract(url, '^[a-z]+://[^/?#]*\.([^./?#:]+)', 1)", "pages", "page_id")


@query("txt_10_pair_key", f"WITH {sql.PAIR} SELECT id, lower(trim(a)) || '|' || lower(trim(b)) AS key FROM pair")
def pair_key(spark, sf_dir):
    k = T.pair_key(F.col("a"), F.col("b"))
    return turn_pairs(spark, sf_dir).select("id", F.concat_ws("|", k["a"], k["b"]).alias("key"))


_BLANKS = r"[ \t\n\x0B\f\r]"
_OUTER = f"'^{_BLANKS}+|{_BLANKS}+$', '', 'g'"


@query(
    "txt_12_repair_breaks",
    rf"""WITH ln AS (SELECT doc_id, list_append([regexp_replace(x, {_OUTER}) FOR x IN regexp_split_to_array(regexp_replace(text, '^\[\d{{2}}/\d{{2}}/\d{{4}}\]{_BLANKS}*', ''), '\r\n|\r|\n')], '') AS l FROM documents),
st AS (SELECT doc_id, [{{'out': []::VARCHAR[], 'line': x, 'n': 0}} FOR x IN l] AS s FROM ln),
fd AS (SELECT doc_id, list_reduce(s, lambda a, x: CASE WHEN a.line <> '' AND x.line <> '' AND a.n < 5 AND (length(a.line) < 45 AND NOT regexp_matches(a.line, '[.?!:;"»]$') OR regexp_matches(x.line, '^[,:;.!?)»]'))
THEN {{'out': a.out, 'line': a.line || CASE WHEN regexp_matches(x.line, '^[,:;.!?)»]') THEN '' ELSE ' ' END || x.line, 'n': a.n + 1}}
ELSE {{'out': CASE WHEN a.line <> '' THEN list_append(a.out, a.line) WHEN len(a.out) > 0 AND a.out[-1] <> '' THEN list_append(a.out, '') ELSE a.out END, 'line': x.line, 'n': 0}} END, {{'out': []::VARCHAR[], 'line': '', 'n': 0}}).out AS o FROM st)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(o, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ([,:;.!?])', '\1', 'g'), {_OUTER}) AS text FROM fd""",
)
def repair_breaks(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.repair_breaks(F.col("text")).alias("text"))


@query(
    "txt_15_repeated_lines",
    r"""
WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS i, len(p) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
c AS (SELECT *, trim(line) AS t, count(*) OVER (PARTITION BY doc_id, trim(line)) AS k FROM l)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM c WHERE NOT (n > 10 AND t <> '' AND k > 3 AND length(t) < 80) AND NOT regexp_matches(t, '^[0-9]+$') GROUP BY doc_id
""",
)
def repeated_lines(spark, sf_dir):
    from ..operators.cleaning import drop_repeated_lines

    return drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")


@query(
    "txt_17_merge_paragraphs",
    r"""
WITH l AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS par_no FROM (SELECT doc_id, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS p FROM documents)),
f AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY par_no) AS prev FROM l),
g AS (SELECT *, CASE WHEN prev IS NULL OR regexp_matches(prev, '[.!?:]$') OR upper(prev) = prev OR regexp_matches(text, '^(?:[0-9]+[.)]|[IVXLC]+\.)\s') THEN 1 ELSE 0 END AS head FROM f),
h AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY par_no) AS block FROM g)
SELECT doc_id, block::BIGINT AS block, string_agg(text, ' ' ORDER BY par_no) AS text FROM h GROUP BY doc_id, block
""",
)
def merge_paragraphs(spark, sf_dir):
    from ..operators.cleaning import merge_open_paragraphs

    return merge_open_paragraphs(S.explode_paragraphs(documents(spark, sf_dir).select("doc_id", "text")), "doc_id")


@query(
    "txt_18_keep_case",
    f"""WITH t AS (SELECT unnest({sql.find('text', T.LETTERS)}) AS w FROM documents)
SELECT DISTINCT w, CASE WHEN length(w) > 1 AND NOT regexp_matches(w, '\\p{{Ll}}') AND regexp_matches(w, '\\p{{Lu}}') THEN 'NEW' WHEN regexp_matches(w, '^\\p{{Lu}}') THEN 'New' ELSE 'new' END AS out FROM t""",
)
def keep_case(spark, sf_dir):
    w = documents(spark, sf_dir).select(F.explode(T.matches(F.col("text"), T.LETTERS)).alias("w")).distinct()
    return w.select("w", T.keep_case(F.col("w"), F.lit("new")).alias("out"))


@query(
    "txt_19_elided",
    f"""WITH t AS (SELECT DISTINCT 'd''' || unnest({sql.find('text', T.LETTERS)}) AS w FROM documents)
SELECT w, 'd' AS prefix, substr(w, 3) AS rest, substr(w, 3) AS lookup FROM t""",
)
def elided(spark, sf_dir):
    w = documents(spark, sf_dir).select(F.explode(T.matches(F.col("text"), T.LETTERS)).alias("w")).distinct().select(F.concat(F.lit("d'"), "w").alias("w"))
    prefix, rest = T.elided(F.col("w"))
    return w.select("w", prefix.alias("prefix"), rest.alias("rest"), T.lookup_word(F.col("w")).alias("lookup"))


@query(
    "txt_20_enclitic",
    f"""WITH t AS (SELECT DISTINCT unnest({sql.find('text', T.LETTERS)}) || '-la-hi' AS w FROM documents)
SELECT w, substr(w, 1, length(w) - 6) AS core, '-la-hi' AS tail FROM t""",
)
def enclitic(spark, sf_dir):
    w = documents(spark, sf_dir).select(F.explode(T.matches(F.col("text"), T.LETTERS)).alias("w")).distinct().select(F.concat("w", F.lit("-la-hi")).alias("w"))
    core, tail = T.enclitic(F.col("w"))
    return w.select("w", core.alias("core"), tail.alias("tail"))


@query("txt_22_clean_answer", r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace('"Answer: ' || text || '"', '^[^\n]*:[ \t]*\n+', ''), '(?i)^(?:"answer|reply)[ \t]*:[ \t]*', ''), '^["«“](.*)["»”]$', '\1')) AS out FROM conversations""")
def clean_answer(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.clean_answer(F.concat(F.lit('"Answer: '), "text", F.lit('"')), ['"answer', "reply"]).alias("out"))


@query(
    "txt_23_repairs",
    r"""SELECT id, CASE WHEN regexp_matches(lower(a), '\bthe\b') THEN regexp_replace(b, '\bof\b', 'for', 'g') ELSE b END AS fixed,
  CASE WHEN regexp_matches(lower(a), '\bthe\b') AND regexp_matches(b, '\bof\b') THEN 1 ELSE 0 END AS repairs FROM pair""".replace("SELECT id", f"WITH {sql.PAIR} SELECT id", 1),
)
def repairs(spark, sf_dir):
    from ..operators.cleaning import conditional_repair

    return conditional_repair(turn_pairs(spark, sf_dir), [("the", "of", "for")]).select("id", "fixed", "repairs")


@query(
    "txt_25_ngrams",
    f"""WITH w AS (SELECT doc_id, {sql.tokens('text')} AS t FROM documents), n AS (SELECT doc_id, t, unnest([1, 2, 3]) AS n FROM w),
g AS (SELECT doc_id, unnest([array_to_string(t[i:i + n - 1], ' ') FOR i IN range(1, len(t) - n + 2)]) AS gram FROM n)
SELECT doc_id, count(*) AS grams, count(DISTINCT gram) AS kinds FROM g GROUP BY doc_id""",
)
def ngrams(spark, sf_dir):
    """Texts are shuffled by id, as an id may stand more than once; their n-grams are not."""
    d = documents(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    g = d.select("doc_id", F.flatten(F.transform("texts", lambda x: T.ngrams(T.tokens(x), 3))).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("grams"), F.size(F.array_distinct("g")).cast("long").alias("kinds")).filter("grams > 0")


@query("seg_01_sentences", f"WITH {sql.SENT} SELECT doc_id, sent_no, text FROM sent")
def seg_sentences(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "sent_no", "text")


_LINES = "lines AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS par_no FROM (SELECT doc_id, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS p FROM documents))"


_BLANK = "paras AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS par_no FROM (SELECT doc_id, [trim(x) FOR x IN string_split(text, chr(10) || chr(10)) IF trim(x) <> ''] AS p FROM documents))"


@query("seg_02_paragraph_sentences", f"WITH {_BLANK} SELECT doc_id, par_no, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS sent_no FROM (SELECT doc_id, par_no, {sql.marked('text', '[A-ZÀÈÉÍÒÓÚÜÇ«\"(0-9]')} AS p FROM paras)")
def seg_wide(spark, sf_dir):
    """Paragraphs are parted by blank lines."""
    return S.line_sentences(documents(spark, sf_dir).select("doc_id", "text"), between="\n\n")


_QUOTED = "regexp_replace(text, '([.!?…])[ \\t\\n\\x0B\\f\\r]+([A-ZÀÈÉÍÒÓÚÜÇ«\"''(‘“])', '\\1' || chr(1) || '\\2', 'g')"
_ABBREVIATED = "(lower(regexp_extract(a[-1], '([A-Za-zÀ-ÿ]+)\\.?$', 1)) IN (" + ", ".join(sql.lit(a) for a in S.ABBREVIATIONS) + ") OR length(regexp_extract(a[-1], '([A-Za-zÀ-ÿ]+)\\.?$', 1)) <= 1 AND ends_with(a[-1], '.'))"


@query(
    "seg_03_rejoined_sentences",
    f"""WITH {_LINES}, cut AS (SELECT doc_id, par_no, [[trim(x)] FOR x IN string_split({_QUOTED}, chr(1)) IF trim(x) <> ''] AS p FROM lines),
joined AS (SELECT doc_id, par_no, list_reduce(p, lambda a, x: CASE WHEN {_ABBREVIATED} THEN list_append(a[1:len(a) - 1], a[-1] || ' ' || x[1]) ELSE list_concat(a, x) END) AS s FROM cut WHERE len(p) > 0)
SELECT doc_id, par_no, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS sent_no FROM joined""",
)
def seg_rejoined(spark, sf_dir):
    d = S.explode_paragraphs(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "par_no", F.posexplode(S.rejoined(S.sentences(F.col("text"), S.QUOTE_BREAK))).alias("sent_no", "text"))


@query("seg_04_plain_sentences", f"SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS sent_no FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents)")
def seg_plain(spark, sf_dir):
    return S.explode_sentences(documents(spark, sf_dir).select("doc_id", "text"), pattern=S.PLAIN_BREAK)


@query("seg_05_line_sentences", f"WITH {_LINES} SELECT doc_id, par_no, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS sent_no FROM (SELECT doc_id, par_no, {sql.sentences('text')} AS p FROM lines)")
def seg_lines(spark, sf_dir):
    return S.line_sentences(documents(spark, sf_dir).select("doc_id", "text"), pattern=S.BREAK)


_N = "len([w FOR w IN regexp_split_to_array(trim(text), '\\s+') IF w <> ''])"


@query("seg_06_usable_sentences", f"WITH {sql.SENT} SELECT doc_id, sent_no, text FROM sent WHERE {_N} >= 6 AND length(text) BETWEEN 30 AND 300 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / length(text) >= 0.55")
def seg_usable(spark, sf_dir):
    return sentences(spark, sf_dir).filter(P.length_window(F.col("text"), 6, 30, 300)).select("doc_id", "sent_no", "text")


#: SQL of valid_sentence(text).
VALID = (
    f"({_N} BETWEEN 8 AND 40 AND regexp_matches(trim(text), '^[\\p{{Lu}}«\"“]') AND regexp_matches(trim(text), '[.?!]$') AND NOT ends_with(trim(text), '...')"
    + " AND NOT regexp_matches(trim(text), '^\\s*(?:\\d+[.\\)º]|[a-zA-Z]\\s?\\)|[-–—•·*]|[IVXLC]+\\.)\\s') AND upper(trim(text)) <> trim(text)"
    + f" AND len([w FOR w IN regexp_split_to_array(trim(text), '\\s+') IF regexp_matches(w, '\\d')]) <= greatest(2, {_N} // 8))"
)


@query("prd_01_valid_sentences", f"WITH {sql.SENT} SELECT doc_id, sent_no, {VALID} AS valid FROM sent")
def valid(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "sent_no", P.valid_sentence(F.col("text")).alias("valid"))


@query("prd_02_good_paragraphs", "SELECT doc_id FROM documents WHERE lang = 'en' AND source <> 'src0' AND n_chars >= 500")
def good_paragraphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter(P.good_paragraph(F.lit("Good"), F.col("lang"), F.when(F.col("source") == "src0", "yes").otherwise("no"), F.lit("no"), F.col("n_chars"), "Good", "en", 500)).select("doc_id")


_SHARE = "length(regexp_replace(replace(trim(text), ' ', ''), '[^\\p{L}]', '', 'g')) / nullif(length(replace(trim(text), ' ', '')), 0)"


@query("prd_03_tables", f"WITH {_LINES} SELECT doc_id, par_no, length(trim(text)) >= 8 AND (regexp_matches(trim(text), '\\.\\s*\\.\\s*\\.\\s*\\.') OR coalesce({_SHARE} < 0.55, false)) AS tabular FROM lines")
def tabular(spark, sf_dir):
    d = S.explode_paragraphs(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "par_no", P.looks_tabular(F.col("text")).alias("tabular"))


@query("prd_04_about_words", f"WITH {sql.SENT} SELECT doc_id, sent_no FROM sent WHERE regexp_matches(lower(text), '(?:^|[^\\p{{L}}])(?:the|des)(?:$|[^\\p{{L}}])')")
def about_words(spark, sf_dir):
    return sentences(spark, sf_dir).filter(P.about_words(F.col("text"), ["the", "des"])).select("doc_id", "sent_no")


@query("prd_05_length_window", f"SELECT doc_id, {_N} >= 20 AND length(text) BETWEEN 200 AND 4000 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / length(text) >= 0.55 AS fits FROM documents")
def window(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", P.length_window(F.col("text"), 20, 200, 4000).alias("fits"))


@query(
    "prd_06_min_words",
    f"WITH d AS (SELECT source, len({sql.tokens('text')}) >= CASE source WHEN 'src0' THEN 300 WHEN 'src1' THEN 100 ELSE 50 END AS ok FROM documents) SELECT source, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS dropped FROM d GROUP BY source",
)
def min_words(spark, sf_dir):
    from ..operators.cleaning import min_words_by_source

    limits = small(spark, [("src0", 300), ("src1", 100)], "source string, least int")
    marked = min_words_by_source(documents(spark, sf_dir), limits, 50)
    return marked.groupBy("source").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("dropped"))


@query("prd_07_lm_lines", f"WITH {sql.SENT}, t AS (SELECT len({sql.find('lower(' + sql.fold('text') + ')', T.LM_UNITS)}) AS n FROM sent) SELECT count(*) FILTER (WHERE n >= 3) AS kept, count(*) FILTER (WHERE n < 3) AS short FROM t")
def lm_lines(spark, sf_dir):
    n = F.size(T.matches(F.lower(T.fold_apostrophes(F.col("text"))), T.LM_UNITS))
    return sentences(spark, sf_dir).agg(F.count_if(n >= 3).alias("kept"), F.count_if(n < 3).alias("short"))


@query("prd_08_block_list", "SELECT doc_id FROM documents WHERE source NOT IN ('src0', 'src3')")
def block_list(spark, sf_dir):
    blocked = small(spark, [("src0",), ("src3",)], "source string")
    return documents(spark, sf_dir).join(blocked, "source", "left_anti").select("doc_id")


_JAC = f"CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) ELSE 0.0 END"
_PT = f"pt AS (SELECT id, a, b, {sql.pair_tokens('a')} AS ta, {sql.pair_tokens('b')} AS tb FROM pair), ps AS (SELECT *, {_JAC} AS sim FROM pt)"
_RATIO = "CASE WHEN least(length(a), length(b)) > 0 THEN greatest(length(a), length(b)) / least(length(a), length(b)) ELSE 'inf'::DOUBLE END"


@query("prd_09_pair_keep", f"WITH {sql.PAIR}, {_PT} SELECT id, CASE WHEN sim >= 0.3 THEN 'safe' WHEN len(ta) = 0 OR len(tb) = 0 THEN 'no_words' WHEN {_RATIO} > 2 THEN 'uneven' ELSE 'rescued' END AS reason FROM ps")
def pair_keep(spark, sf_dir):
    sim = P.jaccard(T.pair_tokens(F.col("a")), T.pair_tokens(F.col("b")))
    return turn_pairs(spark, sf_dir).select("id", P.pair_kept(F.col("a"), F.col("b"), sim).alias("reason"))


@query("prd_10_pair_noise", f"WITH {sql.PAIR}, {_PT} SELECT id, CASE WHEN trim(a) = trim(b) THEN 'identical' WHEN ta = tb THEN 'case_only' WHEN len(ta) >= 4 AND list_sort(ta) = list_sort(tb) THEN 'reordered' ELSE 'net' END AS noise FROM ps")
def pair_noise(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("id", P.pair_noise(F.col("a"), F.col("b")).alias("noise"))


@query("prd_11_aligned", f"WITH {sql.PAIR}, {_PT} SELECT id, length(a) >= 0.85 * length(b) AND length(a) <= 1.15 * length(b) AND sim >= 0.1 AND a <> b AS ok FROM ps")
def aligned(spark, sf_dir):
    sim = P.jaccard(T.pair_tokens(F.col("a")), T.pair_tokens(F.col("b")))
    return turn_pairs(spark, sf_dir).select("id", P.aligned(F.col("a"), F.col("b"), sim, least=0.1).alias("ok"))


@query(
    "prd_12_suspicions",
    f"""WITH {sql.PAIR}, f AS (SELECT id, [
  CASE WHEN contains(lower(b), 'reader') THEN 'leak' END,
  CASE WHEN regexp_matches(a, '\\bThe\\b') AND NOT regexp_matches(b, '\\bThe\\b') THEN 'entity_lost' WHEN NOT regexp_matches(a, '\\bThe\\b') AND regexp_matches(b, '\\bThe\\b') THEN 'entity_new' END,
  CASE WHEN length(b) / greatest(length(a), 1) < 0.5 OR length(b) / greatest(length(a), 1) > 1.8 THEN 'length' END,
  CASE WHEN trim(lower(a)) = trim(lower(b)) THEN 'untranslated' END] AS l, b FROM pair)
SELECT id, CASE WHEN trim(b) = '' THEN 'empty' ELSE array_to_string([x FOR x IN l IF x IS NOT NULL], ',') END AS flags FROM f""",
)
def suspicions(spark, sf_dir):
    flags = P.suspicions(F.col("a"), F.col("b"), ["The"], ["reader"], ["translation:"])
    return turn_pairs(spark, sf_dir).select("id", F.array_join(flags, ",").alias("flags"))


@query("prd_17_buckets", "SELECT doc_id, least(floor(n_chars / 20000.0 * 10), 9) / 10 AS decile, CASE WHEN n_chars // 1000 >= 5 THEN '5+' ELSE (n_chars // 1000)::VARCHAR END AS grp FROM documents")
def buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.decile(F.col("n_chars") / 20000.0).alias("decile"), P.marker_group(F.expr("n_chars div 1000")).alias("grp"))


@query("prd_19_error_class", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'hit' WHEN 'en' = 'fr' THEN 'needless' WHEN lang = 'fr' THEN 'untranslated' ELSE 'wrong' END AS cls FROM documents")
def error_class(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", P.error_class(F.lit("fr"), F.lit("en"), F.col("lang")).alias("cls"))


@query("prd_21_one_present", f"WITH d AS (SELECT doc_id, {sql.bare('text')} AS w FROM documents) SELECT doc_id, CASE WHEN list_contains(w, 'than') AND NOT list_contains(w, 'your') THEN 'than' WHEN list_contains(w, 'your') AND NOT list_contains(w, 'than') THEN 'your' END AS form FROM d")
def one_present(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", P.one_present(T.bare_words(F.col("text")), F.lit("than"), F.lit("your")).alias("form"))


@query("txt_21_lookup_words", f"""WITH t AS (SELECT DISTINCT unnest({sql.find('text', T.LOSSLESS)}) AS w FROM documents),
e AS (SELECT w, CASE WHEN regexp_full_match(w, '{T.LETTERS}') THEN w ELSE nullif(regexp_extract(w, '^[dlsmtnDLSMTN][''’ʼ](.+)$', 1), '') END AS lookup FROM t) SELECT w, lookup FROM e WHERE lookup IS NOT NULL""")
def lookup_words(spark, sf_dir):
    w = documents(spark, sf_dir).select(F.explode(T.lossless(F.col("text"))).alias("w")).distinct()
    return w.select("w", T.lookup_word(F.col("w")).alias("lookup")).filter("lookup is not null")
