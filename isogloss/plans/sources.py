"""Queries of readers, sinks and streams, run on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.lineage import shared_folder
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import jobs as J
from . import sql
from .common import documents, sentences, turn_pairs
from .index import DC, SC, forms
from .registry import query, table


def scratch(spark) -> str:
    """A new folder in the cluster's shared folder; on one machine, where none is set, a temporary one."""
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"


@query("src_01_prevert", r"SELECT doc_id::VARCHAR AS doc, lang, trim(regexp_replace(replace(replace(text, '<', ' '), '>', ' '), '\s*\n\s*', ' ', 'g')) AS text FROM documents WHERE trim(replace(replace(text, '<', ' '), '>', ' ')) <> ''")
def prevert(spark, sf_dir):
    """Documents written as marked-up lines and read again."""
    path = scratch(spark) + "/prevert"
    body = F.replace(F.replace("text", F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" "))
    body = F.replace(body, F.lit("&"), F.lit("&amp;"))
    d = table(spark, sf_dir, "documents").select(F.format_string('<doc id="%s">\n<p id="1" lang="%s">\n%s\n</p>\n', F.col("doc_id").cast("string"), "lang", body).alias("value"))
    d.write.option("lineSep", "</doc>").text(path)
    return R.prevert(spark, path).filter("text <> ''").select("doc", "lang", "text")


@query("src_04_json_records", "SELECT doc_id, text FROM documents")
def json_records(spark, sf_dir):
    path = scratch(spark) + "/json"
    W.json_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    good, _ = R.json_records(spark, path, "doc_id long, text string")
    return good


@query("src_05_repaired_json", "SELECT count(*) FILTER (WHERE doc_id % 3 = 1) AS repaired, count(*) FILTER (WHERE doc_id % 3 = 2) AS lost, count(*) FILTER (WHERE doc_id % 3 < 2) AS kept FROM documents")
def repaired_json(spark, sf_dir):
    path = scratch(spark) + "/junk"
    j = F.to_json(F.struct("doc_id", F.regexp_replace("text", "[{}]", " ").alias("text")))
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, j).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("junk "), j)).otherwise(F.lit("no record")).alias("value"))
    d.write.text(path)
    r = R.repaired_json(spark, path, "doc_id long, text string")
    return r.agg(F.count_if("repaired").alias("repaired"), F.count_if("lost").alias("lost"), F.count_if(F.col("record").isNotNull()).alias("kept"))


@query("src_06_tsv", "SELECT doc_id::VARCHAR AS doc_id, replace(text, chr(9), ' ') AS text FROM documents")
def tsv(spark, sf_dir):
    path = scratch(spark) + "/tsv"
    text = F.replace(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit("\\n"))
    table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text")).write.option("sep", "\t").option("header", True).option("quote", "").option("escapeQuotes", False).option("emptyValue", "").csv(path)
    return R.tsv(spark, path, "text")


@query("src_07_lines", r"WITH l AS (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS line FROM documents), n AS (SELECT count(*) AS n FROM l WHERE line <> '') SELECT unnest(generate_series(1, n)) AS number, NULL AS text, 0 AS n FROM n UNION ALL SELECT 0, line, count(*) FROM l WHERE line <> '' GROUP BY line")
def lines(spark, sf_dir):
    """The numbers of all lines, and how often each line is there; lines of files written in parallel have no order of their own."""
    path = scratch(spark) + "/lines"
    table(spark, sf_dir, "documents").select("text").write.text(path)
    got = R.lines(spark, path)
    numbers = got.select(F.substring("id", F.lit(2), F.length("id")).cast("long").alias("number"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    return numbers.union(got.groupBy("text").agg(F.count("*").alias("n")).select(F.lit(0).cast("long"), "text", "n"))


_HIDE = sql.lit(R._HIDDEN.replace("(?is)", ""))


def _visible(e: str) -> str:
    e = f"regexp_replace(regexp_replace(regexp_replace({e}, {_HIDE}, ' ', 'gis'), {sql.lit(R._BLOCK.replace('(?i)', ''))}, chr(10), 'gi'), '<[^>]*>', '', 'g')"
    for a, b in R.ENTITIES:
        e = f"replace({e}, {sql.lit(a)}, {sql.lit(b)})"
    e = f"regexp_replace(regexp_replace({e}, '[\\t\\r ]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({e}, '^[ \\n]+|[ \\n]+$', '', 'g')"


@query("src_08_page_documents", f"SELECT substr(md5(url), 1, 12) AS id, page_id, {_visible('html')} AS text FROM pages")
def page_documents(spark, sf_dir):
    return R.page_documents(table(spark, sf_dir, "pages")).select("id", "page_id", "text")


@query("src_09_page_links", r"""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS host, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '[?#].*$', '') AS href FROM pages) SELECT DISTINCT page_id, CASE WHEN starts_with(href, '/') THEN host || href ELSE href END AS link FROM l WHERE regexp_matches(CASE WHEN starts_with(href, '/') THEN host || href ELSE href END, '^https?://')""")
def page_links(spark, sf_dir):
    return R.page_links(table(spark, sf_dir, "pages"), "^https?://")


@query("src_10_chapters", rf"WITH c AS (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS chapter FROM (SELECT page_id, regexp_split_to_array(html, '(?i)<p\b[^>]*>') AS p FROM pages)), t AS (SELECT page_id, chapter, {_visible('part')} AS text FROM c) SELECT page_id, chapter, text FROM t WHERE text <> ''")
def chapters(spark, sf_dir):
    return R.page_chapters(table(spark, sf_dir, "pages"))


@query("snk_03_aligned_sides", rf"WITH {sql.PAIR} SELECT regexp_replace(a, '[\r\n]+', ' ', 'g') AS a, regexp_replace(b, '[\r\n]+', ' ', 'g') AS b, count(*) AS n FROM pair GROUP BY ALL")
def aligned_sides(spark, sf_dir):
    """Both sides, read again line by line."""
    path = scratch(spark) + "/sides"
    W.aligned_sides(turn_pairs(spark, sf_dir), path, "id", ("a", "b"))
    return R.aligned_lines(spark, path, ("a", "b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("snk_04_classifier_lines", r"SELECT '__label__' || l.quality || ' ' || regexp_replace(text, '\s+', ' ', 'g') AS value FROM documents JOIN labels l USING (doc_id)")
def classifier_lines(spark, sf_dir):
    path = scratch(spark) + "/lines"
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    W.classifier_lines(d, "quality", "text", path)
    return spark.read.text(path)


@query("snk_05_chunks", "SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 100 AS chunk FROM documents")
def chunks(spark, sf_dir):
    return W.numbered_chunks(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 100).select("doc_id", "chunk")


@query("snk_07_merged_shards", "SELECT doc_id, source FROM documents")
def merged_shards(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return W.merged_shards([d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 < 2"), d], "doc_id", ["source"])


@query("snk_08_still_to_do", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def still_to_do(spark, sf_dir):
    return W.still_to_do(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def _files(spark, sf_dir):
    """documents as several files, and their schema."""
    path = scratch(spark) + "/files"
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    d.repartition(4, "doc_id").write.parquet(path)
    return path, "doc_id long, source string, text string"


@query("str_01_score_new", f"WITH {SC}, {DC} SELECT doc_id, words, occ, other FROM dc")
def score_new(spark, sf_dir):
    path, schema = _files(spark, sf_dir)
    out = scratch(spark)
    J.score_new(J.new_documents(spark, path, schema, 2), ["doc_id"], forms(spark), f"{out}/scores", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/scores").select("doc_id", "words", "occ", "other")


@query("str_02_keep_first_new", f"SELECT DISTINCT {sql.repeat_text('text')} AS kept FROM documents")
def keep_first_new(spark, sf_dir):
    path, schema = _files(spark, sf_dir)
    out = scratch(spark)
    J.keep_first_new(J.new_documents(spark, path, schema, 2), "text", f"{out}/first", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/first").select(T.repeat_text(F.col("text")).alias("kept"))


@query("str_03_running_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def running_counts(spark, sf_dir):
    path, schema = _files(spark, sf_dir)
    out = f"{scratch(spark)}/counts"
    J.running_counts(J.new_documents(spark, path, schema, 2), ["source"], out, f"{scratch(spark)}/state").awaitTermination()
    return J.last_counts(spark, ["source"], out).select("source", F.col("count").alias("n"))


@query("src_11_frequency_table", f"WITH t AS (SELECT lang, unnest({sql.tokens('text')}) AS form FROM documents) SELECT lang, form, count(*) AS n FROM t GROUP BY lang, form")
def frequency_table(spark, sf_dir):
    """A table for each language, written as maps and read again."""
    path = scratch(spark) + "/freq"
    n = table(spark, sf_dir, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("form")).groupBy("lang", "form").agg(F.count("*").alias("n"))
    # Forms are dealt by hash to maps of a few hundred entries, so no map grows with a language or a first letter.
    parts = n.groupBy("lang").agg(F.ceil(F.count("*") / 256).alias("parts")).withColumn("l", F.struct("lang")).select("l", "parts")
    dealt = n.withColumn("l", F.struct("lang")).join(parts, "l").withColumn("text", F.pmod(F.xxhash64("form"), F.col("parts")).cast("string"))
    dealt.groupBy("lang", "text").agg(F.map_from_entries(F.collect_list(F.struct("form", "n"))).alias("freq")).write.json(path)
    return spark.read.schema("lang string, text string, freq map<string,long>").json(path).select("lang", F.explode("freq").alias("form", "n"))


@query("snk_01_json_lines", "SELECT item_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents")
def json_lines(spark, sf_dir):
    path = scratch(spark) + "/json"
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text").union(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    W.json_lines(d, path)
    return spark.read.schema("item_id long, text string").json(path)


@query("snk_02_csv_report", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def csv_report(spark, sf_dir):
    path = scratch(spark) + "/csv"
    W.csv_report(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")), path)
    return spark.read.schema("source string, n long").option("header", True).csv(path)


@query("snk_10_routed", "SELECT doc_id, NOT regexp_matches(text, '[0-9]') AS final FROM documents")
def routed(spark, sf_dir):
    final, pending = W.routed(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text").rlike("[0-9]"))
    return final.select("doc_id", F.lit(True).alias("final")).union(pending.select("doc_id", F.lit(False)))


@query("src_12_cms_documents", f"""SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS title, date '2020-01-01' + (page_id % 365)::INT || '' AS date, {_visible('html')} AS text FROM pages""")
def cms_documents(spark, sf_dir):
    """Pages as items, with the host as title; pages have no dates, so items get one by their number."""
    path = scratch(spark) + "/cms"
    p = table(spark, sf_dir, "pages")
    rendered = lambda c: F.struct(c.alias("rendered"))
    day = F.concat(F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).cast("string"), F.lit("T03:04:05"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    p.select(F.col("url").alias("link"), day.alias("date"), rendered(F.concat(F.lit("<b>"), host, F.lit("</b>"))).alias("title"), rendered(F.col("html")).alias("content")).write.json(path)
    return R.cms_documents(spark, path).select("url", "title", F.col("date").cast("string").alias("date"), "text")


@query("str_04_stop_after", "SELECT doc_id FROM documents WHERE length(text) > 50")
def stop_after(spark, sf_dir):
    """As many rows as there are, so that no file may be left out; where it stops sooner is tested on made files."""
    path, schema = _files(spark, sf_dir)
    out = scratch(spark)
    whole = spark.read.schema(schema).parquet(path).count()
    J.stop_after(J.new_documents(spark, path, schema, 1), F.length("text") > 50, whole, f"{out}/kept", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/kept").select("doc_id")


@query("src_02_compressed_lines", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) SELECT value, count(*) AS n FROM l GROUP BY value")
def compressed_lines(spark, sf_dir):
    path = scratch(spark) + "/lines"
    table(spark, sf_dir, "documents").select(F.col("text").alias("value")).write.option("compression", "gzip").text(path)
    return R.corpus_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("src_03_trial_read", "WITH d AS (SELECT doc_id, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(strlen(text)) OVER () AS whole FROM documents) SELECT doc_id FROM d WHERE before < whole / 10")
def trial_read(spark, sf_dir):
    """The first tenth of the corpus, by bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return R.trial(d, ["doc_id"], F.lit(whole / 10)).select("doc_id")


@query("snk_06_text_export", f"WITH {sql.SENT} SELECT text AS value, count(*) AS n FROM sent WHERE text <> '' GROUP BY text")
def text_export(spark, sf_dir):
    """Sentences, written all or nothing, and what a reader finds then."""
    path = scratch(spark) + "/export"
    sentences(spark, sf_dir).select(F.col("text").alias("value")).filter("value <> ''").write.option("lineSep", "\x1e").text(path)
    return spark.read.option("lineSep", "\x1e").text(path).groupBy("value").agg(F.count("*").alias("n"))


@query("snk_09_resumed", f"WITH {SC}, {DC} SELECT doc_id, words, occ, other FROM dc")
def resumed(spark, sf_dir):
    """A pass over half of the files, and then, from where it stopped, over the rest."""
    out = scratch(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    for half in (0, 1):
        d.filter(F.pmod("doc_id", F.lit(2)) == half).write.mode("append").parquet(f"{out}/files")
        J.same_parameters(spark, f"{out}/parameters", {"key": "doc_id", "text": "text"})
        J.score_new(J.new_documents(spark, f"{out}/files", "doc_id long, source string, text string"), ["doc_id"], forms(spark), f"{out}/scores", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/scores").select("doc_id", "words", "occ", "other")


@query("src_02_zipped", "WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS value, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) - 1 AS line_no FROM documents WHERE text <> '') SELECT doc_id, line_no, value FROM l")
def zipped(spark, sf_dir):
    """Documents as members of zip files, and their lines as read again, a member at a time."""
    path = scratch(spark) + "/zipped"
    d = documents(spark, sf_dir).select("doc_id", "text")
    W.zipped(d.withColumn("name", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))), path, "name", "text")
    return R.zipped_lines(spark, path).select(F.regexp_extract("member", r"(\d+)", 1).cast("long").alias("doc_id"), "line_no", "value")


@query("str_02_keep_first_by_table", f"SELECT {sql.repeat_text('text')} AS kept, 1::BIGINT AS n FROM documents GROUP BY 1")
def keep_first_by_table(spark, sf_dir):
    """Keys in a table, a file to a batch, with a base every third; n tells that each text was kept once."""
    out = scratch(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text").repartition(8, "doc_id").write.parquet(f"{out}/files")
    stream = J.new_documents(spark, f"{out}/files", "doc_id long, text string", 1)
    J.keep_first_by_table(stream, "text", ["doc_id"], f"{out}/first", f"{out}/seen", f"{out}/state", 3).awaitTermination()
    return spark.read.parquet(f"{out}/first").groupBy(T.repeat_text(F.col("text")).alias("kept")).agg(F.count("*").alias("n"))


@query("str_04_stopped", "SELECT count(*) < (SELECT count(*) FROM documents) AS stopped, count(*) > 0 AS wrote FROM (SELECT doc_id FROM documents LIMIT 1)")
def stopped(spark, sf_dir):
    """A limit that bites: a third of the rows; the batches after it are skipped."""
    path, schema = _files(spark, sf_dir)
    out = scratch(spark)
    whole = spark.read.schema(schema).parquet(path).count()
    J.stop_after(J.new_documents(spark, path, schema, 1), F.col("doc_id").isNotNull(), whole // 3, f"{out}/kept", f"{out}/state").awaitTermination()
    n = spark.read.parquet(f"{out}/kept").agg(F.count("*").alias("n"))
    return n.select((F.col("n") < whole).alias("stopped"), (F.col("n") > whole // 3 - 1).alias("wrote"))


_HEADED = rf"""hs AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<!--.*?-->', ' ', 'g') AS h FROM pages),
hp AS (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS chapter, regexp_matches(p[1], '(?i)^<h[1-6]\b') AS headed FROM (SELECT page_id, list_filter(string_split(regexp_replace(h, '(?i)(<h[1-6]\b[^>]*>)', chr(1) || '\1', 'g'), chr(1)), lambda x, i: i > 1 OR x <> '') AS p FROM hs))"""


@query("src_10_headed_chapters", rf"""WITH {_HEADED}, hx AS (SELECT page_id, chapter + headed::INT AS chapter, part, regexp_extract(part, '(?is)^<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>(.*)$', 1) AS lv, regexp_extract(part, '(?is)^<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>(.*)$', 2) AS hd, regexp_extract(part, '(?is)^<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>(.*)$', 3) AS bd FROM hp)
SELECT page_id, chapter::INT AS chapter, CASE WHEN lv <> '' THEN lv::INT END AS level, CASE WHEN lv <> '' THEN {_visible('hd')} END AS heading, {_visible("CASE WHEN lv = '' THEN part ELSE bd END")} AS text FROM hx WHERE lv <> '' OR {_visible("CASE WHEN lv = '' THEN part ELSE bd END")} <> ''""")
def headed_chapters(spark, sf_dir):
    return R.headed_chapters(table(spark, sf_dir, "pages"))
