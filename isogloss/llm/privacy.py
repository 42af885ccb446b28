"""Information-theoretic sanitisation; DataFrame functions only.

Patterns find personal data (e-mail addresses, IP addresses, payment cards,
phone numbers). Each distinct value is a protected entity. The corpus then tells
how strongly a term near an entity reveals it: with document counts N, df(e),
df(t) over all documents and df(e, t) over contexts, the disclosure is
PMI(e; t) = log(N df(e, t) / (df(e) df(t))) as a share of the entity's own
information log(N / df(e)). A term of GENERALISE or more is replaced by a
general mark where it stands near that entity, one of REMOVE or more is taken
out.

The patterns are written with possessive repeats and look-behinds, so they find
what the plain ones find but take linear time on long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, table

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information from which a term is generalised or removed; documents that must show both.
GENERALISE, REMOVE, SUPPORT = 0.8, 0.95, 2
#: Code points of context on each side, and the least length of a term.
CONTEXT, TERM = 80, 4
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "drop": ""}

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole run of digits with single separators, of 12 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_WORD = r"\p{L}++"
_BLOCK = 256


def _located(text: Column, pattern: str) -> Column:
    """Array of (s, e, v): the matches of a pattern, in code points.

    Ends are running sums of the lengths of gaps and matches. They are summed in
    blocks, then inside each, so that an array grows by appending in a block only.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # Matches and the gaps before them; the last gap has no match and is left out.
    pairs = F.filter(F.zip_with(gaps, found, lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("n"), v.alias("v"))), lambda x: x["v"].isNotNull())
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(found) / _BLOCK).cast("int")), lambda b: F.slice(pairs, b * _BLOCK + 1, _BLOCK))
    width = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["g"] + x["n"]))
    none = F.expr("cast(array() as array<int>)")
    first = F.aggregate(width, F.struct(F.lit(0).alias("pos"), none.alias("out")), lambda acc, w: F.struct((acc["pos"] + w).alias("pos"), F.array_append(acc["out"], acc["pos"]).alias("out")), lambda acc: acc["out"])

    def inside(block: Column, start: Column) -> Column:
        empty = F.struct(start.alias("pos"), F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            s = acc["pos"] + x["g"]
            e = s + x["n"]
            return F.struct(e.alias("pos"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"))).alias("out"))

        return F.aggregate(block, empty, add, lambda acc: acc["out"])

    return F.flatten(F.zip_with(blocks, first, inside))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether digits pass the Luhn check: each second from the right counts twice."""
    d = F.transform(F.split(F.reverse(_digits(v)), "(?!^)(?!$)"), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((2 * x.cast("int")) % 10 + F.floor(2 * x.cast("int") / 10).cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(v)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, kind, v) by start, then kind as listed."""
    has = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.contains("."), "card": F.lit(True)}

    def of(k: int, kind: str) -> Column:
        good = F.filter(_located(text, PATTERNS[kind]), lambda x: _valid(kind, x["v"]))
        spans = F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v")))
        none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,kind:string,v:string>>)")
        return F.when(has[kind] & F.regexp_like(text, F.lit(PATTERNS[kind])), spans).otherwise(none)

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def _entity(b: Column) -> Column:
    """One name for the ways to write a value."""
    return F.concat(b["kind"], F.lit(":"), F.when(b["kind"].isin("card", "phone"), _digits(b["v"])).otherwise(F.lower(b["v"])))


def context_terms(text: Column, base: Column) -> Column:
    """Array of (entity, term, s, e): whole words of letters near each base span, outside of all base spans."""

    def near(b: Column) -> Column:
        lo = F.greatest(F.lit(0), b["s"] - CONTEXT)
        left, right = F.substring(text, lo + 1, b["s"] - lo), F.substring(text, b["e"] + 1, F.lit(CONTEXT))
        cut_left = lambda w: (w["s"] > 0) | (lo == 0)
        cut_right = lambda w: (w["e"] < CONTEXT) | (F.length(text) == b["e"] + CONTEXT)
        words = F.concat(
            F.transform(F.filter(_located(left, _WORD), cut_left), lambda w: F.struct((w["s"] + lo).alias("s"), (w["e"] + lo).alias("e"), w["v"].alias("v"))),
            F.transform(F.filter(_located(right, _WORD), cut_right), lambda w: F.struct((w["s"] + b["e"]).alias("s"), (w["e"] + b["e"]).alias("e"), w["v"].alias("v"))),
        )
        free = F.filter(words, lambda w: (F.length(w["v"]) >= TERM) & ~F.exists(base, lambda x: (x["s"] < w["e"]) & (w["s"] < x["e"])))
        return F.transform(free, lambda w: F.struct(_entity(b).alias("entity"), F.lower(w["v"]).alias("term"), w["s"].alias("s"), w["e"].alias("e")))

    return F.when(F.size(base) > 0, F.flatten(F.transform(base, near))).otherwise(F.expr("cast(array() as array<struct<entity:string,term:string,s:int,e:int>>)"))


def disclosures(found: DataFrame, docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """entity, term, disclosure and action ('term' or 'drop') of the pairs that reach a threshold."""
    n = docs.agg(F.count("*").alias("n"))
    near = found.select(F.explode(F.array_distinct(F.transform("terms", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))).alias("p")).select("p.*")
    both = near.groupBy("entity", "term").agg(F.count("*").alias("df_et")).filter(F.col("df_et") >= support)
    df_e = found.select(F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity")).groupBy("entity").agg(F.count("*").alias("df_e")).filter(F.col("df_e") >= support)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{TERM},}}"), F.lit(0)))
    df_t = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df_t")).filter(F.col("df_t") >= support)
    pairs = both.join(df_e, "entity").join(df_t, "term").crossJoin(n)  # n is one row
    own = F.log2(F.col("n") / F.col("df_e"))
    pmi = F.log2(F.col("n") * F.col("df_et") / (F.col("df_e") * F.col("df_t")))
    d = F.when(own > 0, pmi / own)
    return pairs.select("entity", "term", d.alias("disclosure")).filter(F.col("disclosure") >= generalise).withColumn("action", F.when(F.col("disclosure") >= remove, "drop").otherwise("term"))


def found_spans(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """doc_id, text_hash, base and extra, one row per row of docs (doc_id, text).

    base has the pattern spans, extra the (s, e, action) of terms. A null text
    is empty and has no spans. Null and repeated ids and repeated rows each keep
    a row and count as documents. Extra columns are ignored; an empty table
    gives an empty result.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", base_spans(F.col("text")).alias("base"))
    found = cut(found.select("doc_id", "text_hash", "base", context_terms(F.col("text"), F.col("base")).alias("terms")))
    acts = disclosures(found, rows, generalise, remove, support).select("entity", "term", "action")
    # The same id and text have the same terms, so one row of each speaks for all.
    each = found.filter(F.size("terms") > 0).select("doc_id", "text_hash", F.explode("terms").alias("t")).select("doc_id", "text_hash", "t.*").distinct()
    hit = each.join(acts, ["entity", "term"]).groupBy("doc_id", "text_hash", "s", "e").agg(F.min("action").alias("action"))
    hit = hit.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("s", "e", "action"))).alias("extra"))
    hit = hit.withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    joined = found.join(hit, found["doc_id"].eqNullSafe(hit["hit_id"]) & (found["text_hash"] == hit["hit_hash"]), "left")
    none = F.expr("cast(array() as array<struct<s:int,e:int,action:string>>)")
    return joined.select("doc_id", "text_hash", "base", F.coalesce("extra", none).alias("extra"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _all_spans() -> Column:
    """base and extra as one array of (s, k, e, kind) by start."""
    base = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e"), b["kind"].alias("kind")))
    extra = F.transform("extra", lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e"), x["action"].alias("kind")))
    return F.array_sort(F.concat(base, extra))


def sanitised(docs: DataFrame, **limits: float) -> DataFrame:
    """docs with spans replaced in text (and n_chars, if there is such a column, counted anew)."""
    names = docs.columns
    found = found_spans(docs, **limits).withColumn("spans", _all_spans()).filter(F.size("spans") > 0)
    found = found.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(F.first("spans").alias("spans"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    plain = plain.withColumn("h", F.xxhash64(F.coalesce(text, F.lit(""))))
    mark = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    start = F.expr("named_struct('pos', 0, 'out', cast(array() as array<string>))")

    def put(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["pos"]  # a span that begins inside the one before only widens it
        piece = F.concat(F.substring(F.col(text), acc["pos"] + 1, x["s"] - acc["pos"]), mark[x["kind"]])
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(fresh, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    new = F.aggregate("spans", start, put, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text), a["pos"] + 1, F.length(text))))
    joined = plain.join(found, plain[doc_id].eqNullSafe(found["hit_id"]) & (plain["h"] == found["hit_hash"]), "left")
    out = joined.withColumn(text, F.when(F.col("spans").isNotNull(), new).otherwise(F.col(text)))
    if "n_chars" in names:
        count = f"c{names.index('n_chars')}"
        out = out.withColumn(count, F.when(F.col("spans").isNotNull(), F.length(text).cast(dict(plain.dtypes)[count])).otherwise(F.col(count)))
    return out.select(*plain.columns[: len(names)]).toDF(*names)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(_all_spans()).alias("spans"))


QUERIES = {"op1_privacy": op1}
ORACLE_SQL: dict[str, str] = {}
