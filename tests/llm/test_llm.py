"""The training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from isogloss.llm import decontaminate, language_id, mixing, near_dups, privacy, quality_model, quality_rules, substrings, token_counts, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, h string, row string, TEXT string"
LONG = "very long text of words " * 4000


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, extra columns with clashing names."""
    rows = [
        (1, "one two three four five six", "en", "b", 5, 1, "x", "y", "z"), (1, "one two three four five six", "en", "b", 5, 1, "x", "y", "z"), (None, "mail me: a.b@c.org or +34 612 345 678", "fr", None, 1, 2, None, None, None),
        (None, None, None, None, None, None, None, None, None), (2, "", "en", "a", 0, 0, "", "", ""), (3, "   \n\n ", "de", "a", 5, 0, "", "", ""), (4, LONG, "en", "a", 5, 0, "", "", ""), (4, "other text, the same id", "en", "a", 5, 0, "", "", ""),
        (5, "123 456 !!! ###", "es", "c", 1, 1, "", "", ""), (6, "ÉÈ ünïcode 日本語 😀 text", "fr", "c", 1, 1, "", "", ""), (None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


# --- op1 ---

RULES = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def spans_of(text):
    out = []
    for k, (kind, rule) in enumerate(RULES):
        for m in rule.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_privacy_spans(spark, docs):
    rnd = random.Random(3)
    bits = ["1", "2", "4", "0", "25", "255", "256", ".", ".", " ", "-", "+", "@", "a", "b.c", "é", "😀", "%", "(", ")", "4111111111111111", "5500-0000-0000-0004", "+34 612 345 678", "x@y.z", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 50))) for _ in range(1500)] + [r.text for r in docs.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", privacy.base_spans(F.col("text")).alias("b")).collect():
        assert [(b.s, b.k, b.e, b.kind) for b in r.b] == spans_of(texts[r.i]), texts[r.i]


def test_privacy_discloses(spark):
    near = [(i, "the clerk Vizcaino wrote to ana@mail.org on a day about paper") for i in range(6)]
    far = [(100 + i, "the clerk wrote about paper on a day and nothing else happened") for i in range(60)]
    out = {r.doc_id: r.text for r in privacy.sanitised(spark.createDataFrame(near + far, "doc_id long, text string")).collect()}
    assert all("[EMAIL]" in out[i] and "Vizcaino" not in out[i] and "clerk" in out[i] for i, _ in near)
    assert all(out[i] == t for i, t in far)


def test_privacy_edges(edge, empty):
    got = privacy.found_spans(edge)
    assert ids(got) == ids(edge)
    assert sorted(r.n for r in got.select(F.size("base").alias("n")).collect()) == [0] * 10 + [2]
    assert privacy.found_spans(empty).count() == 0
    assert privacy.sanitised(edge).count() == 11 and near_dups.keep_one(edge).count() < 11


def disclosed(docs):
    """The docstring of the operator written out, document by document: base spans, and (s, e, action) of terms."""
    letters = regex.compile(r"\p{L}+")
    base = [spans_of(t) for _, t in docs]

    def entity(t, b):
        v = t[b[0] : b[2]]
        return f"{b[3]}:{re.sub('[^0-9]', '', v) if b[3] in ('card', 'phone') else v.lower()}"

    near, df_e, df_t, df_et = [], Counter(), Counter(), Counter()
    for (_, t), bs in zip(docs, base):
        here = []
        for b in bs:
            lo, hi = max(0, b[0] - privacy.CONTEXT), min(len(t), b[2] + privacy.CONTEXT)
            words = [(m.start() + lo, m.end() + lo) for m in letters.finditer(t[lo : b[0]]) if m.start() > 0 or lo == 0]
            words += [(m.start() + b[2], m.end() + b[2]) for m in letters.finditer(t[b[2] : hi]) if m.end() + b[2] < hi or hi == len(t)]
            here += [(entity(t, b), t[s:e].lower(), s, e) for s, e in words if e - s >= privacy.TERM and not any(x[0] < e and s < x[2] for x in bs)]
        near.append(here)
        df_et.update({(e, w) for e, w, _, _ in here})
        df_e.update({entity(t, b) for b in bs})
        df_t.update({w for w in letters.findall(t.lower()) if len(w) >= privacy.TERM})
    act = {}
    for (e, w), n in df_et.items():
        if min(n, df_e[e], df_t[w]) >= privacy.SUPPORT and df_e[e] < len(docs):
            d = math.log2(len(docs) * n / (df_e[e] * df_t[w])) / math.log2(len(docs) / df_e[e])
            if d >= privacy.GENERALISE:
                act[e, w] = "drop" if d >= privacy.REMOVE else "term"
    out = []
    for bs, here in zip(base, near):
        extra = {}
        for e, w, s, z in here:
            if a := act.get((e, w)):
                extra[s, z] = min(a, extra.get((s, z), a))
        out.append((bs, sorted(bs + [(s, 4, z, a) for (s, z), a in extra.items()])))
    return out


def listed(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


def test_privacy_brute_force(spark, docs, sf):
    """All output columns of the query, and the stage's texts, on whole documents."""
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    exp = {d: x for (d, _), x in zip(rows, disclosed(rows))}
    assert any(k == 4 for _, all_ in exp.values() for _, k, _, _ in all_)
    for r in privacy.op1(spark, sf).collect():
        base, all_ = exp[r.doc_id]
        n = Counter(b[3] for b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest() and r.spans == listed(all_)
    texts = dict(rows)
    for r in privacy.sanitised(docs).collect():
        t, out, pos = texts[r.doc_id], [], 0
        for s, _, e, kind in exp[r.doc_id][1]:
            if s >= pos:
                out += [t[pos:s], privacy.MARKS[kind]]
            pos = max(pos, e)
        assert (r.text or "") == "".join(out) + t[pos:]


def test_stages_keep_columns(edge, empty):
    """Clashing names, nulls, repeated rows and empty tables pass through the last two stages."""
    clean = privacy.sanitised(edge)
    assert clean.columns == edge.columns and ids(clean) == ids(edge)
    assert clean.filter("h = 'x' and row = 'y' and n_words = 1").count() == 2
    assert clean.toDF(*[f"c{i}" for i in range(len(clean.columns))]).filter("c1 like '%a.b@c.org%'").isEmpty()
    assert privacy.sanitised(empty).count() == 0
    mixed = mixing.mixed(edge)
    assert mixed.columns == [*edge.columns, "mix_size", "mix_target", "mix_taken"]
    assert mixed.agg(F.sum("mix_taken")).first()[0] == mixing.mix(edge).agg(F.sum("taken")).first()[0]
    # Repeated rows are one row of the mix; what has no words isn't taken.
    assert mixed.filter("doc_id = 1").count() == 1 and mixed.filter("mix_size = 0").isEmpty()
    assert mixing.mixed(empty).count() == 0


# --- op2 ---


def test_warc_round_trip(spark, sf, tmp_path):
    d = warc.derivatives(warc.responses(spark.read.parquet(f"{sf}/pages.parquet")))
    warc.write(d, str(tmp_path / "w"))
    r = warc.read(spark, str(tmp_path / "w"))
    assert r.count() == d.count() and r.filter("not whole").isEmpty()
    j = r.alias("r").join(d.alias("d"), "record_id").filter("r.block = d.block and r.refers_to = d.refers_to and r.block_digest = d.block_digest")
    assert j.count() == d.count()


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "http://a.b/", "<p>x &lt; y</p><script>z</script>", "x"), (1, None, None, "x")], "page_id long, url string, html string, HTML string")
    d = warc.derivatives(warc.responses(pages))
    assert d.count() == 6 and d.filter("block = 'x < y'").count() == 1
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_read_by_length(spark, tmp_path):
    """Blocks that hold version lines, both versions, kept digests, and files that are cut off."""
    def rec(version, kind, name, block, more="", size=None):
        return f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nwarc-target-uri: http://x/{name}\r\n{more}Content-Length: {len(block.encode()) if size is None else size}\r\n\r\n{block}\r\n\r\n"

    page = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>é WARC/1.0\r\nWARC-Type: response\r\n\r\n WARC/1.1 x</p>"
    whole = rec("1.0", "warcinfo", "i", "software: x") + rec("1.1", "response", "a", page, "WARC-Payload-Digest: sha1:ABC\r\n") + rec("1.1", "response", "b", "WARC/1.") + rec("1.0", "response", "c", "")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.warc").write_bytes(whole.encode())
    (tmp_path / "w" / "two.warc").write_bytes((rec("1.0", "response", "d", "full") + rec("1.0", "response", "e", "cut", size=500)).encode())
    r = warc.read(spark, str(tmp_path / "w"))
    got = {x.record_id: (x.record_type, x.block, x.whole) for x in r.collect()}
    assert got == {"<i>": ("warcinfo", "software: x", True), "<a>": ("response", page, True), "<b>": ("response", "WARC/1.", True), "<c>": ("response", "", True), "<d>": ("response", "full", True), "<e>": ("response", "cut", False)}
    found = {x.record_id: x for x in warc.responses_of(r).collect()}
    assert set(found) == {"<a>", "<b>", "<c>", "<d>"} and [x.record_id for x in warc.broken(r).collect()] == ["<e>"]
    assert found["<a>"].payload_digest == "sha1:ABC" and found["<a>"].headers.startswith("HTTP/1.1 200 OK") and found["<a>"].payload.startswith("<p>é WARC/1.0")
    assert found["<d>"].payload_digest == "sha256:" + hashlib.sha256(b"full").hexdigest()
    d = warc.derivatives(warc.responses_of(r)).filter("refers_to = '<a>'").collect()
    assert len(d) == 2 and all(x.source_digest == "sha1:ABC" and x.target_uri == "http://x/a" for x in d)


def test_warc_hard_pages(spark, tmp_path):
    """Pages that would take the square of their length, a broken address, and a clashing column."""
    pages = [(1, "http://a/\r\nX: y", "<p>long</p> " * 20_000, ""), (2, "u", "<script " * 50_000, ""), (3, "u", "<" * 300_000, ""), (4, "u", "<!-- x" * 50_000 + "tail", ""), (5, "u", "<a title='x<y'>z</a>", "")]
    d = warc.derivatives(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string, HTML string")))
    text = {x.page_id: x.block for x in d.filter("record_type = 'conversion'").collect()}
    assert text[1].count("long") == 20_000 and text[2] == "" and text[4] == "" and text[5] == "z"
    warc.write(d, str(tmp_path / "w"))
    r = warc.read(spark, str(tmp_path / "w"))
    assert r.count() == 10 and warc.broken(r).isEmpty() and r.filter("target_uri = 'http://a/%0D%0AX: y'").count() == 2


# --- op3 ---


def contaminated(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    pats = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            pats.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in pats}:
            for k in range(len(w) - n + 1):
                if o := pats.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= o
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination(spark, docs, edge, empty, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").union(spark.createDataFrame([(900, "Of the"), (901, None), (None, "five six"), (902, ""), (900, "text")], "item_id long, text string"))
    items = [tuple(r) for r in bench.collect()]
    both = docs.select("doc_id", "text").union(edge.toDF(*[f"c{i}" for i in range(9)]).select("c0", "c1"))
    rows = [tuple(r) for r in both.collect()]
    exp = contaminated(rows, items)
    key = lambda df: sorted((str(r.doc_id), *r[1:]) for r in df.collect())
    assert key(decontaminate.contamination(both, bench)) == exp
    assert key(decontaminate.contamination(both, bench, pattern_bytes=3000)) == exp
    bad = sum(x[5] for x in exp)
    assert bad and decontaminate.clean(both, bench).count() == len(rows) - bad == decontaminate.clean(both, bench, pattern_bytes=3000).count()
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(both, bench.limit(0)).filter("contaminated").isEmpty()
    assert decontaminate.clean(edge, bench.limit(0)).count() == 11 and decontaminate.clean(empty, bench).count() == 0


def test_decontamination_of_frequent_words(spark):
    """One-word items, long texts, and words whose hashes agree by their bytes only."""
    rnd = random.Random(5)
    words = ["it", "is", "une", "été", "x1", "zz"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(200)] + [(900, "it is " * 300_000)]
    items = [(1, "it"), (2, "is it"), (3, "IS"), (4, "été x1 zz"), (5, " ".join(["it", "is"] * 7)), (6, "it"), (7, " ".join(rnd.choice(words) for _ in range(40)))]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == contaminated(rows, items)


def test_search_is_bounded():
    """What is sent to executors grows with the benchmark's bytes at a known rate."""
    import pickle

    rnd = random.Random(6)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [(str(i), text(100)) for i in range(1000)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontaminate.Search(items))) < 12 * size + (8 << 20)


# --- op4 and op7 have SQL; their edge cases are here ---


def test_quality_rules_edges(edge, empty):
    got = quality_rules.judged(edge)
    assert ids(got) == ids(edge)
    assert got.filter("n_words = 0").count() == 4 and got.filter("n_words = 0 and not base_failed").isEmpty()
    assert quality_rules.judged(empty).count() == 0


def test_quality_rules_adapt(spark):
    """A habit of a whole source is no fault there, but is one elsewhere."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    text = lambda mark: " ".join(word() + mark for _ in range(80))
    rows = [(i, text("#"), "en", "code") for i in range(250)] + [(1000 + i, text(""), "en", "prose") for i in range(250)] + [(2000, text("#"), "en", "prose")]
    got = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(250)) and all(got[1000 + i] for i in range(250)) and not got[2000]


def test_mixing(spark, edge, empty):
    got = mixing.mix(edge).toPandas()
    assert len(got) == 11 and (got["taken"] <= 2 * got["size"]).all()
    total = got["size"].sum()
    assert got["taken"].sum() == total * 3 // 2
    assert mixing.mix(empty).count() == 0
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randint(1, 50), f"s{rnd.choice('0000123')}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = mixing.mix(df).toPandas()
    for _, g in p.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 60
    again = mixing.mix(df.repartition(7)).toPandas()
    assert p.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert mixing.mixed(df).agg(F.sum("mix_taken")).first()[0] == p["taken"].sum()


# --- op5 ---


def without_repeats(docs, n):
    raws = [(d, (t or "").encode()) for d, t in docs]
    name = lambda x: hashlib.blake2b(x, digest_size=12).digest()
    c = Counter(name(b[i : i + n]) for _, b in raws for i in range(len(b) - n + 1))
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if c[name(b[i : i + n])] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(d), len(b), sum(gone), sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removed(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("group", [1024, 2])
def test_substrings(spark, empty, group):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abé ") for _ in range(200)) for _ in range(6)]
    rows = []
    for i in range(80):
        t = list(rnd.choice(base) + rnd.choice(base) + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))))
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        rows.append((i, "".join(t)))
    rows += [(200, None), (201, ""), (None, "a" * 500), (None, "ab" * 300), (202, rows[0][1]), (202, rows[0][1]), (203, "q" * 39)]
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 40, 8, group)
    assert removed(got) == without_repeats(rows, 40)
    assert substrings.deduplicated(empty).count() == 0


def test_substrings_of_documents(spark, docs, edge):
    """Whole tables at the production length; a text beyond the size of a chunk."""
    rnd = random.Random(7)
    long = "".join(rnd.choice("abcd ") for _ in range(substrings.CHUNK * 2 + 5000))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(r.doc_id, r.text) for r in edge.collect()] + [(9001, long[substrings.CHUNK - 900 : substrings.CHUNK + 900])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(substrings.deduplicated(df)) == without_repeats(rows, 400)
    got = {r.doc_id: r.n_removed for r in substrings.deduplicated(spark.createDataFrame([(1, long), (2, long[substrings.CHUNK - 900 : substrings.CHUNK + 900])], "doc_id long, text string")).collect()}
    assert got == {1: 1800, 2: 1800}


def test_substrings_of_near_copies(spark):
    """One trigger with thousands of distinct phrases."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    base, rows = [word() for _ in range(130)], []
    for i in range(5000):
        t = list(base)
        for _ in range(rnd.randint(1, 2)):
            t[rnd.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert removed(got) == without_repeats(rows, 400)


# --- op6, op8: held-out accuracy ---


def test_language_id(spark, docs, edge, empty):
    got = language_id.identify(docs, language_id.fit(language_id.learn_rows(docs))).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    assert got["score"].between(0, 1).all()
    e = language_id.identify(edge, language_id.fit(language_id.learn_rows(edge)))
    assert ids(e) == ids(edge) and e.filter("lang_pred = 'und' and score = 0").count() == 5
    assert language_id.identify(edge, language_id.fit(language_id.learn_rows(empty))).filter("lang_pred <> 'und'").isEmpty()
    assert language_id.identify(empty, language_id.fit(language_id.learn_rows(empty))).count() == 0
    assert language_id.accepted(edge, language_id.fit(language_id.learn_rows(edge))).count() == 6


def test_language_repeatable(spark, docs):
    """Neither partitions nor neighbours change a result, and few letters give a low score."""
    model = language_id.fit(language_id.learn_rows(docs))
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, "a"), (-2, "\u65e5"), (-3, "de la")], "doc_id long, text string"))
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score, tuple(r.langs)) for r in df.collect())
    got = key(language_id.identify(more, model))
    assert got == key(language_id.identify(more.repartition(13), model)) == key(language_id.identify(more.orderBy(F.desc("text")).coalesce(1), model))
    few = {d: s for d, _, s, _ in got if d < 0}
    assert few[-1] == 1 / len(model.langs)


def test_language_brute_force(docs):
    """Mixture inference written out gram by gram, for a few documents."""
    import math

    import numpy as np

    model = language_id.fit(language_id.learn_rows(docs))
    k = len(model.langs)

    def em(grams, langs):
        pi, n = {j: 1 / len(langs) for j in langs}, sum(grams.values())
        for _ in range(language_id.ROUNDS):
            new = dict.fromkeys(langs, 0.0)
            for g, c in grams.items():
                whole = sum(pi[j] * model.probs[j, g] for j in langs)
                for j in langs:
                    new[j] += c * pi[j] * model.probs[j, g] / whole / n
            total = sum(new.values())
            new = {j: x / total for j, x in new.items()}
            moved, pi = max(abs(new[j] - pi[j]) for j in langs), new
            if moved < language_id.STILL:
                break
        return pi, sum(c * math.log(sum(pi[j] * model.probs[j, g] for j in langs)) for g, c in grams.items())

    texts = [r.text for r in docs.filter("text is not null").orderBy(F.length("text")).limit(40).collect()]
    texts.append(texts[-1] + " " + docs.filter("lang = 'es'").agg(F.min_by("text", "doc_id")).first()[0][:2000] + docs.filter("lang = 'de'").agg(F.min_by("text", "doc_id")).first()[0][:2000])
    for t in texts:
        raw = t.encode()
        code, _ = language_id.gram_codes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        grams = Counter(code.tolist())
        langs, scores, sets = model.predict(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if not grams or langs == ["und"]:
            continue
        single = [sum(c * math.log(model.probs[j, g]) for g, c in grams.items()) for j in range(k)]
        chosen, like = [max(range(k), key=lambda j: (single[j], -j))], max(single)
        pi, full = {chosen[0]: 1.0}, em(grams, list(range(k)))[0]
        for j in sorted(range(k), key=lambda j: (-full[j], j)):
            if j in chosen:
                continue
            if full[j] < language_id.LEAST:
                break
            tried, got = em(grams, [*chosen, j])
            if (got - like) / language_id.OVERLAP <= 0.5 * math.log(max(sum(grams.values()), 2)):
                break
            chosen, like, pi = [*chosen, j], got, tried
        top = max(chosen, key=lambda j: (pi[j], -j))
        assert langs == [model.langs[top]] and abs(scores[0] - pi[top]) < 1e-9
        assert sets == [[model.langs[j] for j in sorted(chosen)]]


def test_language_mixture(docs):
    model = language_id.fit(language_id.learn_rows(docs))
    rows = {lang: docs.filter(F.col("lang") == lang).agg(F.max_by("text", F.length("text"))).first()[0] for lang in ("de", "es")}
    both = docs.sparkSession.createDataFrame([(1, rows["de"][:3000] + " " + rows["es"][:3000]), (2, rows["de"])], "doc_id long, text string")
    sets = {r.doc_id: sorted(r.langs) for r in language_id.identify(both, model).collect()}
    assert {"de", "es"} <= set(sets[1]) and sets[2] == ["de"]


def test_quality_model(spark, edge, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.learn(docs, labels)
    got = quality_model.scored(docs, model).filter("held_out").join(labels, "doc_id").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    e = quality_model.scored(edge, model)
    assert ids(e) == ids(edge) and e.filter("score between 0 and 1").count() == 11
    assert quality_model.scored(empty, quality_model.learn(empty, labels.limit(0))).count() == 0


def test_quality_model_written_out():
    """Scores are sums of table entries, looked up one by one; pairs that only interact are found, also among features of few values."""
    import numpy as np

    rnd = np.random.default_rng(3)
    x = np.round(rnd.random((4000, len(quality_model.FEATURES))), 3)
    x[:, 2] = rnd.integers(0, 3, 4000)  # few values
    y = ((x[:, 2] >= 1) ^ (x[:, 5] > 0.5)).astype(float)
    m = quality_model.fit(x, y)
    assert (2, 5) in m.pairs and ((m.scores(x) >= 0.5) == y).mean() > 0.97
    for row, s in zip(x[:50], m.scores(x[:50])):
        b = [sum(v >= e for e in edges) for v, edges in zip(row, m.edges)]
        z = m.base + sum(t[k] for t, k in zip(m.tables, b))
        for (i, j), t in zip(m.pairs, m.pair_tables):
            ci, cj = (b[f] * quality_model.COARSE // max(quality_model.COARSE, len(m.edges[f]) + 1) for f in (i, j))
            z += t[ci * quality_model.COARSE + cj]
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9


# --- op9 ---


def test_near_duplicates(spark, docs, empty):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (1000, ""), (1001, " "), (1002, "one two"), (1002, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [fp(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    exp = sorted((str(d), format(f, "016x"), least[x]) for (d, _), f, x in zip(rows, fps, label))
    got = near_dups.near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    assert sorted((str(r.doc_id), r.f, r.component_id) for r in got.collect()) == exp
    assert near_dups.near_duplicates(empty).count() == 0
    again = near_dups.near_duplicates(df, blocks=8).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    assert sorted((str(r.doc_id), r.f, r.component_id) for r in again.collect()) == exp


def test_keep_one(spark, docs, edge, empty):
    """All pairs within seven bits of two-word shingles, whatever blocks they share."""
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(r.doc_id, r.text) for r in edge.collect()]
    fps = [near_dups.fingerprint((t or "").encode(), 2) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 7:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dups.keep_one(df).collect()
    assert len(kept) == len(set(label))
    one = {}
    for (d, t), x in zip(rows, label):
        one.setdefault(x, set()).add((d is None, d or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept) == Counter(min(v) for v in one.values())
    assert near_dups.keep_one(edge).columns == edge.columns and near_dups.keep_one(empty).count() == 0
    assert ids(near_dups.near_duplicates(edge)) == ids(edge)


def test_blocks_follow_the_size():
    assert near_dups.blocks_for(50_000) == 6 and near_dups.blocks_for(10**9) > 6 and near_dups.blocks_for(4 * 10**10) <= 10


def test_split_buckets(spark):
    """A bucket beyond its slot gives the same components."""
    rnd = random.Random(4)
    fps = {rnd.getrandbits(6) | 1 << 40 for _ in range(40)} | {rnd.getrandbits(63) for _ in range(200)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    parts = [sorted((r.node, r.root) for r in near_dups.components(near_dups.links(df, slot=s)).collect()) for s in (1024, 4)]
    assert parts[0] == parts[1] and len(parts[0]) > 10


def test_native_hash_agrees(spark):
    assert near_dups.fingerprint(b"A b") & (2**64 - 1) == spark.sql("select xxhash64('a b') x").first()["x"] & (2**64 - 1)


# --- op10 ---


def test_token_counts(spark, docs, edge, empty):
    pieces = ["▁".encode(), "▁th".encode(), b"th", b"e", b"er", "▁the".encode(), b"a", b"in", b"ing", "é".encode(), b"on", b"tion"]
    v = token_counts.Pieces.of(pieces)
    best = {p: v.by_length[len(p)] for p in pieces}
    import numpy as np

    score = {p: int(round(-np.log(r + 1) * 1000)) * (1 << 20) - 1 for r, p in enumerate(pieces, 1)}
    assert best

    def tokens(word):
        w = token_counts.MARK + word
        s = [(0, 0)]
        for i in range(1, len(w) + 1):
            cand = [(s[i - 1][0] + v.unknown, s[i - 1][1] + 1)] + [(s[i - n][0] + score[w[i - n : i]], s[i - n][1] + 1) for n in range(1, min(8, i) + 1) if w[i - n : i] in score]
            s.append(max(cand, key=lambda c: c[0]))
        return s[-1][1]

    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(None, None), (7, ""), (8, "ðe " * 50), (9, "thering" * 900 + " " + "ðon" * 100), (10, "x" * 70_000)]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), pieces)
    exp = sorted((str(d), len((t or "").encode().split()), sum(map(tokens, (t or "").encode().split()))) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in got.collect()) == exp
    assert ids(token_counts.token_counts(edge, pieces)) == ids(edge)
    assert token_counts.token_counts(empty, pieces).count() == 0
