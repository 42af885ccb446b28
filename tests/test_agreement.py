"""Agreement over dependency paths, and elision undone."""

from __future__ import annotations

from pyspark.sql import functions as F

from isogloss.operators import agreement as A

FORMS = [("blanca", "blanc", "f"), ("blanc", "blanc", "m"), ("dolça", "dolç", "f"), ("dolç", "dolç", "m"), ("cremosa", "cremós", "f"), ("cremós", "cremós", "m"), ("la", "el", "f"), ("el", "el", "m"), ("desfeta", "desfet", "f"), ("desfet", "desfet", "m"), ("inclosa", "inclòs", "f"), ("inclòs", "inclòs", "m"), ("alta", "alt", "f"), ("alt", "alt", "m"), ("parlada", "parlat", "f"), ("parlat", "parlat", "m")]
COLUMNS = "k int, i int, translated string, rule string, gender string, head int, dep string, agrees boolean, participle boolean, lemma string, relative boolean"


def agreed(spark, *words):
    """words: (text, head, dep, kind): kind is n(oun, rewritten to a masculine), N (another), a(djective), p(articiple), r(elative), or a lemma."""
    rows = []
    for i, (text, head, dep, kind) in enumerate(words):
        rows.append((1, i, text, "lexicon" if kind == "n" else None, "m" if kind == "n" else "f" if kind == "N" else None, head, dep, kind in "ap", kind == "p", kind if len(kind) > 1 else text, kind == "r"))
    m = spark.createDataFrame([(f, lemma, "adj", g, "sg") for f, lemma, g in FORMS], "form string, lemma string, cat string, gender string, number string")
    out = A.path_agreed(spark.createDataFrame(rows, COLUMNS), "k", m)
    return " ".join(r.translated for r in out.orderBy("i").collect())


def test_noun_phrase_and_predicates(spark):
    assert agreed(spark, ("La", 1, "det", "a"), ("xocolate", 4, "nsubj", "n"), ("blanca", 1, "amod", "a"), ("és", 4, "cop", "ser"), ("dolça", None, "root", "a"), ("i", 6, "cc", "x"), ("cremosa", 4, "conj", "a")) == "El xocolate blanc és dolç i cremós"
    assert agreed(spark, ("xocolate", 2, "nsubj", "n"), ("desfeta", 0, "acl", "p"), ("arriba", None, "root", "x")) == "xocolate desfet arriba"


def test_relatives_reach_the_noun(spark):
    assert agreed(spark, ("gasto", None, "root", "n"), ("que", 3, "nsubj", "r"), ("és", 3, "cop", "ser"), ("alta", 0, "acl:relcl", "a")) == "gasto que és alt"


def test_paths_stop(spark):
    # A participle with a complement of its own, a compound tense, another noun, and circles.
    assert agreed(spark, ("gastos", None, "root", "n"), ("inclosa", 0, "acl", "p"), ("la", 3, "det", "a"), ("obra", 1, "obj", "N")) == "gastos inclosa la obra"
    assert agreed(spark, ("gastos", None, "root", "n"), ("desfeta", 0, "acl", "p"), ("a", 3, "case", "x"), ("obra", 1, "obl", "N")) == "gastos desfet a obra"
    assert agreed(spark, ("gasto", 2, "nsubj", "n"), ("ha", 2, "aux", "haver"), ("parlada", None, "root", "p")) == "gasto ha parlada"
    assert agreed(spark, ("gasto", 3, "nsubj", "n"), ("ha", 3, "aux", "haver"), ("sigut", 3, "aux:pass", "ser"), ("parlada", None, "root", "p")) == "gasto ha sigut parlat"
    assert agreed(spark, ("la", 1, "det", "a"), ("taula", None, "root", "N"), ("blanca", 1, "amod", "a"), ("vas", 1, "nmod", "n"), ("alta", 3, "amod", "a")) == "la taula blanca vas alt"
    assert agreed(spark, ("gasto", None, "root", "n"), ("alta", 2, "amod", "a"), ("dolça", 1, "conj", "a")) == "gasto alta dolça"


def test_long_chains_settle(spark):
    chain = [("gasto", None, "root", "n")] + [("alta", i, "conj", "a") for i in range(40)]
    assert agreed(spark, *chain) == " ".join(["gasto"] + ["alt"] * 40)


def test_elision_is_undone(spark):
    rows = [(0, 0, "l'granera", "lexicon", "f"), (1, 0, "L'poal", "lexicon", "m"), (2, 0, "d'vivenda", "lexicon", None), (3, 0, "l'espill", "lexicon", "m"), (4, 0, "L'VIVENDA", "lexicon", "f"), (5, 0, "l'casa", None, "f"), (8, 0, "l'hora", "lexicon", "f"),
            (6, 0, "Al", None, None), (6, 1, " ", None, None), (6, 2, "espill", "lexicon", "m"), (7, 0, "al", None, None), (7, 1, " ", None, None), (7, 2, "poal", "lexicon", "m"), (9, 0, "al", None, None), (9, 1, " ", None, None), (9, 2, "ull", None, "m")]
    df = spark.createDataFrame(rows, "k int, i int, translated string, rule string, gender string")
    out = A.undone_elision(df, "k", {"d": "de", "l": ("el", "la")}, {"al": "a l'", "del": "de l'"}).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "translated"))), lambda x: x["translated"]), "").alias("t"))
    assert [r.t for r in out.orderBy("k").collect()] == ["la granera", "El poal", "de vivenda", "l'espill", "LA VIVENDA", "l'casa", "A l'espill", "al poal", "l'hora", "al ull"]
