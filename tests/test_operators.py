"""Cases worked by hand, and invariants, for what SQL doesn't cover."""

from __future__ import annotations

import random
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from isogloss.functions import predicates as P
from isogloss.functions import segment as S
from isogloss.functions import text as T
from isogloss.operators import evaluate as E
from isogloss.operators import markers as M
from isogloss.operators import pairs as R
from isogloss.operators import rewrite as W
from isogloss.operators import selection as L
from isogloss.plans import registry
from isogloss.sources import readers, writers
from isogloss.streaming import jobs


def one(spark, make, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(make(*[F.col(c) for c in cols]).alias("x")).first()["x"]


def test_tokens_and_keys(spark):
    assert one(spark, T.tokens, t="Col·lidisca d'aquestes vint-i-tres 2022") == ["col·lidisca", "d", "aquestes", "vint-i-tres"]
    assert one(spark, T.repeat_text, t="Hola, món 2022.") == one(spark, T.repeat_text, t="hola  MÓN.")
    assert one(spark, T.lossless, t="d'escola, 18,5 €") == ["d'escola", ",", " ", "18,5", " ", "€"]
    assert one(spark, lambda c: T.detokenise(T.lossless(c)), t="a  b\n(c)") == "a  b\n(c)"
    assert one(spark, T.lookup_word, t="d'aquestes") == "aquestes"
    assert one(spark, T.lookup_word, t=",") is None


def test_repair_breaks(spark):
    assert one(spark, T.repair_breaks, t="[01/02/2020] A short\nline goes on\n\n\nand stops here .\n, so") == "A short line goes on\n\nand stops here., so"
    assert one(spark, T.repair_breaks, t="Done.\nNext.") == "Done.\nNext."


def test_segments(spark):
    assert one(spark, S.sentences, t="One. Two! three? «Four»") == ["One.", "Two! three?", "«Four»"]
    assert one(spark, lambda c: S.rejoined(S.sentences(c)), t="El Sr. Vidal ve. Bé.") == ["El Sr. Vidal ve.", "Bé."]


def test_valid_sentence(spark):
    assert one(spark, P.valid_sentence, t="This service will be given all the year to the people.")
    assert not one(spark, P.valid_sentence, t="a) This service will be given all the year to people.")
    assert not one(spark, P.valid_sentence, t="Only three words.")


def test_index_of_counts(spark):
    forms = spark.createDataFrame([("un", "occ"), ("dos", "or")], "form string, side string")
    texts = spark.createDataFrame([(1, "un un dos tres"), (2, "tres"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: (r.words, r.occ, r.other, r["index"], r.gdv) for r in M.scored(texts, ["id"], forms).collect()}
    assert got == {1: (4, 2, 1, 2 / 3, 0.75), 2: (1, 0, 0, None, 1.0), 3: (0, 0, 0, None, 1.0), 4: (0, 0, 0, None, 1.0)}


def test_sums_of_parts_score_the_whole(spark):
    forms = spark.createDataFrame([("a", "occ"), ("b", "or")], "form string, side string")
    parts = spark.createDataFrame([(1, "a b a"), (2, "b")], "id int, text string")
    c = M.counted(parts, ["id"], forms).agg(F.sum("occ").alias("o"), F.sum("other").alias("e")).first()
    whole = M.counted(spark.createDataFrame([(1, "a b a b")], "id int, text string"), ["id"], forms).first()
    assert (c.o, c.e) == (whole.occ, whole.other)


def test_longest_hits(spark):
    phrases = spark.createDataFrame([("a b", "occ"), ("a", "or"), ("b c", "occ"), ("a b", "or")], "phrase string, side string")
    texts = spark.createDataFrame([(1, "a b c a")], "id int, text string")
    got = M.longest_hits(M.phrase_hits(texts, ["id"], phrases, 2), ["id"]).select("i", "phrase", "side").collect()
    assert sorted(map(tuple, got)) == [(0, "a b", "occ"), (0, "a b", "or"), (3, "a", "or")]


def test_word_edits(spark):
    assert one(spark, E.word_edits, a="el gat negre", b="el gos molt negre") == 2
    assert one(spark, E.word_edits, a="", b="un dos") == 2
    assert one(spark, E.word_edits, a="igual", b="igual") == 0


def test_bleu_and_chrf(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "x", "a b"), (3, "a b c d", "a b c d e")], "id int, h string, r string")
    bleu = {r.id: r.bleu for r in E.bleu(df, "id", "h", "r").collect()}
    assert abs(bleu[1] - 100) < 1e-9 and abs(bleu[3] - 100 * 2.718281828459045 ** (1 - 5 / 4)) < 1e-9 and bleu[2] < 20
    chrf = {r.id: r.chrf for r in E.chrf(df, "id", "h", "r", 2).collect()}
    assert abs(chrf[1] - 100) < 1e-9 and chrf[2] == 0 and 0 < chrf[3] < 100


def test_judge_score(spark):
    assert one(spark, E.judge_score, s=["major", "minor", "minor"]) == 85.0


def test_diff_ops(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "y", "c"]), (2, [], [])], "id int, ta array<string>, tb array<string>")
    got = {r.id: (r.ratio, [tuple(o) for o in r.ops]) for r in R.diff_ops(df).collect()}
    assert got == {1: (4 / 7, [("replace", 1, 2, 1, 3)]), 2: (1.0, [])}


def test_content_alignment(spark):
    w = lambda i: "abcdefghij"[i]
    a = spark.createDataFrame([(1, i, f"word{w(i)} other{w(i)} last{w(i)}") for i in range(10)], "doc int, no int, text string")
    b = spark.createDataFrame([(1, k, f"word{w(i)} other{w(i)} more") for k, i in enumerate([0, 1, 2, 4, 5, 6, 7, 8, 9])], "doc int, no int, text string")
    got = sorted((r.i, r.j) for r in R.align_by_content(a, b).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 7), (9, 8)]


def test_elision(spark):
    t = W.token_table(spark.createDataFrame([(1, "El gat mira")], "id int, text string"), "id")
    lex = spark.createDataFrame([("gat", "ocell")], "form string, put string")
    t = W.repair_elision(W.first_proposal(W.by_lookup(t, lex, "lexicon"), ["lexicon"]), "id", {"el": "l'"})
    assert W.rewritten(t, "id").first()["text"] == "L'ocell mira"


def test_split_keeps_groups_whole(spark):
    rows = spark.createDataFrame([(i // 7, i) for i in range(700)], "g int, i int")
    s = L.split_by_group(rows, "g", "x", 0.1, 0.1)
    assert s.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(n.values()) == 700 and 70 <= n["test"] < 77 and 63 <= n["dev"] <= 77


def test_coverage_fills_quotas(spark):
    pool = spark.createDataFrame([(i, ["a"] if i % 10 else ["a", "b"]) for i in range(100)], "id int, labels array<string>")
    got = L.coverage(pool, "id", "labels", 10, 5).collect()
    assert len({r.id for r in got}) == len(got) <= 10
    assert sum("b" in r.labels for r in got) >= 5


def test_verb_forms_keep_prefix_and_enclitics(spark):
    words = ["tenir-los", "Tenir", "d'eixir", "d'eixir-ne", "traure'n", "res", ",", "mana"]
    t = spark.createDataFrame([(1, i, w, "NOUN" if w == "mana" else "VERB") for i, w in enumerate(words)], "id int, i int, surface string, pos string")
    lex = spark.createDataFrame([("tenir", "tindre", False), ("eixir", "sortir", False), ("traure", "treur", False), ("mana", "ordena", True)], "form string, put string, gated boolean")
    got = {r.surface: r.put for r in W.by_verb_form(t, lex, "put", "pos").collect()}
    assert got == {"tenir-los": "tindre'ls", "Tenir": "Tindre", "d'eixir": "d'sortir", "d'eixir-ne": "d'sortir-ne", "traure'n": "treur-ne", "res": None, ",": None, "mana": None}


def test_contraction_and_agreement(spark):
    t = W.token_table(spark.createDataFrame([(1, "A el cotxe. El taula a el sol")], "id int, text string"), "id")
    lex = spark.createDataFrame([("cotxe", "carro"), ("taula", "mesa")], "form string, put string")
    t = W.first_proposal(W.by_lookup(t, lex, "lexicon"), ["lexicon"]).withColumn("gender", F.when(F.col("translated") == "mesa", "f"))
    t = W.agreed(W.contracted(t, "id", [("a", "el", "al")]), "id", [("el", "la")], "gender")
    assert W.rewritten(t, "id").first()["text"] == "Al carro. La mesa a el sol"


def test_zipped_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "corpus.zip", "w") as z:
        z.writestr("a.txt", "one\n\nthree")
        z.writestr("b.txt", "")
    assert [r.value for r in readers.corpus_lines(spark, str(tmp_path / "corpus.zip")).collect()] == ["one", "", "three"]


def test_trial_stops_with_the_row_that_reaches_the_limit(spark):
    rows = spark.createDataFrame([(i, None if i == 2 else "abcé") for i in range(10)], "id int, text string")
    take = lambda n: sorted(r.id for r in readers.trial(rows, ["id"], F.lit(n)).collect())
    assert take(0) == [] and take(1) == [0] and take(10) == [0, 1] and take(11) == [0, 1, 2, 3]
    assert readers.trial(rows.limit(0), ["id"], F.lit(5)).count() == 0


def test_resumed_job_refuses_other_parameters(spark, tmp_path):
    path = str(tmp_path / "parameters")
    for _ in range(2):
        jobs.same_parameters(spark, path, {"a": 1, "b": "x"})
    with pytest.raises(ValueError):
        jobs.same_parameters(spark, path, {"a": 2, "b": "x"})


def test_prior_swap_counts_missing_forms_as_zero(spark):
    from isogloss.operators import language_model as LM

    c = spark.createDataFrame([("the", -1.0, 9.0, "x", 2), ("thee", -2.0, 9.0, "y", 2)], "candidate string, logprob double, prior double, type string, words int")
    n = spark.createDataFrame([("The", 3), ("the", 4), ("of", 3)], "form string, n int")
    got = {r.candidate: r for r in LM.candidate_scores(LM.prior_swapped(c, n), {"x": 0.5}, 1.0, True).collect()}
    assert abs(got["the"].prior - -0.2231435513) < 1e-9 and abs(got["thee"].prior - -2.302585093) < 1e-9
    assert abs(got["the"].score - (-0.5 - 0.5 * got["the"].prior)) < 1e-12 and abs(got["thee"].score - (-1 - got["thee"].prior)) < 1e-12


@pytest.fixture
def small(spark, tmp_path):
    """A folder of tables made of a few rows: small(documents=[(doc_id, lang, source, text), ...])."""

    def make(**tables):
        schemas = {"documents": "doc_id long, lang string, source string, text string", "benchmark": "item_id long, text string"}
        for name, rows in tables.items():
            spark.createDataFrame(rows, schemas[name]).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_entries_cover_the_whole_text(spark, small):
    registry.load()
    sf = small(documents=[(1, "en", "s1", "Red dog. Aa bb cc dd ee ff gg. Late word here."), (2, None, "s2", "Tiny dog.")])
    got = {(r.src, r.dst) for r in registry.QUERIES["lex_04_one_to_one_whole"](spark, sf).collect()}
    assert {("late", "word"), ("word", "here"), ("ff", "gg")} <= got
    assert ("dog", "aa") not in got
    # The second document has under six tokens, and makes `dog` collide.
    assert {r.src for r in registry.QUERIES["lex_05_collided_whole"](spark, sf).collect()} == {"red", "tiny"}


def test_long_and_short_sentences_are_edited(spark, small):
    registry.load()
    long_ = " ".join(["word"] * 80 + ["the"])
    sf = small(documents=[(1, "en", "s1", long_), (2, "en", "s1", "The dog")])
    q = lambda name: registry.QUERIES[name](spark, sf)
    assert {(r["id"], r["i"]) for r in q("dif_01_positional_ops_whole").collect()} == {(10_000_000, 80), (20_000_000, 0)}
    assert {(r["from"], r["to"], r["n"]) for r in q("dif_03_mined").collect()} == {("the", "le", 2)}
    assert {(r["id"], r["ref_words"]) for r in q("met_02_word_edits").collect()} == {(10_000_000, 81), (20_000_000, 2)}
    assert q("met_03_bleu").count() == q("met_04_chrf").count() == q("met_01_exact_whole").count() == 2


def test_each_language_has_its_model(spark, small):
    registry.load()
    sf = small(documents=[(1, "en", "s1", "the dog of"), (2, "es", "s1", "the gato of the"), (3, None, "s2", "the nada of")])
    q = lambda name: registry.QUERIES[name](spark, sf)
    assert {(r.lang, r["count"]) for r in q("lmd_01_ngram_counts_whole").filter("gram = 'the'").collect()} == {("en", 1), ("es", 2), (None, 1)}
    got = {r.id: (r.lang, r.words, r.logprob) for r in q("lmd_02_log_probability_whole").collect()}
    assert {k: v[:2] for k, v in got.items()} == {10_000_000: ("en", 4), 20_000_000: ("es", 5), 30_000_000: (None, 4)}
    assert got[10_000_000][2] == got[30_000_000][2]  # like texts in models of their own
    assert {(r.lang, r.n) for r in q("src_11_frequency_table_whole").filter("form = 'of'").collect()} == {("en", 1), ("es", 1), (None, 1)}
    assert {r.lang for r in q("nbc_03_train_whole").collect()} == {"en", "es", None}
    assert q("nbc_04_logodds_whole").count() == 7 and q("lmd_04_lm_export_whole").count() == 3


def test_content_alignment_after_a_deleted_block(spark):
    w = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = lambda nos: spark.createDataFrame([(1, k, f"word{w(i)} other{w(i)} last{w(i)}" if i != 35 else "the same line") for k, i in enumerate(nos)], "doc int, no int, text string")
    kept = [0, 1, *range(22, 60)]
    got = sorted((r.i, r.j, r.similarity) for r in R.align_by_content(rows(range(60)), rows(kept)).collect())
    assert got == [(i, k, 1.0) for k, i in enumerate(kept)]


def test_content_alignment_of_repeated_lines(spark):
    rows = lambda texts: spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc int, no int, text string")
    got = sorted((r.i, r.j) for r in R.align_by_content(rows(["one line"] * 3 + ["red blue green"]), rows(["one line"] * 2 + ["red blue grey"])).collect())
    assert got == [(0, 0), (1, 1), (3, 2)]


def test_running_counts_are_kept_in_a_table(spark, tmp_path):
    for rows in [["a", "a", None], ["a", "b"], [None]]:
        spark.createDataFrame([(x,) for x in rows], "source string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.new_documents(spark, f"{tmp_path}/in", "source string", 1)
    jobs.running_counts(stream, ["source"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() == 3
    assert {(r.source, r["count"]) for r in jobs.last_counts(spark, ["source"], f"{tmp_path}/out").collect()} == {("a", 3), ("b", 1), (None, 2)}


def test_no_text_that_passes_is_left_out_by_bounds(spark):
    rnd = random.Random(5)
    forms = [("a", "occ", "simple"), ("b", "occ", "verb"), ("x", "or", "simple"), ("y", "or", "simple"), ("v", "or", "verb")]
    words = ["a", "b", "x", "y", "v", "other"]
    texts = [(i, [(rnd.choice(words), rnd.choice(["NOUN", "VERB", "PROPN"])) for _ in range(rnd.randint(0, 6))]) for i in range(400)]
    # Homographs count only as nouns in the exact score; western forms not as names, verbs as verbs alone.
    real = {f: (side, kind) for f, side, kind in forms}
    exact = set()
    for i, t in texts:
        n = {"occ": 0, "or": 0}
        for w, pos in t:
            side, kind = real.get(w, (None, None))
            if side == "or" and (w == "x" or pos == "VERB" and kind == "verb" or w == "y" and pos == "NOUN") or side == "occ" and pos != "PROPN" and (kind != "verb" or pos == "VERB"):
                n[side] += 1
        if n["occ"] and n["occ"] / (n["occ"] + n["or"]) > 0.5:
            exact.add(i)
    df = spark.createDataFrame([(i, " ".join(w for w, _ in t)) for i, t in texts], "id int, text string")
    both = spark.createDataFrame([("y",)], "form string")
    got = {r.id for r in M.could_pass(df, ["id"], spark.createDataFrame(forms, "form string, side string, kind string"), both).collect()}
    bound = {i for i, t in texts if (o := sum(w in "ab" for w, _ in t)) and o / (o + sum(w == "x" for w, _ in t)) > 0.5}
    assert exact < got == bound


def test_coverage_keeps_to_its_caps(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice("abcd")], rnd.sample(["p", "q", "r", "s", "t"] + [f"u{i}"] * (i % 9 == 0), 1), rnd.choice([None, 1, 2, 3, 4, 5, 6, 7])) for i in range(300)]
    pool = spark.createDataFrame(rows, "id int, labels array<string>, pairs array<string>, doc int")
    got = L.coverage(pool, "id", "labels", 60, 4, pairs="pairs", per_pair=3, caps={"doc": 4}).collect()
    assert len({r.id for r in got}) == len(got)
    assert max(Counter(r.doc for r in got).values()) <= 4 and max(Counter(p for r in got for p in r.pairs).values()) <= 3
    # Eight documents with four rows each hold 32; every label has its quota, and every cap leaves room for this.
    assert 25 <= len(got) <= 32 and min(Counter(x for r in got for x in r.labels).values()) >= 4
    again = L.coverage(pool.repartition(5), "id", "labels", 60, 4, pairs="pairs", per_pair=3, caps={"doc": 4}).collect()
    assert {r.id for r in again} == {r.id for r in got}
    assert L.coverage(pool.limit(0), "id", "labels", 5, 4, pairs="pairs", caps={"doc": 1}).count() == 0


def test_lines_are_numbered_through_all_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for k in range(3):
        (tmp_path / "t" / f"{k}.txt").write_text("".join(f"  {k}-{i} \n\n" for i in range(k + 1)) + " \n")
    got = {r.id: r.text for r in readers.lines(spark, str(tmp_path / "t")).collect()}
    assert got == {"L1": "0-0", "L2": "1-0", "L3": "1-1", "L4": "2-0", "L5": "2-1", "L6": "2-2"}


def test_sides_stay_aligned(spark, tmp_path):
    rows = [(i, f"a {i % 7}\nx", f"b {i}") for i in range(500)]
    writers.aligned_sides(spark.createDataFrame(rows, "id int, a string, b string").repartition(5), str(tmp_path / "s"), "id", ("a", "b"))
    got = readers.aligned_lines(spark, str(tmp_path / "s"), ("a", "b")).orderBy("part", "line").collect()
    assert [(r.a, r.b) for r in got] == [(a.replace("\n", " "), b) for _, a, b in rows]


def test_numerals_agree(spark):
    t = [("Les dos cases", ["les"], {}), ("dos noves", [], {"noves": ("ADJ", "f")}), ("Dos verbs", ["les"], {"verbs": ("NOUN", "m")}), ("dos veu", [], {"veu": ("VERB", "f")}), ("dos", ["les"], {})]
    rows = [(k, i, w, *tags.get(w, (None, None))) for k, (text, _, tags) in enumerate(t) for i, w in enumerate(re.findall(r"\w+|\s+", text))]
    got = W.agreeing_numeral(spark.createDataFrame(rows, "k int, i int, surface string, pos string, gender string"), "k", "dos", "dues", ["les", "estes"], "put").filter("put is not null")
    assert {(r.k, r.i, r.put) for r in got.collect()} == {(0, 2, "dues"), (1, 0, "dues")}


def test_dependents_agree_with_a_rewritten_noun(spark):
    morphology = spark.createDataFrame(
        [("plena", "ple", "adj", "f", "sg"), ("ple", "ple", "adj", "m", "sg"), ("plens", "ple", "adj", "m", "pl"), ("rebuda", "rebre", "participle", "f", "sg"), ("rebut", "rebre", "participle", "m", "sg"), ("gran", "gran", "adj", "f", "sg")],
        "form string, lemma string, cat string, gender string, number string",
    )
    # The bucket (1) was rewritten to a masculine noun: what depends on it changes, what depends on another word does not.
    words = [("Plena", None, 1, None), ("poal", "lexicon", None, "m"), ("gran", None, 1, None), ("rebuda", None, 1, None), ("taula", None, None, "f"), ("plena", None, 4, None), ("plena", "lexicon", 1, None)]
    t = spark.createDataFrame([("k", i, w, w, rule, head, g) for i, (w, rule, head, g) in enumerate(words)], "k string, i int, surface string, translated string, rule string, head int, gender string")
    got = [r.translated for r in W.phrase_agreed(t, "k", morphology).orderBy("i").collect()]
    assert got == ["Ple", "poal", "gran", "rebut", "taula", "plena", "plena"]


def test_stop_after_a_number_of_rows(spark, tmp_path):
    for k in range(5):
        spark.createDataFrame([(k * 10 + i,) for i in range(10)], "id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    stream = jobs.new_documents(spark, str(tmp_path / "f"), "id int", 1)
    jobs.stop_after(stream, F.col("id") % 2 == 0, 8, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
