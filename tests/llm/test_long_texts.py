"""Texts longer than the pieces in which tasks work (over 2 MiB): taken whole by every operator that reads texts."""

from __future__ import annotations

import random

import pytest

from isogloss.llm import decontaminate, kernel, language_id, mixing, near_dups, privacy, quality_rules, token_counts

WORDS = "the of and that river stone light under morning people water never small great house".split()


@pytest.fixture(scope="module")
def long(spark):
    r = random.Random(9)
    text = " ".join(r.choice(WORDS) for _ in range(500_000))
    passage = " ".join(f"passage{i}" for i in range(20))
    text = f"{text}\n{passage} and mail z@end.example"
    assert len(text) > 1.2 * kernel.CHUNK
    return text, passage, spark.createDataFrame([(1, text, "en", "a"), (2, "the light of the river", "en", "a"), (3, text, "en", "a")], "doc_id long, text string, lang string, source string")


def test_words_and_tokens(spark, long):
    text, _, docs = long
    pieces = token_counts.read_pieces()
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(docs, pieces).collect()}
    words = text.split()
    each = {w: r.n_tokens for w, r in zip(dict.fromkeys(words), token_counts.token_counts(spark.createDataFrame([(i, w) for i, w in enumerate(dict.fromkeys(words))], "doc_id long, text string"), pieces).orderBy("doc_id").collect())}
    assert got[1] == got[3] == (len(words), sum(each[w] for w in words))
    rules = {r.doc_id: r.n_words for r in quality_rules.measured(docs).collect()}
    assert rules[1] == len(words)


def test_passages_at_the_end(spark, long):
    _, passage, docs = long
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (20, 1), 2: (0, 0), 3: (20, 1)}


def test_copies_mix_and_personal_data(spark, long):
    text, _, docs = long
    found = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
    assert sorted(r.doc_id for r in near_dups.keep_one(docs).collect()) == [1, 2]
    assert {r.doc_id: r.size for r in mixing.mix(docs).select("doc_id", "size").collect()}[1] == len(text.split())
    assert all("z@end.example" not in r.text for r in privacy.sanitised(docs).collect())


def test_language(spark, long):
    _, _, docs = long
    model = language_id.fit(language_id.learn_rows(docs.unionByName(spark.createDataFrame([(i, "der die und nicht ist ein haus am wasser " * 9, "de", "b") for i in range(10, 40)], docs.schema))))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert got[1] == got[3]
