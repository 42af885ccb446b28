"""Encoding, conversation tries and hard negatives against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from isogloss.llm import bpe, conversation_trie, hard_negatives

# --- op13 ---


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def encodes(vocabulary, tokenizer, texts):
    got = [np.frombuffer(p, "<u4") for p in bpe.Encoder(vocabulary)(pa.array(texts, pa.string()))]
    for text, ids, want in zip(texts, got, tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text[:80]
        assert vocabulary.decode(ids) == tokenizer.decode(want.ids, skip_special_tokens=False)


def test_bpe_random_texts(vocabulary, tokenizer):
    r = random.Random(3)
    alphabet = "aaabst'  \n\t re ve ll m d's't 'S1²९!.,-—é中\xa0　\x1c\x85՘👍🏽́"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(4000)]
    texts += ["".join(r.choice(["<|endoftext|>", "<|", "|>", " ", "a", "'s", "\n", "endoftext"]) for _ in range(r.randrange(12))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x800), r.randrange(0x800, 0xD800), r.randrange(0x10000, 0x110000)])) for _ in range(60)) for _ in range(500)]
    texts += ["".join(r.choice("ab") for _ in range(r.randrange(90))) for _ in range(500)] + [c * n for c in "-a =" for n in range(130)]
    encodes(vocabulary, tokenizer, texts)


def test_bpe_joined_tokens(vocabulary, tokenizer):
    r = random.Random(5)
    some = [t.decode("utf-8", "ignore") for t in vocabulary.tokens.values()]
    encodes(vocabulary, tokenizer, ["".join(r.choice(some) for _ in range(r.randrange(30))) for _ in range(5000)])


def test_bpe_beyond_a_chunk(vocabulary, tokenizer):
    encodes(vocabulary, tokenizer, ["x", "a" * 1_000_000, " the cat's\n" * 500_000, None, "", "end"])


def test_bpe_words_beyond_eight_bytes_are_told_apart():
    words = [b"", b"a", b"abcdefgh", b"abcdefghi", b"abcdefghabcdefgh", b"abcdefgh1abcdefgh", b"abcdefgh2abcdefgh", b"\x00a", b"a\x00"] * 3
    data = b"".join(words)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    some, place = bpe.distinct(data, starts, ends)
    assert [some[i] for i in place] == words and len(some) == 9


def test_bpe_documents(spark, sf, vocabulary, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {}
    for row in docs.select("doc_id", "text").collect():
        e = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(e, skip_special_tokens=False)
        want[row.doc_id] = (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op13(spark, sf).collect()}
    assert got == want


def test_bpe_edge_rows(spark, vocabulary):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, None, None), (2, "", "y"), (None, "<|endoftext|>", "z"), (3, " \n\n ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT string")
    coded = bpe.encoded(docs, vocabulary)
    back = Counter((r.doc_id, r.text) for r in bpe.decoded(coded, vocabulary).collect())
    assert back == Counter((i, t or "") for i, t, _ in rows)
    assert Counter(len(r.ids) for r in coded.collect()) == Counter(r.n_tokens for r in bpe.round_trip(docs, vocabulary).collect())
    assert bpe.round_trip(docs.filter("false"), vocabulary).isEmpty()
    odd = spark.createDataFrame([(1, None), (2, [72, None, -1, 999999]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decoded(odd, vocabulary).collect()} == {1: None, 2: "i", 3: ""}


# --- op11 ---


def test_node_table():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = r.integers(0, 2**63, (2, n), dtype=np.uint64)
        t = conversation_trie.NodeTable(a, b)
        assert sorted(t.find(a, b)) == list(range(n))
        assert (t.find(a, b + np.uint64(1)) == -1).all()


def trie_by_hand(rows, group=20, head=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % head
        built[c] = own.get(c - c % group, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, tokens = Counter(), Counter()
    for k, m in members.items():
        words = len([w for w in "".join(" " if ch in " \t\n\v\f\r" else ch for ch in (k[-1][1] if k else "")).split(" ") if w])
        for d in range(len(k) + 1):
            tokens[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += not kids[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], tokens[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, TEXT string")
    got = conversation_trie.prefix_trie(df)
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_trie_by_hand(spark):
    r = random.Random(2)
    rows = []
    for c in range(90):
        if c in (20, 21):
            continue  # a first conversation that isn't there
        for turn in range(r.randrange(1, 7)):
            rows.append((c, r.choice([turn, turn, turn, None]), r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "d  e\nf"])))
    rows += [(200, 0, "user", "only a first turn"), (None, 0, "user", "of no conversation"), (5, 3, "user", "twice"), (5, 3, "user", "twice")]
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_long_conversations(spark, monkeypatch):
    """Conversations that reach over several shards, alone, one below the other, and repeated."""
    rows = [(c, t, "user", f"w{t} x") for c in (40, 41, 43, 60) for t in range(120)] + [(7, t, "user", f"w{min(t, 50)} x") for t in range(90)]
    rows += [(c, t, "a", "same") for c in range(100, 130) for t in range(3)] + [(80, None, "user", "same again")] * 150
    monkeypatch.setattr(conversation_trie, "SHARD_ROWS", 40)
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_edges(spark):
    assert trie_of(spark, []) == []
    only = trie_of(spark, [(1, None, None, None)])
    assert only == trie_by_hand([(1, None, None, None)])
    with pytest.raises(RuntimeError, match="share a digest"):
        t = pa.table({"c": [1, 1, 2, 2], "shard": [1] * 4, "depth": [0, 1, 0, 1], "length": [1] * 4, "digest": pa.array([None, b"x", None, b"y"]), "words": [0, 1, 0, 1], "k1": [0, 5, 0, 5], "k2": [0, 6, 0, 6], "p1": [0] * 4, "p2": [0] * 4})
        conversation_trie.shard_nodes(t)


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_hard_negatives"])
def test_tree_oracles(spark, sf, name):
    from isogloss.llm import register

    assert_same(spark, connect(sf), register.QUERIES[name], register.ORACLE_SQL[name], sf)


# --- op12 ---


def negatives_by_hand(points, every):
    order = lambda p, q: (-sum(a * b for a, b in zip(p[2], q[2])), q[0] is None, q[0] or 0)
    fine = [p for p in points if p[1] is not None and p[2] is not None]
    out = []
    for i, a in enumerate(fine):
        if a[0] is None or a[0] % every:
            continue
        others = sorted((q for j, q in enumerate(fine) if j != i), key=lambda q: order(a, q))
        score = lambda q: -order(a, q)[0]
        for p in [q for q in others if q[1] == a[1]][:5]:
            below = [q for q in others if q[1] != a[1] and 80 * score(p) <= 100 * score(q) <= 100 * score(p)][:5]
            out += [(a[0], p[0], k, q[0], score(p), score(q)) for k, q in enumerate(below, 1)]
    return sorted(out, key=str)


def mined(spark, points, every):
    df = spark.createDataFrame([(*p, "x") for p in points], "id long, label long, v array<int>, ID string")
    return sorted((tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % every == 0).collect()), key=str)


def clustered(r, n, dims, centres=12):
    middle = [[r.randrange(-60, 60) for _ in range(dims)] for _ in range(centres)]
    return [(i, r.randrange(3), [x + r.randrange(-6, 7) for x in r.choice(middle)]) for i in range(n)]


def test_negatives_clustered(spark, monkeypatch):
    """Trees of several levels in several blocks to a cell, and queries that are dealt to several tasks."""
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "PER_TASK", 7)
    points = clustered(random.Random(1), 900, 6)
    assert mined(spark, points, 10) == negatives_by_hand(points, 10)


def test_negatives_ties_nulls_and_copies(spark):
    r = random.Random(4)
    points = [(i, r.randrange(3), [r.randrange(-2, 3) for _ in range(3)]) for i in range(120)]
    points += [(None, 1, [1, 1, 1]), (7, None, [1, 2, 3]), (8, 1, None), (10, 1, [2, 2]), (20, 2, [])] + [(1000 + i, 1, [2, 2, 2]) for i in range(200)]
    assert mined(spark, points, 10) == negatives_by_hand(points, 10)
    points = [(i, i % 2, [-5 - i, 0]) for i in range(30)]  # negative scores leave no window
    assert mined(spark, [*points, (100, 0, [9, 0])], 100) == negatives_by_hand([*points, (100, 0, [9, 0])], 100)


def test_negatives_edges(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(0, 1, [1, 2])], 1) == []
    rows = [(0, 1, [0.5, float("nan")]), (100, 1, [0.5, None]), (14, 3, [0.25, -0.001]), (15, None, [0.1, 0.2]), (None, 1, [0.5, 0.5]), (16, 1, None), (200, 2, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {(r.id, r.label, tuple(r.v)) for r in hard_negatives.points_of(df).collect() if r.v is not None and r.label is not None}
    assert got == {(14, 4, (64, -1)), (None, 1, (128, 128))}


def test_tree_leaves_out_what_cannot_match():
    """A search of far clusters looks at a small part of the rows and finds the same."""
    r = np.random.default_rng(2)
    centres = r.integers(-200, 200, (40, 8))
    v = (np.repeat(centres, 100, axis=0) + r.integers(-3, 4, (4000, 8))).astype(float)
    space = hard_negatives.Space(float((v * v).sum(1).max()))
    tree = hard_negatives.Tree(v, np.zeros(4000, np.int64), np.arange(4000), space)
    seen = []
    at = hard_negatives.Tree.search
    q = v[::400]
    none = np.full(len(q), hard_negatives._LOW)
    best = at(tree, q, np.full(len(q), -1), np.zeros(len(q), np.int64), True, none, -none, 5)
    score = (q @ v.T).astype(np.int64)
    want = -np.sort(-(score * 4000 + 3999 - np.arange(4000)), axis=1)[:, :5]
    assert (best == want).all()
    low = score.max(axis=1) - 50
    near, far = space.annulus((q * q).sum(1), low, -none)
    split, lo, hi, _ = tree.root
    alive = hard_negatives.possible(np.sqrt(hard_negatives._squares(space.query(q), split)), near, far, lo, hi, space.slack)
    seen.append(alive.mean())
    assert seen[0] < 0.7
