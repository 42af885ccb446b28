"""Byte-level BPE by a trie of the distinct words, and decoding.

A word's encoding is fixed by its last token: what stands before that token is
the encoding of a shorter prefix. So the distinct words of a chunk are laid out
as a trie (sorted, so that words with a common prefix lie side by side), which
is walked depth first. The state of a node is the last token of the encoding of
its prefix; a child takes it from the nodes above and hands its own down, and
each shared prefix is encoded once, whatever the number of words below it.

A token ends a prefix if the prefix before it has a last token that it may
follow: that no merge reaches across the border of the two before the merges on
either side of it are done. Exactly one token does. Depth has no limit.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import kernel
from .common import pick, table

_NEVER = 1 << 40
LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3
#: Bytes of text that are laid out as one trie, and of words that a Python worker remembers; beyond these it begins anew.
CHUNK, REMEMBERED = 4 << 20, 128 << 20


def byte_chars() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """A byte-level BPE tokenizer: tokens by id, merges by rank, and the kinds of characters that part words."""

    tokens: dict[int, bytes]
    merges: list[tuple[int, int, int]]
    special: dict[bytes, int] = field(default_factory=dict)
    kinds: np.ndarray | None = None
    name: str = ""

    def __post_init__(self) -> None:
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(self.merges)}
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b, t) in enumerate(self.merges):
            made.setdefault(t, (r, a, b))
        # Of each token its right edge and its left edge while it is made: (part, rank of the merge that ends the part).
        self.right = {t: self._edge(t, made, 2) for t in self.tokens}
        self.left = {t: self._edge(t, made, 1) for t in self.tokens}
        self.whole: dict[bytes, int] = {}
        for t, text in self.tokens.items():
            if t not in made and len(text) == 1 or t in made and self.follows(made[t][1], made[t][2], self.rank[made[t][1], made[t][2]]):
                self.whole.setdefault(text, t)
        sizes: dict[bytes, set[int]] = {}
        for text in self.whole:
            if len(text) > 2:
                sizes.setdefault(text[-3:], set()).add(len(text))
        self.length = {t: len(text) for t, text in self.tokens.items()}
        self.sizes = {tail: (*sorted(n, reverse=True), 2, 1) for tail, n in sizes.items()}

    @staticmethod
    def _edge(t: int, made: dict[int, tuple[int, int, int]], side: int) -> tuple[tuple[int, int], ...]:
        out, until = [(t, _NEVER)], _NEVER
        while t in made:
            until, t = made[t][0], made[t][side]
            out.append((t, until))
        return tuple(out)

    def follows(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether b may stand after a: no merge of rank under `before` joins parts across their border while both are there. Of equal ranks the left is done first."""
        rank = self.rank
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                r = rank.get((x, y), _NEVER)
                if r < before and r < x_until and r <= y_until:
                    return False
        return True

    def encode_words(self, words: Iterator[bytes], fits: dict[tuple[int, int], bool] | None = None) -> dict[bytes, bytes]:
        """The ids of each distinct word, as little-endian unsigned 32-bit integers; fits keeps which tokens follow which.

        The path from the root to the present word is a stack of depths. A state
        is found when a word below asks for it, and stays for all others below.
        """
        out: dict[bytes, bytes] = {}
        whole, sizes, follows = self.whole, self.sizes, self.follows
        fits = {} if fits is None else fits
        last: list[int | None] = [-1]  # of each node of the path its last token, where it is known
        before = b""
        for word in sorted(words):
            depth = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                depth += 1
            del last[depth + 1 :]
            last += [None] * (len(word) - depth)
            asked = [] if last[-1] is not None else [len(word)]
            tries: list[Iterator[int]] = [iter(sizes.get(word[-3:], (2, 1)))] if asked else []
            while asked:
                n = asked[-1]
                for size in tries[-1]:
                    if size > n or (t := whole.get(word[n - size : n])) is None:
                        continue
                    p = last[n - size]
                    if p is None:  # that node first, then this size once more
                        asked.append(n - size)
                        tries[-1] = chain((size,), tries[-1])
                        tries.append(iter(sizes.get(word[max(0, n - size - 3) : n - size], (2, 1))))
                        break
                    if p >= 0:
                        if (fit := fits.get((p, t))) is None:
                            fit = fits[p, t] = follows(p, t)
                        if not fit:
                            continue
                    last[n] = t
                    asked.pop()
                    tries.pop()
                    break
                else:
                    raise ValueError(f"no token ends with byte {word[n - 1]}")
            ids, n = [], len(word)
            while n:
                ids.append(last[n])
                n -= self.length[last[n]]
            out[word] = pack(f"<{len(ids)}I", *reversed(ids))
            before = word
        return out

    def word_starts(self, chars: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character; edges (documents, special tokens) part words whatever stands there.

        The split of byte-level vocabularies: English contractions, then runs of
        letters, of numbers and of others with one space before them, then blanks.
        """
        n = len(chars)
        kind = self.kinds[chars]
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        edge = np.zeros(n + 3, bool)
        edge[edges] = True
        edge[n:] = True
        start |= edge[:n]
        # A run of blanks leaves its last to what follows: a space joins it, another blank is a word of its own.
        end = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~edge[1:n]) + 1
        start[end - 1] = True
        start[end] = chars[end - 1] != 0x20
        at = np.flatnonzero((chars == 0x27) & start)
        nxt = [np.where(at + k < n, chars[np.minimum(at + k, n - 1)], 0) for k in (1, 2)]
        one = np.isin(nxt[0], [ord(c) for c in "stmd"]) & ~edge[at + 1]
        pair = nxt[0].astype(np.int64) << 32 | nxt[1]
        two = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")]) & ~edge[at + 1] & ~edge[at + 2]
        for hit, size in ((one, 2), (two, 3)):
            where = at[hit]
            start[where + 1] = False
            start[(where + size)[where + size < n]] = True
        return start

    def words(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of documents that lie in data one after another."""
        if not data:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        chars = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
        heads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        spans = sorted((i, i + len(s)) for s in self.special for i in _places(data, s))
        spans = [(a, b) for a, b in spans if b <= offsets[np.searchsorted(offsets, a, "right")]]  # not across documents
        edges = np.searchsorted(heads, np.concatenate([offsets[:-1], np.array(spans, np.int64).reshape(-1)]))
        start = self.word_starts(chars, edges[edges < len(chars)])
        for span in spans:
            lo, hi = np.searchsorted(heads, span)
            start[lo + 1 : hi] = False
        at = heads[start]
        return at, np.append(at[1:], len(data))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; ids outside of the vocabulary are left out, and bytes that are no UTF-8 replaced, as the usual decoder does."""
        starts, lengths, data = self.flat
        ids = ids[(ids >= 0) & (ids < len(starts))]
        sizes = lengths[ids]
        before = np.cumsum(sizes) - sizes
        return data[np.arange(sizes.sum()) + np.repeat(starts[ids] - before, sizes)].tobytes().decode("utf-8", "replace")

    @cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each id's bytes in one array of bytes."""
        texts = self.tokens | {i: t for t, i in self.special.items()}
        lengths = np.array([len(texts.get(i, b"")) for i in range(max(texts) + 1)])
        return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join([texts.get(i, b"") for i in range(len(lengths))]), np.uint8)


def _places(data: bytes, what: bytes) -> Iterator[int]:
    i = data.find(what)
    while i >= 0:
        yield i
        i = data.find(what, i + len(what))


def character_kinds(split) -> np.ndarray:
    """Kind of every character, as the tokenizer's own splitter has it: split(text) gives its words."""
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    some = regex.compile(r"[\p{L}\p{N}\s]")
    chars = [c for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and some.match(c := chr(cp))]
    for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
        # A character that goes on a run is of its kind; no other character of this text does.
        joined = {w[1] for w in split("".join(f"\n{before}{c}" for c in chars)) if len(w) == 2 and w[0] == before}
        for c in joined:
            kinds[ord(c)] = kind
        chars = [c for c in chars if c not in joined]
    for c in chars:
        kinds[ord(c)] = BLANK
    return kinds


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library; others are refused."""
    import tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that strip their surroundings")
    byte_of, ids = byte_chars(), model["vocab"]
    special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
    tokens = {i: bytes(byte_of[c] for c in t) for t, i in ids.items() if i not in special.values()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    splitter = tokenizers.Tokenizer.from_file(path).pre_tokenizer
    def split(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]

    return Vocabulary(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], special, character_kinds(split), hashlib.sha256(json.dumps(spec).encode()).hexdigest())


def _parts(data: bytes) -> Iterator[tuple[int, int]]:
    """Parts of a long text of about CHUNK bytes, cut before a space that follows a printable character; no word reaches over it."""
    lo = 0
    while lo < len(data):
        hi = min(lo + CHUNK, len(data))
        while hi < len(data) and not (data[hi] == 0x20 and 0x21 <= data[hi - 1] < 0x7F):
            hi = data.find(b" ", hi + 1)
            hi = len(data) if hi < 0 else hi
        yield lo, hi
        lo = hi


def distinct(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and the place of each word among them. Bytes decide: the first and last eight of a short word, all of a long one."""
    size = ends - starts
    at = np.lib.stride_tricks.sliding_window_view(np.frombuffer(bytes(8) + data + bytes(8), np.uint8), 8)
    drop = ((8 - np.minimum(size, 8)) * 8).astype(np.uint64)
    head = at[starts + 8].view("<u8")[:, 0] << drop
    tail = at[ends].view("<u8")[:, 0] >> drop
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(size > 16).tolist():
        head[i] = seen.setdefault(data[starts[i] : ends[i]], len(seen))
        tail[i] = 0
    _, first, place = np.unique(kernel.join_hashes(head, tail, size.astype(np.uint64)), return_index=True, return_inverse=True)
    back = first[place]
    if not ((head[back] == head) & (tail[back] == tail) & (size[back] == size)).all():  # two words share a hash
        _, first, place = np.unique(np.stack([head, tail, size.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
    return [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], place


class Encoder:
    """Encodes chunks of documents, and remembers the words that it has encoded."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._begin()

    def _begin(self) -> None:
        self.size, self.fits = 0, {}
        self.known = {t: pack("<I", i) for t, i in self.vocabulary.special.items()}

    def _encode(self, data: bytes, offsets: np.ndarray) -> Iterator[bytes]:
        """The packed ids of each document of a chunk."""
        starts, ends = self.vocabulary.words(data, offsets)
        words, place = distinct(data, starts, ends)
        if self.size > REMEMBERED:
            self._begin()
        new = [w for w in words if w not in self.known]
        self.size += sum(map(len, new)) + 100 * len(new)
        self.known |= self.vocabulary.encode_words(new, self.fits)
        packed = [self.known[w] for w in words]
        flat = np.frombuffer(b"".join(packed), "<u4")
        counts = np.array([len(p) // 4 for p in packed], np.int64)
        first, counts = (np.cumsum(counts) - counts)[place], counts[place]
        bound = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.arange(bound[-1]) + np.repeat(first - bound[:-1], counts)]
        cuts = bound[np.searchsorted(starts, offsets)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield ids[a:b].tobytes()

    def __call__(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text, packed; a null has none."""
        for lo, hi, buf, off in kernel.chunks(column, CHUNK):
            if hi - lo > 1 or len(buf) <= CHUNK:
                yield from self._encode(buf.tobytes(), off)
            else:
                data = buf.tobytes()
                yield b"".join(p for a, b in _parts(data) for p in self._encode(data[a:b], np.array([0, b - a])))


#: The encoder that a Python worker keeps from task to task, by its vocabulary's name.
_kept: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    if vocabulary.name not in _kept:
        _kept.clear()
        _kept[vocabulary.name] = Encoder(vocabulary)
    return _kept[vocabulary.name]


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids (array of int) of every row of docs (doc_id, text).

    The text of a special token is that token, as in the tokenizer's file. A
    null or empty text has no ids. Null and repeated ids and repeated rows each
    keep a row; extra columns are ignored; an empty table gives an empty result.
    Very long texts are encoded in parts of CHUNK bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for b in batches:
            packed = list(encode(b.column("text")))
            bound = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bound), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of every row of rows (doc_id, ids). Null ids give a null text, null or unknown members nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if ids is None else shared.value.decode(np.array([i for i in ids if i is not None], np.int64)) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = pick(rows, "doc_id", "ids")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the packed ids and of the text decoded from them; rows and edge cases as in encoded()."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = encoder(shared.value), shared.value.decode
        for b in batches:
            counts, ids, texts = [], [], []
            for packed in encode(b.column("text")):
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(decode(np.frombuffer(packed, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = pick(docs, "doc_id", "text")
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields]))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), read_vocabulary(tokenizer_path()))


QUERIES = {"op13_bpe": op13}
ORACLE_SQL: dict[str, str] = {}
