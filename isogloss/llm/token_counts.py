"""Token counts under a unigram tokenizer, by dynamic programming over a trie.

Texts are cut at ASCII blanks; a pre-token is a word with the word mark before
it. The distinct pre-tokens of a chunk are inserted in a trie, level by level,
and the best forward score of every prefix is computed once, whichever and
however many words share it: a node's score is the best over the pieces that
end there of the score of the node before the piece plus the piece's own. The
token count at a word's terminal node is then added up for each document. The
trie has LEVELS levels; past these hardly two words share a prefix, and a longer
word goes on alone from the scores at its node, by the same recurrence.

The pieces are those of a SentencePiece file (never trained here). The file
ranks them, so a piece's log-probability is taken from Zipf's law, -ln(rank +
1). A byte that no piece covers is a token of its own, at a score below all
pieces. Scores are integers, so ties are exact; of equal scores the fewest
tokens win.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernel
from .common import pick, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Scores are in thousandths; a token costs one unit of the lower bits, so that fewer tokens win ties.
_SCALE, _LOW = 1000, 1 << 20
#: Levels of the trie, and positions of a longer word that are looked up at once.
LEVELS, _BLOCK = 256, 1 << 16


def read_pieces(path: str = MODEL) -> list[bytes]:
    """The pieces of a SentencePiece file by rank, without controls and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return [sp.id_to_piece(i).encode() for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


@dataclass
class Pieces:
    """Sorted hashes of the pieces of each length, with their scores."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray]]
    unknown: int

    @classmethod
    def of(cls, pieces: list[bytes]) -> Pieces:
        if not pieces:
            return cls({}, -_SCALE * _LOW - 1)
        best: dict[bytes, int] = {}
        for rank, p in enumerate(pieces, 1):
            best.setdefault(p, int(round(-np.log(rank + 1) * _SCALE)) * _LOW - 1)
        out = {}
        for n in sorted({len(p) for p in best}):
            same = [p for p in best if len(p) == n]
            h = np.zeros(len(same), np.uint64)
            for k in range(n):
                h = _step(h, np.array([p[k] for p in same], np.uint8))
            h = kernel.mix(h)
            order = np.argsort(h)
            out[n] = h[order], np.array([best[p] for p in same])[order]
        return cls(out, min(best.values()) - 10 * _SCALE * _LOW)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return h * _BASE + kernel._TABLE[byte]


def _alone(word: np.ndarray, done: int, score: list[int], count: list[int], pieces: Pieces) -> int:
    """Tokens of a word of which `done` bytes are scored; score and count are those of the last positions, up to the longest piece's length."""
    longest = len(score)
    for lo in range(done, len(word), _BLOCK):
        hi = min(len(word), lo + _BLOCK)
        base = lo - longest
        part = word[base:hi]
        up, down = kernel.powers(len(part) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(kernel._TABLE[part] * down[: len(part)])])
        at = np.arange(longest + 1, len(part) + 1)
        ends, backs, values = [], [], []
        for back, (keys, worth) in pieces.by_length.items():
            piece = kernel.mix((sums[at] - sums[at - back]) * up[at - 1])
            i = np.minimum(np.searchsorted(keys, piece), len(keys) - 1)
            hit = np.flatnonzero(keys[i] == piece)
            ends.append(at[hit] + base)
            backs.append(np.full(len(hit), back))
            values.append(worth[i[hit]])
        if ends:
            e = np.concatenate(ends)
            order = np.argsort(e, kind="stable")  # short pieces first, as in the trie
            ends, backs, values = (np.concatenate(x)[order].tolist() for x in (ends, backs, values))
        k, m = 0, len(ends)
        for end in range(lo + 1, hi + 1):
            best, n = score[-1] + pieces.unknown, count[-1] + 1
            while k < m and ends[k] == end:
                if (trial := score[-backs[k]] + values[k]) > best:
                    best, n = trial, count[-backs[k]] + 1
                k += 1
            score.append(best)
            count.append(n)
        score, count = score[-longest:], count[-longest:]
    return count[-1]


def trie_counts(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pieces: Pieces, levels: int = LEVELS) -> np.ndarray:
    """Tokens of each distinct word (bytes of `words` from starts), by one pass over the trie's levels.

    Words must be sorted bytewise; words that share a prefix then lie side by
    side, and a level's nodes are the runs of equal prefixes.
    """
    out = np.zeros(len(starts), np.int64)
    longest = max(pieces.by_length, default=1)
    alive = np.arange(len(starts))
    node = np.zeros(len(starts), np.int64)  # each word's node at the present level
    # Of the last `longest` levels: prefix hash, score and tokens of each node, and each node's parent.
    hashes, scores, tokens, parents = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    powers = np.array([pow(int(_BASE), n, 1 << 64) for n in range(longest + 1)], np.uint64)
    level, levels = 0, max(levels, longest)
    while len(alive) and level < levels:
        level += 1
        byte = words[starts[alive] + level - 1]
        new = np.ones(len(alive), bool)
        new[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
        at = np.flatnonzero(new)
        up = node[at]  # parents
        h = _step(hashes[-1][up], byte[at])
        score = scores[-1][up] + pieces.unknown
        count = tokens[-1][up] + 1
        anc = up
        for back in range(1, min(longest, len(hashes)) + 1):
            if back > 1:
                anc = parents[-back + 1][anc]
            if back not in pieces.by_length:
                continue
            keys, values = pieces.by_length[back]
            piece = kernel.mix(h - hashes[-back][anc] * powers[back])
            i = np.minimum(np.searchsorted(keys, piece), len(keys) - 1)
            trial = np.where(keys[i] == piece, scores[-back][anc] + values[i], np.iinfo(np.int64).min)
            better = trial > score
            score = np.where(better, trial, score)
            count = np.where(better, tokens[-back][anc] + 1, count)
        for kept, x in ((hashes, h), (scores, score), (tokens, count), (parents, up)):
            kept.append(x)
            if len(kept) > longest:
                kept.pop(0)
        node = np.cumsum(new) - 1
        done = lengths[alive] == level
        out[alive[done]] = count[node[done]]
        alive, node = alive[~done], node[~done]
    for i, at in zip(alive.tolist(), node.tolist()):
        score, count = [], []
        for back in range(1, min(longest, len(scores)) + 1):
            score.append(int(scores[-back][at]))
            count.append(int(tokens[-back][at]))
            at = parents[-back][at]
        out[i] = _alone(words[starts[i] : starts[i] + lengths[i]], level, score[::-1], count[::-1], pieces)
    return out


def chunk_counts(buf: np.ndarray, off: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each document of a chunk."""
    starts, ends, n_words = kernel.spans(buf, off, kernel.NOT_BLANK)
    if not len(starts):
        return n_words, n_words.copy()
    _, first, back = np.unique(kernel.Hasher(buf)(starts, ends), return_index=True, return_inverse=True)
    distinct = [MARK + buf[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    order = sorted(range(len(distinct)), key=distinct.__getitem__)
    lengths = np.array([len(distinct[i]) for i in order])
    words = np.frombuffer(b"".join([distinct[i] for i in order]), np.uint8)
    tokens = np.empty(len(order), np.int64)
    tokens[order] = trie_counts(words, np.cumsum(lengths) - lengths, lengths, pieces)
    total = np.concatenate([[0], np.cumsum(tokens[back])])
    bound = np.concatenate([[0], np.cumsum(n_words)])
    return n_words, total[bound[1:]] - total[bound[:-1]]


def token_counts(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """doc_id, n_words, n_tokens, one row per row of docs (doc_id, text).

    A null, empty or blank text has none of either. Null and repeated ids and
    repeated rows each keep a row; extra columns are ignored. The vocabulary is
    sent to all executors; a tokenizer's is of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.of(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in kernel.chunks(b.column("text")):
                n_words, n_tokens = chunk_counts(buf, off, shared.value)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n_words), pa.array(n_tokens)], ["doc_id", "n_words", "n_tokens"])

    rows = pick(docs, "doc_id", "text")
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, n_tokens long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), read_pieces())


QUERIES = {"op10_token_counts": op10}
ORACLE_SQL: dict[str, str] = {}
