"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams of letters. A document
is a mixture of languages: expectation-maximisation estimates their proportions
from its trigram counts. Languages enter the set one by one, each only if the
log-likelihood it adds exceeds a penalty (half the log of the trigram count per
language, on counts divided by the overlap of trigrams). The prediction is the
language of largest proportion in the set that was selected. Each document is
inferred from its own trigrams alone and stops by its own movement, so results
don't depend on what else is in a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import filtered, hash_mod3, pick, table

GRAMS = 1 << 13
ROUNDS, SMOOTH, OVERLAP = 15, 0.5, 3.0
#: Languages enter only if their proportion among all is at least this; proportions that move by less than STILL are taken.
LEAST, STILL = 0.02, 1e-3
#: Languages whose counts a task holds before it hands them on.
HELD = 256
MIN_SCORE = 0.35

_FOLD = np.full(256, 0x20, np.uint8)
for _lo, _hi, _add in ((0x61, 0x7A, 0), (0x80, 0xFF, 0), (0x41, 0x5A, 32)):
    _FOLD[_lo : _hi + 1] = np.arange(_lo, _hi + 1) + _add


def gram_codes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of folded letters and the document of each; blanks only are left out."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _FOLD[buf]
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1  # capital Latin letters with accents
    caps = after[(buf[after] >= 0x80) & (buf[after] <= 0x9E) & (buf[after] != 0x97)]
    low[caps] += 0x20
    wide = low.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    good = code != 0x202020
    cross = off[1:-1]
    for back in (1, 2):  # trigrams over the end of a document
        at = cross - back
        good[at[(at >= 0) & (at < len(good))]] = False
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(good)]
    return ((code[good] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64), doc[good]


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_ = kernel.byte_set((0x41, 0x5A), (0x61, 0x7A))
    found = kernel.per_doc(ascii_[buf], off) > 0
    for i in np.flatnonzero(~found & (kernel.per_doc(buf >= 0x80, off) > 0)):
        found[i] = any(map(str.isalpha, buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


@dataclass
class Model:
    langs: list[str]
    probs: np.ndarray  # language, gram

    def __post_init__(self):
        self.by_gram = np.ascontiguousarray(self.probs.T)

    @staticmethod
    def em(counts: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood of a document with these trigram counts; p has a row for each trigram, a column for each language."""
        pi, n = np.full(p.shape[1], 1 / p.shape[1]), counts.sum()
        for _ in range(ROUNDS):
            new = pi * ((counts / (p @ pi)) @ p) / n
            new /= new.sum()
            moved, pi = np.abs(new - pi).max(), new
            if moved < STILL:
                break
        return pi, float(counts @ np.log(p @ pi))

    def select(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Proportions of the languages selected for a document, 0 for others. Without trigrams nothing speaks for any: equal shares."""
        k = self.by_gram.shape[1]
        out = np.zeros(k)
        if not len(grams):
            return out + 1 / k
        p = self.by_gram[grams]
        single = counts @ np.log(p)
        chosen = [int(single.argmax())]
        best, like = np.ones(1), float(single.max())
        penalty = 0.5 * np.log(max(counts.sum(), 2))
        full = self.em(counts, p)[0]
        for lang in np.argsort(-full, kind="stable").tolist():
            if lang in chosen:
                continue
            if full[lang] < LEAST:
                break
            tried, got = self.em(counts, p[:, [*chosen, lang]])
            if (got - like) / OVERLAP <= penalty:
                break
            chosen, best, like = [*chosen, lang], tried, got
        out[chosen] = best
        return out

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, list[list[str]]]:
        """Language, its proportion, and the selected languages of each document of a chunk."""
        docs = len(off) - 1
        langs, scores, sets = ["und"] * docs, np.zeros(docs), [[] for _ in range(docs)]
        if not self.langs:
            return langs, scores, sets
        code, doc = gram_codes(buf, off)
        bound = np.searchsorted(doc, np.arange(docs + 1))
        for i in np.flatnonzero(has_letter(buf, off)).tolist():
            counts = np.bincount(code[bound[i] : bound[i + 1]], minlength=GRAMS)
            grams = np.flatnonzero(counts)
            pi = self.select(grams, counts[grams].astype(np.float64))
            top = int(pi.argmax())
            langs[i], scores[i] = self.langs[top], min(1.0, pi[top])
            sets[i] = [self.langs[j] for j in np.flatnonzero(pi > 0)]
        return langs, scores, sets


def fit(docs: DataFrame) -> Model:
    """Learn from the rows of docs (text, lang), whole texts; null languages and texts teach nothing.

    The model, languages times GRAMS counts, goes through the driver: languages
    are a closed set of labels and don't grow with the documents.
    """

    def flush(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([x.tolist() for x in held.values()], pa.list_(pa.int64()))], ["lang", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column("lang").to_pylist()
            for lo, hi, buf, off in kernel.chunks(b.column("text")):
                code, doc = gram_codes(buf, off)
                langs, own = np.unique(names[lo:hi], return_inverse=True)
                own = own[doc]
                for i, lang in enumerate(langs.tolist()):
                    if lang not in held and len(held) >= HELD:
                        yield flush(held)
                        held = {}
                    held[lang] = held.get(lang, 0) + np.bincount(code[own == i], minlength=GRAMS)
        if held:
            yield flush(held)

    rows = pick(docs, "text", "lang").dropna()
    parts = rows.mapInArrow(run, "lang string, counts array<long>")
    sums = parts.select("lang", F.posexplode("counts").alias("gram", "n")).groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n > 0").toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((len(langs), GRAMS))
    counts[np.searchsorted(langs, sums["lang"]), sums["gram"]] = sums["n"]
    return Model(langs, (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * GRAMS))


def learn_rows(docs: DataFrame) -> DataFrame:
    rows = pick(docs, "doc_id", "text", "lang")
    return rows.filter(hash_mod3(F.col("doc_id")) != 1).select("text", "lang")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and langs (those selected), one row per row of docs (doc_id, text).

    A text that is null or has no letter is `und` with score 0; so is every text
    if no language was learned. A text with letters but no trigram gets the first
    language and 1 / languages, as has a tie. A null id counts as an empty one.
    Repeated rows each get a row; extra columns are ignored; long texts are
    counted whole. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in kernel.chunks(b.column("text")):
                langs, scores, sets = shared.value.predict(buf, off)
                cols = [b.column(c).slice(lo, hi - lo) for c in ("doc_id", "held_out")] + [pa.array(langs), pa.array(scores), pa.array(sets, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score", "langs"])

    rows = pick(docs, "doc_id", "text").select("doc_id", "text", (hash_mod3(F.col("doc_id")) == 1).alias("held_out"))
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, langs array<string>")


def accepted(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs with a language of at least min_score, with all their columns.

    Null, empty and letterless texts go. Repeated rows stay or go together;
    an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for _, _, buf, off in kernel.chunks(b.column(at)):
                langs, scores, _ = shared.value.predict(buf, off)
                keep.append((np.array(langs, dtype=object) != "und") & (scores >= min_score))
            if keep:
                yield b.filter(pa.array(np.concatenate(keep).astype(bool)))

    return filtered(docs, run)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(learn_rows(docs)))


QUERIES = {"op6_language_id": op6}
ORACLE_SQL: dict[str, str] = {}
