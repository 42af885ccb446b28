"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and rates of the whole text, binned by quantiles. Cyclic
boosting visits the features in turn and adds a small piecewise-constant tree
on one feature's bins to the residual fit; the trees of a feature add up to one
lookup table. The pairs whose quadrants explain most of what is left get tables
over two features' coarse bins, boosted the same way by trees of one cut in each
feature. Coarse bins are ranges of the bins that a feature has. A score is the sum
of one entry of each table, added up for all documents of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import hash_mod3, pick, table

#: Labelled rows that the model is fitted on, at most: those with the smallest md5 of the id.
FIT_ROWS = 20_000
BINS, COARSE, LEAVES = 32, 8, 4
ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAF_ROWS, RIDGE = 150, 5, 60, 0.15, 10, 1.0

FEATURES = ["log_words", "word_length", "symbols", "capitals", "digits", "punct", "marks", "stops", "letters", "distinct", "repeats", "dup_lines", "line_words", "bytes_per_char"]


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document of a chunk; all finite."""
    m = {k: v.astype(float) for k, v in kernel.measures(buf, off).items()}
    words, chars, lines = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1), np.maximum(m["n_lines"], 1)
    size = np.diff(off).astype(float)
    return np.column_stack([
        np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words, m["n_upper"] / chars, m["n_digits"] / chars, m["n_punct"] / chars, m["n_marks"] / words, m["n_stops"] / words,
        m["n_letters"] / np.maximum(size, 1), m["n_distinct"] / words, m["n_repeat_words"] / words, m["n_dup_lines"] / lines, m["n_words"] / lines, size / np.maximum(m["n_chars"], 1),
    ])


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: np.ndarray  # feature, bin
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # pair, coarse bin * coarse bin

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[self.cells(b, i, j)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def cells(self, b: np.ndarray, i: int, j: int) -> np.ndarray:
        """Cells of two features' coarse bins, cut from the bins that each has."""
        ci, cj = (b[:, f] * COARSE // max(COARSE, len(self.edges[f]) + 1) for f in (i, j))
        return ci * COARSE + cj


def _tree(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Best split of the ordered bins into up to LEAVES leaves, greedily; the leaf value of each bin."""
    cuts = [0, len(grad)]
    g, h, n = (np.concatenate([[0], np.cumsum(v)]) for v in (grad, hess, rows))

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)

    while len(cuts) <= LEAVES:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = np.where(np.minimum(n[c] - n[a], n[b] - n[c]) >= LEAF_ROWS, worth(a, c) + worth(c, b) - worth(a, b), 0)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(c[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree that cuts both of two features once; a leaf of too few rows has value 0."""

    def below(v: np.ndarray) -> np.ndarray:
        return np.cumsum(np.cumsum(v.reshape(COARSE, COARSE), axis=0), axis=1)

    def leaves(v: np.ndarray) -> np.ndarray:  # leaf, cut of one, cut of the other
        t = below(v)
        low, left, up, all_ = t[:-1, :-1], t[:-1, -1:], t[-1:, :-1], t[-1, -1]
        return np.stack([low, left - low, up - low, all_ - left - up + low])

    g, h, n = leaves(grad), leaves(hess), leaves(rows)
    value = np.where(n >= LEAF_ROWS, g / (h + RIDGE), 0)
    gain = (value * g).sum(axis=0)
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    high_i, high_j = np.arange(COARSE)[:, None] > a, np.arange(COARSE)[None] > b
    return float(gain[a, b]), value[2 * high_i + high_j, a, b].ravel()


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on feature rows and labels 0 or 1; without rows, or with one class, the score is the smoothed rate."""
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    model = Model(float(np.log(share / (1 - share))), edges, np.zeros((len(FEATURES), BINS)), [], np.zeros((0, COARSE * COARSE)))
    if len(set(y.tolist())) < 2:
        return model
    b = model.bins(x)
    z = np.full(len(y), model.base)

    def boost(codes: np.ndarray, table_: np.ndarray, tree) -> None:
        p = 1 / (1 + np.exp(-z))
        size = len(table_)
        step = RATE * tree(np.bincount(codes, y - p, size), np.bincount(codes, p * (1 - p), size), np.bincount(codes, minlength=size))
        table_ += step
        z.__iadd__(step[codes])

    for _ in range(ROUNDS):
        for j in range(len(FEATURES)):
            boost(b[:, j], model.tables[j], _tree)
    p = 1 / (1 + np.exp(-z))
    gains = []
    for i, j in combinations(range(len(FEATURES)), 2):
        code, size = model.cells(b, i, j), COARSE * COARSE
        gains.append((_quadrants(np.bincount(code, y - p, size), np.bincount(code, p * (1 - p), size), np.bincount(code, minlength=size))[0], (i, j)))
    model.pairs = [ij for _, ij in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = np.zeros((len(model.pairs), COARSE * COARSE))
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            boost(model.cells(b, i, j), t, lambda g, h, n: _quadrants(g, h, n)[1])
    return model


def featured(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, with x, the features of text."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in kernel.chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in rest), pa.array(features(buf, off).tolist(), pa.list_(pa.float64()))], [*rest, "x"])

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in rest), "x array<double>"]))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled documents that are not held out, fit_rows of them at most.

    labels has doc_id and quality; rows with a null in either, or with another
    quality than 0 or 1, teach nothing, and of an id with several rows the
    largest quality counts. Of several documents of an id the one whose text has
    the smallest hash is learned from, so fit_rows bounds what the driver gets.
    """
    known = pick(labels, "doc_id", "quality").dropna().filter(F.col("quality").isin(0, 1) & (hash_mod3(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(fit_rows)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")  # of fit_rows at most
    one = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = featured(one).orderBy("doc_id").collect()
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["quality"] for r in got], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of docs (doc_id, text).

    Null and empty texts are scored as texts of no words. A null id counts as an
    empty one. Repeated rows each get a row; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in kernel.chunks(b.column("text")):
                s = shared.value.scores(features(buf, off))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "held_out")), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = pick(docs, "doc_id", "text").select("doc_id", "text", (hash_mod3(F.col("doc_id")) == 1).alias("held_out"))
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality_model": op8}
ORACLE_SQL: dict[str, str] = {}
