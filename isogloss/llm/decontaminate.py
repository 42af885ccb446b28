"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of the benchmark items. For the patterns of one
length a shift table tells, for a block of up to three words, how far a window
can move because no pattern holds that block any nearer to its end; most
positions are never looked at. Where the shift is zero the hash of the block,
the patterns' suffix, selects a bucket of patterns, and the words themselves
are compared to confirm. Documents are cut into lanes (overlapping by a window)
that move through the shift table in step, so each move is a numpy operation
over all lanes of a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import cut, filtered, pick, table

WINDOW, BLOCK = 13, 3
#: Bytes of benchmark text that are searched for, and sent to executors, at once. Arrays over its words take about ten times as much.
PATTERN_BYTES = 8 << 20
#: A document is contaminated if this many times its hit words reach its words.
SHARE = 20
_LANE, _BITS = 256, 20
#: Occurrences that are confirmed at a time.
_ROWS = 1 << 16


def _equal(buf: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ranges of sizes bytes from a in buf and from b in other hold the same bytes."""
    out = np.zeros(len(a), bool)
    bound = np.cumsum(sizes)
    for lo in range(0, len(a), _ROWS):
        n = sizes[lo : lo + _ROWS]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differs = buf[np.repeat(a[lo : lo + _ROWS], n) + inner] != other[np.repeat(b[lo : lo + _ROWS], n) + inner]
        wrong = np.concatenate([[0], np.cumsum(differs)])
        ends = bound[lo : lo + _ROWS] - (bound[lo - 1] if lo else 0)
        out[lo : lo + _ROWS] = wrong[ends] == wrong[ends - n]
    return out


class Group:
    """Patterns of one length: shift table and suffix buckets. A pattern is a place among the benchmark's words."""

    def __init__(self, length: int, at: np.ndarray, hashes: np.ndarray):
        self.length, self.block = length, min(length, BLOCK)
        self.shift = np.full(1 << _BITS, length - self.block + 1, np.int32)
        for end in range(self.block - 1, length):
            blocks = kernel.join_hashes(*[hashes[at + end - k] for k in range(self.block)])
            np.minimum.at(self.shift, (blocks >> np.uint64(64 - _BITS)).astype(np.int64), length - 1 - end)
        order = np.argsort(blocks, kind="stable")  # of the last block, the suffix
        self.suffix, self.at = blocks[order], at[order]

    def search(self, h: np.ndarray, n_words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and pattern numbers of the windows whose word hashes agree."""
        first = np.concatenate([[0], np.cumsum(n_words)])
        lanes = np.maximum(0, n_words - self.length + _LANE) // _LANE
        doc = np.repeat(np.arange(len(n_words)), lanes)
        inner = np.arange(len(doc)) - (np.cumsum(lanes) - lanes)[doc]
        pos = first[doc] + inner * _LANE + self.length - 1
        limit = np.minimum(pos + _LANE, first[doc + 1])
        found: list[np.ndarray] = []
        while len(pos):
            blocks = kernel.join_hashes(*[h[pos - k] for k in range(self.block)])
            move = self.shift[(blocks >> np.uint64(64 - _BITS)).astype(np.int64)]
            if len(at := pos[move == 0]):
                found.append(at)
            pos = pos + np.maximum(move, 1)
            going = pos < limit
            pos, limit = pos[going], limit[going]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        blocks = kernel.join_hashes(*[h[at - k] for k in range(self.block)])
        lo, hi = np.searchsorted(self.suffix, blocks, "left"), np.searchsorted(self.suffix, blocks, "right")
        n = hi - lo
        at = np.repeat(at, n)
        pattern = np.repeat(lo, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        head = at - self.length + 1
        for k in range(self.length):
            same = h[head + k] == hashes[self.at[pattern] + k]
            head, pattern = head[same], pattern[same]
        return head, pattern


class Search:
    """All windows of a list of (item, text), as arrays over the words of the texts."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = sorted({item for item, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        raws = [text.encode() for _, text in items]
        self.buf = kernel.LOWER[np.frombuffer(b"".join(raws), np.uint8)]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        self.starts, self.ends, n_words = kernel.spans(self.buf, off, kernel.ALNUM)
        self.hashes = kernel.Hasher(self.buf)(self.starts, self.ends) if len(self.buf) else np.zeros(0, np.uint64)
        item_of = np.array([number[item] for item, _ in items], np.int64)
        first, length = np.cumsum(n_words) - n_words, np.minimum(n_words, window)
        self.groups = []
        for size in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == size)
            count = n_words[own] - size + 1
            at = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            item = np.repeat(item_of[own], count)
            # Equal windows have equal words, told apart by 62-bit hashes each, and are one pattern with all of their items.
            order = np.lexsort([item, *(self.hashes[at + k] for k in range(size))])
            at, item = at[order], item[order]
            new = np.ones(len(at), bool)
            new[1:] = np.any([self.hashes[at[1:] + k] != self.hashes[at[:-1] + k] for k in range(size)], axis=0)
            group = Group(size, at[new], self.hashes)
            heads = np.append(np.flatnonzero(new), len(at))
            slot = np.searchsorted(at[new], group.at, sorter=(by := np.argsort(at[new])))
            self.groups.append((group, heads[by[slot]], heads[by[slot] + 1], item))

    def chunk(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each document, hit flags of all words, and (document, item number) of items with occurring windows."""
        low = kernel.LOWER[buf]
        starts, ends, n_words = kernel.spans(low, off, kernel.ALNUM)
        hit = np.zeros(len(starts) + 1, np.int64)
        found = [np.zeros(0, np.int64)]
        if self.groups and len(starts):
            h = kernel.Hasher(low)(starts, ends)
            doc = np.repeat(np.arange(len(n_words)), n_words)
            for group, lo, hi, item in self.groups:
                head, pattern = group.search(h, n_words, self.hashes)
                for k in range(group.length):  # the words themselves
                    mine, theirs = head + k, group.at[pattern] + k
                    size = ends[mine] - starts[mine]
                    same = size == self.ends[theirs] - self.starts[theirs]
                    head, pattern, mine, theirs, size = head[same], pattern[same], mine[same], theirs[same], size[same]
                    same = _equal(low, starts[mine], self.buf, self.starts[theirs], size)
                    head, pattern = head[same], pattern[same]
                np.add.at(hit, head, 1)
                np.add.at(hit, head + group.length, -1)
                pairs = np.unique(doc[head] * len(group.at) + pattern)  # of a document and a pattern
                at, pattern = np.divmod(pairs, len(group.at))
                n = hi[pattern] - lo[pattern]
                items = item[np.repeat(lo[pattern] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                found.append(np.repeat(at, n) * len(self.names) + items)
        docs, items = np.divmod(np.unique(np.concatenate(found)), max(1, len(self.names)))
        return n_words, np.cumsum(hit[:-1]) > 0, docs, items

    def items(self, docs: np.ndarray, items: np.ndarray, count: int) -> list[list[str]]:
        """Sorted item names of each of count documents."""
        bound = np.searchsorted(docs, np.arange(count + 1)).tolist()
        return [[self.names[i] for i in items[a:b].tolist()] if b > a else [] for a, b in zip(bound, bound[1:])]


def _pattern_parts(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items, limit bytes (as hashed) at a time; an item without an id or a text is none."""
    rows = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), "text").dropna()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // limit))
    for k in range(parts):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).toLocalIterator()]


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _columns(n_words: np.ndarray, n_hit: np.ndarray, items: list[list[str]]) -> list[pa.Array]:
    bad = (n_hit > 0) & (SHARE * n_hit >= n_words)
    return [pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items]), pa.array(bad)]


def _searched(batch: pa.RecordBatch, search: Search) -> Iterator[tuple]:
    for lo, hi, buf, off in kernel.chunks(batch.column("text")):
        n_words, hit, docs, items = search.chunk(buf, off)
        yield lo, hi, n_words, hit, search.items(docs, items, hi - lo)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, one row per row of docs (doc_id, text).

    An item is item_id and text; one whose id or text is null has no windows,
    and repeated rows of an item add up. A null or wordless document has no
    words and no hits. Ids may be null or repeated. Extra columns are ignored.
    Texts are searched whole, however long. An empty table gives an empty result,
    an empty benchmark no hits.
    A benchmark of up to pattern_bytes is sent to the executors whole; a larger
    one is searched part by part, and the parts' hits are merged by a shuffle.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text")
    id_type = dict(rows.dtypes)["doc_id"]
    parts = list(_pattern_parts(benchmark, pattern_bytes)) if _parts_fit(benchmark, pattern_bytes) else None
    if parts is not None:
        search = spark.sparkContext.broadcast(Search(parts[0], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, n_words, hit, items in _searched(b, search.value):
                    n_hit = kernel.per_doc(hit, np.concatenate([[0], np.cumsum(n_words)]))
                    cols = [b.column("doc_id").slice(lo, hi - lo), *_columns(n_words, n_hit, items)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return _by_parts(rows, benchmark, window, pattern_bytes)


def _parts_fit(benchmark: DataFrame, limit: int) -> bool:
    return (pick(benchmark, "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= limit


def _by_parts(rows: DataFrame, benchmark: DataFrame, window: int, limit: int) -> DataFrame:
    """As contamination(), for a benchmark that isn't sent whole: every part's hits per row, then their union."""
    spark = rows.sparkSession
    names = rows.columns
    # Each row gets a number that is fixed by being written; parts then speak of rows by it.
    numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    frames = []
    for items in _pattern_parts(benchmark, limit):
        search = spark.sparkContext.broadcast(Search(items, window))

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, n_words, hit, found in _searched(b, search.value):
                    bound = np.concatenate([[0], np.cumsum(n_words)])
                    at = [np.flatnonzero(hit[x:y]).tolist() for x, y in zip(bound[:-1], bound[1:])]
                    yield pa.RecordBatch.from_arrays([b.column("row").slice(lo, hi - lo), pa.array(n_words), pa.array(at, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], ["row", "n_words", "hits", "items"])

        frames.append(numbered.select("row", "text").mapInArrow(run, "row long, n_words long, hits array<long>, items array<string>"))
    hits = frames[0]
    for f in frames[1:]:
        hits = hits.union(f)
    merged = hits.groupBy("row").agg(F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.size("hits").cast("long")
    return numbered.select("row", names[0]).join(merged, "row").select(
        names[0], "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    Null, empty and wordless texts stay, and repeated rows stay or go together;
    an empty table gives an empty result.
    """
    if not _parts_fit(benchmark, pattern_bytes):
        names = docs.columns
        at = names.index("text")
        numbered = cut(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()))
        found = _by_parts(numbered.select("row", F.col(f"c{at}").alias("text")), benchmark, window, pattern_bytes)
        kept = found.filter(~F.col("contaminated")).select(F.col("row"))
        return numbered.join(kept, "row", "left_semi").drop("row").toDF(*names)
    parts = list(_pattern_parts(benchmark, pattern_bytes))
    search = docs.sparkSession.sparkContext.broadcast(Search(parts[0], window))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for lo, hi, buf, off in kernel.chunks(b.column(at)):
                n_words, hit, *_ = search.value.chunk(buf, off)
                n_hit = kernel.per_doc(hit, np.concatenate([[0], np.cumsum(n_words)]))
                keep.append((n_hit == 0) | (SHARE * n_hit < n_words))
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return filtered(docs, run)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3}
ORACLE_SQL: dict[str, str] = {}
