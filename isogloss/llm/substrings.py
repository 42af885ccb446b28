"""Removal of repeated substrings by prefix-free parsing of the corpus.

A rolling hash of WIDTH bytes decides where phrases begin: each place whose hash
is 0 at the MODULUS is a trigger, and a phrase reaches from one trigger through
the next. No phrase's end (of over WIDTH bytes) begins another, so the corpus
order of all places follows from two orders: that of the ends of phrases (the
dictionary) and that of what follows them (the parse). A LENGTH-byte window
belongs to the first trigger inside it; one that holds none belongs to its least
hash, also a matter of its bytes only. Equal windows thus have one trigger at
the same place, and the windows of one trigger in one text lie in a row.

Step 1, the dictionary: windows of a trigger, as phrases with what follows them,
are counted by (trigger, phrase) hashes. All windows of a phrase that occurs
twice are repeated; those of a phrase whose trigger occurs in no other are not.

Step 2, corpus order: the distinct phrases that share a trigger are the only
ones left. Of these, the parts before the trigger (suffixes of the dictionary's
phrases, sorted from their ends) and the parts from the trigger on (suffixes of
the parse, sorted) get ranks and common-prefix lengths. A window is the pair of
one rank of each order, cut at its own two lengths, and two windows are equal
just if both ranks fall in the same classes.

A trigger with more than GROUP distinct phrases is divided first: its windows go
into eight runs by their place before the trigger, phrases that are equal
over a run become one, and those that share the bytes common to all windows of
the run form new groups. A text that differs from its copies in one place falls
out of all runs but those around the difference, so rows stay in proportion
to phrases however large a group of near copies is. Bodies go through the
shuffle cut to the run.

Bytes covered by repeated windows are removed. Trigger hashes only group;
phrases are told apart by 62-bit hashes beside them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import cut, pick, saved, table

U64 = np.uint64
LENGTH, WIDTH, MODULUS = 400, 48, 160
#: Distinct phrases of a group that one task sorts; larger groups are divided.
GROUP = 1024
#: Bytes that a task parses at a time.
CHUNK = 1 << 19
_POS = (CHUNK * 2).bit_length()


def windows(buf: np.ndarray, off: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """Phrases of a chunk: trigger hash, phrase hash, document, first and last window, and trigger position."""
    n = len(buf) - length + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    roll = kernel.Roller(buf)
    pos = np.arange(len(buf) - width + 1)
    hashes = roll(pos, pos + width)
    triggers = np.append(np.flatnonzero(hashes < U64(2**64 // MODULUS)), len(buf))  # 0 in the top bits
    trigger = triggers[np.searchsorted(triggers, np.arange(n))]
    span, size = length - width + 1, 1
    without = trigger >= np.arange(n) + span
    if without.any():
        least = (hashes & ~U64((1 << _POS) - 1)) | pos.astype(np.uint64)
        while size * 2 <= span:  # minima of 1, 2, 4 ... positions, then of span
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if rest := span - size:
            least = np.minimum(least[:-rest], least[rest:])
        trigger[without] = (least[without] & U64((1 << _POS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    i = np.flatnonzero(np.arange(n) + length <= off[doc + 1])  # windows inside a document
    if not len(i):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    q = trigger[i]
    new = np.ones(len(i), bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1] + 1)
    first = i[new]
    last = i[np.append(np.flatnonzero(new)[1:], len(i)) - 1]
    q = q[new]
    phrase = kernel.join_hashes(kernel.Hasher(buf)(first, last + length), (q - first).astype(np.uint64), (last - first).astype(np.uint64))
    return roll(q, q + width), phrase, doc[first], first, last, q


def pieces(col: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, bytes, offsets and shift of chunks; a longer text comes in overlapping pieces."""
    for lo, _, buf, off in kernel.chunks(col, CHUNK):
        if len(buf) <= 2 * CHUNK:
            yield lo, buf, off, 0
            continue
        for s in range(0, len(buf) - length + 1, CHUNK):
            part = buf[s : s + CHUNK + length - 1]
            yield lo, part, np.array([0, len(part)]), s


#: A phrase's place: first window, and (in 10 bits each) the last window and the trigger from there on.
def packed(first: np.ndarray, last: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (first << 20) | ((last - first) << 10) | (q - first)


def unpacked(place: int) -> tuple[int, int, int]:
    first = place >> 20
    return first, first + ((place >> 10) & 1023), first + (place & 1023)


def parse(texts: DataFrame, length: int, width: int) -> DataFrame:
    """k (trigger), e (phrase), th, tl (text) and place of every phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            th, tl = (b.column(c).to_numpy(zero_copy_only=False) for c in ("th", "tl"))
            for lo, buf, off, shift in pieces(b.column("text"), length):
                k, e, doc, first, last, q = windows(buf, off, length, width)
                start = off[doc] - shift if len(doc) else doc
                place = packed(first - start, last - start, q - start)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k.view(np.int64), e.view(np.int64), th[doc + lo], tl[doc + lo], place)], ["k", "e", "th", "tl", "place"])

    return texts.mapInArrow(run, "k long, e long, th long, tl long, place long")


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _ordered(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each part in the sorted order, and common prefixes of neighbours there."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    rank = np.empty(len(parts), np.int64)
    rank[order] = np.arange(len(parts))
    return rank, np.array([_common(parts[a], parts[b]) for a, b in zip(order, order[1:])], np.int64)


def equal_windows(before: list[bytes], after: list[bytes], reach: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """(phrase, least, most) runs of bytes before the trigger whose windows equal a window of another phrase.

    reach: the least and most bytes before the trigger of each phrase's windows.
    """
    n = len(before)
    low, high = (np.array(x) for x in zip(*reach))
    cut = np.arange(low.min(), high.max() + 1)
    rank_b, common_b = _ordered([x[::-1] for x in before])
    rank_a, common_a = _ordered(after)
    zero = np.zeros((len(cut), 1), np.int64)
    class_b = np.hstack([zero, np.cumsum(common_b[None] < cut[:, None], axis=1)])[:, rank_b]
    class_a = np.hstack([zero, np.cumsum(common_a[None] < length - cut[:, None], axis=1)])[:, rank_a]
    key = np.where((cut[:, None] >= low) & (cut[:, None] <= high), class_b * n + class_a, -1 - np.arange(n))
    order = np.argsort(key, axis=1)
    ranked = np.take_along_axis(key, order, axis=1)
    same = ranked[:, 1:] == ranked[:, :-1]
    twice = np.zeros(key.shape, bool)
    edge = np.zeros((len(cut), 1), bool)
    np.put_along_axis(twice, order, np.hstack([same, edge]) | np.hstack([edge, same]), axis=1)
    out = []
    for r in np.flatnonzero(twice.any(axis=0)):
        at = np.flatnonzero(twice[:, r])
        ends = np.flatnonzero(np.diff(at) != 1)
        out += [(int(r), int(cut[a]), int(cut[b])) for a, b in zip(at[np.append(0, ends + 1)], at[np.append(ends, len(at) - 1)])]
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, where rows become Python objects."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def packed_texts(texts: DataFrame) -> DataFrame:
    """texts with text compressed (z), as it goes through shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in _slices(batches):
            z = pa.array([press.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), z], [*rest, "z"])

    rest, types = [c for c in texts.columns if c != "text"], dict(texts.dtypes)
    return texts.select(*rest, "text").mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in rest), "z binary"]))


#: A group's phrases: text, trigger position there, fewest and most bytes of windows before it, and the bytes of these windows.
_PHRASES = "g long, e long, many boolean, th long, tl long, q long, lo long, hi long, body binary"
_NAMES = ["g", "e", "many", "th", "tl", "q", "lo", "hi", "body"]
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
#: Parts of a run of windows, when a large group is divided.
PARTS = 8


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)


def _bodies(texts: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """reps (k, e, many, th, tl, place) with their bytes, as _PHRASES; a text goes through the shuffle once for all of its phrases."""
    listed = reps.groupBy("th", "tl").agg(F.sort_array(F.collect_list(F.struct("k", "e", "many", "place"))).alias("phrases"))
    carried = packed_texts(texts.select("th", "tl", "text")).join(listed, ["th", "tl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None  # copies of a text lie side by side; one of them is enough
        for b in _slices(batches):
            out: list[tuple] = []
            held = 0
            for th, tl, z, phrases in zip(*(b.column(c).to_pylist() for c in ("th", "tl", "z", "phrases"))):
                if (th, tl) == seen:
                    continue
                seen = th, tl
                raw = zstandard.decompress(z)
                for p in phrases:
                    first, last, q = unpacked(p["place"])
                    out.append((p["k"], p["e"], p["many"], th, tl, q, q - last, q - first, raw[first : last + length]))
                    held += last + length - first
                    if held > 8 * CHUNK:
                        yield _batch(out, _NAMES, _TYPES)
                        out, held = [], 0
            if out:
                yield _batch(out, _NAMES, _TYPES)

    return carried.select("th", "tl", "z", "phrases").mapInArrow(run, _PHRASES)


def _divided(phrases: DataFrame, length: int, size: int) -> DataFrame:
    """Rows of phrases (_PHRASES) for each run of `size` places before the trigger that their windows reach into, cut to that run.

    g is then a hash of the old g, the run, and the bytes that all windows of the
    run share; same one of all bytes of the row's windows there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [*_NAMES, "same"], [*_TYPES, pa.int64()]
        for b in _slices(batches):
            out: list[tuple] = []
            for g, e, many, th, tl, q, lo, hi, body in zip(*(b.column(c).to_pylist() for c in _NAMES)):
                for part in range(lo // size, hi // size + 1):
                    a, z = max(lo, part * size), min(hi, part * size + size - 1)
                    part_body = body[hi - z : hi + length - a]
                    core = body[hi - part * size : hi + max(0, length - part * size - size + 1)]
                    key = _key(b"%d %d " % (g, part * size), core)
                    out.append((key, e, many, th, tl, q, a, z, part_body, _key(b"%d %d %d " % (key, a, z), part_body)))
            yield _batch(out, names, types)

    return phrases.select(*_NAMES).mapInArrow(run, f"{_PHRASES}, same long")


def _key(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _settled(bodies: DataFrame, length: int) -> DataFrame:
    """th, tl, a, b: first and last repeated windows among the phrases of each group."""

    def settle(group: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        group = list({x[0]: x for x in group}.values())  # one of each phrase
        if len(group) < 2:
            return
        before, after = [x[7][: x[6]] for x in group], [x[7][x[6] :] for x in group]
        for r, least, most in equal_windows(before, after, [(x[5], x[6]) for x in group], length):
            _, many, th, tl, q, *_ = group[r]
            if not many:  # else all of its windows are known to be repeated
                yield th, tl, q - most, q - least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["th", "tl", "a", "b"], [pa.int64()] * 4
        trigger, group = None, []
        for b in _slices(batches):
            out: list[tuple] = []
            for k, *rest in zip(*(b.column(c).to_pylist() for c in _NAMES)):
                if k != trigger:
                    out += settle(group)
                    trigger, group = k, []
                group.append(rest)
            yield _batch(out, names, types)
        yield _batch(list(settle(group)), names, types)

    return bodies.select(*_NAMES).repartition("g").sortWithinPartitions("g", "e").mapInArrow(run, "th long, tl long, a long, b long")


def repeated(texts: DataFrame, length: int = LENGTH, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """th, tl and runs (first and last window starts, in bytes) of the texts (th, tl, text) with repeated windows."""
    rows = parse(texts, length, width)
    phrases = saved(rows.groupBy("k", "e").agg(F.count("*").alias("n"), F.min(F.struct("th", "tl", "place")).alias("at")))
    shared = phrases.groupBy("k").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    reps = cut(phrases.join(shared, "k").select("k", "e", (F.col("n") > 1).alias("many"), (F.col("kinds") > group).alias("large"), "at.*"))
    first, last = F.shiftright("place", 20), F.shiftright("place", 20) + F.shiftright("place", 10).bitwiseAND(F.lit(1023))
    whole = rows.join(phrases.filter("n > 1").select("k", "e"), ["k", "e"]).select("th", "tl", first.alias("a"), last.alias("b"))
    runs = whole.union(_settled(_bodies(texts, reps.filter("not large"), length), length))
    large, size = reps.filter("large"), 1
    if not large.isEmpty():
        left = _bodies(texts, large, length)
        while size < length:
            size *= PARTS
        while size > 1:
            size //= PARTS
            parts = saved(_divided(left, length, size))
            kinds = parts.groupBy("g", "same").agg(F.count("*").alias("n"), F.max("many").alias("any"), F.min("e").alias("e"))
            kinds = cut(kinds.withColumn("any", F.expr("any or n > 1")))
            runs = runs.union(parts.join(kinds.filter("any").select("g", "same"), ["g", "same"]).filter("not many").select("th", "tl", F.expr("q - hi").alias("a"), F.expr("q - lo").alias("b")))
            sizes = kinds.groupBy("g").agg(F.count("*").alias("kinds")).filter("kinds > 1")
            one = parts.drop("many").join(kinds.select("g", "same", "e", F.col("any").alias("many")), ["g", "same", "e"]).join(sizes, "g")
            runs = runs.union(_settled(one.filter(F.col("kinds") <= group), length))
            left = one.filter(F.col("kinds") > group)
            if left.isEmpty():
                break
    runs = runs.distinct()
    return runs.groupBy("th", "tl").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def deduplicated(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) and spans, one row per row of docs (doc_id, text).

    A null text is empty. Copies of a text, repeated rows among them, are
    repeats of each other and lose all their bytes if they have `length` or
    more; shorter texts lose none. Ids may be null or repeated. Extra columns
    are ignored; an empty table gives an empty result.
    """
    size = F.shiftleft(F.octet_length("text").cast("long"), 32)
    texts = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("th"), (size + F.crc32("text")).alias("tl"))
    runs = repeated(texts.select("th", "tl", "text").filter(F.octet_length("text") >= length), length, width, group)
    joined = packed_texts(texts).join(runs, ["th", "tl"], "left").select("doc_id", "z", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        for b in _slices(batches):
            cols: list[list] = [[] for _ in names[1:]]
            for z, runs in zip(b.column("z").to_pylist(), b.column("runs").to_pylist()):
                raw, spans = zstandard.decompress(z), []
                for r in runs or ():
                    a, z = r["a"], r["b"] + length
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    else:
                        spans.append([a, z])
                ends = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(ends[::2], ends[1::2]))
                for c, v in zip(cols, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"s": s, "e": e} for s, e in spans])):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    id_type = dict(texts.dtypes)["doc_id"]
    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<s:long,e:long>>")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"))


QUERIES = {"op5_substrings": op5}
ORACLE_SQL: dict[str, str] = {}
