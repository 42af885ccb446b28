"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are computed in Arrow batches. Distinct fingerprints are dealt to
buckets that share enough of their bits (pigeonhole: of `blocks` bit blocks at
least blocks - radius agree when no more than `radius` bits differ), so no link
is lost. Inside a bucket the fingerprints are stored as vertical bit planes, 64
members to a machine word. Distances of one fingerprint to all 64 members of a
block grow plane by plane in three carry-save bit counters, and a block is
abandoned when all of its lanes exceed the radius. A bucket gives back a
spanning forest of its links, never its pairs; stars are contracted over the
whole forest by joins with a checkpoint each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, table

U64 = np.uint64
RADIUS, BLOCKS, SHINGLE = 4, 6, 4
#: Members of one slot of a split bucket; a task compares two slots at a time.
SLOT = 1024
_ROWS = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of the word shingles; zero without words."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _ROWS):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo : lo + _ROWS], ends[lo : lo + _ROWS])], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp, one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint((t or "").encode(), width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {id_type}, text_hash long, fp long")


def block_masks(blocks: int, agree: int) -> list[int]:
    """Bit masks of every choice of `agree` of the bit blocks."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(one[i] for i in chosen) for chosen in combinations(range(blocks), agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_pairs(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked members of each group; groups lie one after another."""
    blocks = -(-sizes // 64)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    group = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(fps)) - first[group]
    place = (first_block[group] + inner // 64) * 64 + inner % 64  # lane of each member
    lanes = np.zeros(first_block[-1] * 64, np.uint64)
    lanes[place] = fps
    member = np.full(len(lanes), -1, np.int64)
    member[place] = np.arange(len(fps))
    bits = np.unpackbits(lanes.astype(">u8").view(np.uint8).reshape(-1, 64, 8), axis=2)  # block, lane, bit
    planes = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little").view("<u8")[:, :, 0]  # bit, block
    valid = np.packbits((member >= 0).reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    own = first_block[group] + inner // 64
    left = first_block[group + 1] - own  # blocks from the member's own to the group's last
    bound = np.concatenate([[0], np.cumsum(left)])
    lo = 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(bound, bound[lo] + _ROWS, "right")) - 1)
        q = np.repeat(np.arange(lo, hi), left[lo:hi])
        blk = own[q] + np.arange(len(q)) - (bound[q] - bound[lo])
        over = ~valid[blk]
        c0, c1, c2 = (np.zeros(len(q), np.uint64) for _ in range(3))
        fq = fps[q]
        for p in range(64):
            diff = planes[p][blk] ^ (U64(0) - ((fq >> U64(63 - p)) & U64(1)))
            carry = c0 & diff
            c0 = c0 ^ diff
            carry, c1 = c1 & carry, c1 ^ carry
            carry, c2 = c2 & carry, c2 ^ carry
            over |= carry  # eight or more
            if p % 8 == 7:
                beyond = over | _above(c0, c1, c2, radius)
                alive = ~beyond != 0
                if not alive.all():
                    q, blk, fq, over, c0, c1, c2 = (x[alive] for x in (q, blk, fq, over, c0, c1, c2))
                    if not len(q):
                        break
        if len(q):
            near = ~(over | _above(c0, c1, c2, radius))
            row, lane = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = q[row], member[blk[row] * 64 + lane]
            later = b > a
            yield a[later], b[later]
        lo = hi


def _above(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter exceeds the radius (0 to 7)."""
    above = np.zeros(len(c0), np.uint64)
    for v in range(radius + 1, 8):
        above |= (c0 if v & 1 else ~c0) & (c1 if v & 2 else ~c1) & (c2 if v & 4 else ~c2)
    return above


def forest(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, smaller-index fp) that connect what links connect."""
    label = np.arange(len(fps))
    for a, b in linked_pairs(fps, sizes, radius):
        while True:
            ra, rb = label[a], label[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while (jump := label[label]).tolist() != label.tolist() if len(label) < 64 else not np.array_equal(jump := label[label], label):
                label = jump
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """u, v: forest edges of each group; members has grp (long hash) parts t, key, i, j and fp, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(fps, ids):
            new = np.ones(len(fps), bool)
            new[1:] = (ids[:, 1:] != ids[:, :-1]).any(axis=0)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fps)))
            keep = np.repeat(sizes > 1, sizes)
            if not keep.any():
                return None
            u, v = forest(fps[keep], sizes[sizes > 1], radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        held = None
        for b in batches:
            ids = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "i", "j")])
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if held is not None:
                fps, ids = np.concatenate([held[0], fps]), np.concatenate([held[1], ids], axis=1)
            if not len(fps):
                continue
            tail = (ids == ids[:, -1:]).all(axis=0)  # the last group may go on in the next batch
            split = len(fps) - int(tail[::-1].argmin()) if not tail.all() else 0
            held = fps[split:], ids[:, split:]
            if split and (out := links(fps[:split], ids[:, :split])) is not None:
                yield out
        if held is not None and (out := links(*held)) is not None:
            yield out

    return members.mapInArrow(run, "u long, v long")


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """Bit blocks that make the least work for so many fingerprints: more blocks, more copies of each but smaller buckets."""

    def work(blocks: int) -> float:
        bits = 64 * (blocks - radius) // blocks
        return comb(blocks, radius) * (1 + count / 2**bits / 64)

    return min(range(radius + 2, radius + 7), key=work)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, slot: int = SLOT) -> DataFrame:
    """u, v: a forest of the links between distinct fingerprints (column fp), those of radius differing bits at most."""
    masks = block_masks(blocks, blocks - radius)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    # A bucket beyond one slot is dealt to slots, and each two slots meet in a group of their own.
    hot = dealt.groupBy("t", "key").count().filter(F.col("count") > slot).select("t", "key", F.ceil(F.col("count") / slot).cast("int").alias("slots"))
    s = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("slots")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda j: F.struct(F.least(F.col("s"), j).alias("i"), F.greatest(F.col("s"), j).alias("j")))
    members = (
        dealt.join(hot, ["t", "key"], "left")
        .withColumn("slots", F.coalesce("slots", F.lit(1)))
        .withColumn("s", s)
        .select("t", "key", "fp", F.explode(pair).alias("p"))
        .select(F.col("t").cast("long").alias("t"), "key", F.col("p.i").cast("long").alias("i"), F.col("p.j").cast("long").alias("j"), "fp")
    )
    members = members.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return bucket_links(members, radius).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root: the smallest node reachable, for every node of an edge (u, v). Alternating large and small stars."""
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        # The least neighbours are written before they are joined, so that a hub's rows, dealt anew for the join alone, can be split.
        both = now.union(now.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = cut(small)
    else:
        raise RuntimeError("the components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp, root and component_id of every row of docs (doc_id, text).

    Null or wordless texts have fingerprint zero. Repeated rows and ids each
    keep a row. component_id is the smallest id of the component; it is null
    only where all of its ids are. Extra columns are ignored. An empty table
    gives an empty result. Without `blocks` their number follows the table's
    size, which changes the work and no link.
    """
    rows = cut(fingerprints(docs, width))
    each = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(each.select("fp"), radius, blocks or blocks_for(each.count(), radius)))
    each = cut(each.join(roots, each["fp"] == roots["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root")))
    least = cut(each.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    of = cut(each.select("fp", "root").join(least, "root"))
    return rows.join(of, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


#: Of keep_one: shingles of two words at seven bits find 0.92 of the pairs with a five-word similarity of 0.8 (9,000 documents of check_s); the contract's four words at four bits 0.34.
KEEP_RADIUS, KEEP_SHINGLE = 7, 2


def keep_one(docs: DataFrame, radius: int = KEEP_RADIUS, width: int = KEEP_SHINGLE) -> DataFrame:
    """The rows of docs, one of each component: that with the smallest (id, text hash).

    Links are all fingerprints that differ in radius bits (7 at most), whatever
    the table's size. Null and wordless texts are copies of each other, as are
    repeated rows: one of them stays. A null id comes last. Other columns stay as
    they are; texts are taken whole, of any length; an empty table gives an empty
    result.
    """
    names = docs.columns
    found = near_duplicates(docs, radius, width=width)
    id_hash = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    kept = found.groupBy("root").agg(F.min(id_hash).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("h", F.xxhash64(f"c{names.index('text')}"))
    doc_id = f"c{names.index('doc_id')}"
    # Both sides are dealt by id and text hash, so the last step needs no shuffle of its own.
    one = plain.join(kept, plain[doc_id].eqNullSafe(kept["kept_id"]) & (plain["h"] == kept["kept_hash"]), "left_semi").dropDuplicates([doc_id, "h"])
    return one.drop("h").toDF(*names)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9}
ORACLE_SQL: dict[str, str] = {}
