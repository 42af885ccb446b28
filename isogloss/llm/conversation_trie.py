"""Prefix trie of conversations in node tables with minimal perfect hashes.

Turns are sorted over all machines and cut into slices of equal size, whatever
conversation they are of. The digest of a prefix is the exclusive or of hashes
of its turns, each hashed with its depth, so a conversation that reaches over
slices gets its digests from running values inside a slice and one value from
those before it.

A shard is a slice; what goes on there from an earlier slice is a shard of its
own. In a shard the distinct prefix digests are enumerated and given slots by a
minimal perfect hash, whose look-ups compare the digest kept in the slot. Counts
are scattered into flat arrays by slot and added up through the array of parent
slots, the deepest first. A node may have slots in many shards: sums of all of
them, by digest, are the node's. Of sums over a subtree, each node counts once,
in the shard that holds its smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, pick, saved, table
from .kernel import mix

U64 = np.uint64
#: Turns of a shard at most, about; there are as many shards as shuffle partitions at least.
SHARD_ROWS = 1 << 18
#: Of op11: a conversation begins with the first turns, under HEAD of them, of the conversation whose id is the last multiple of GROUP.
GROUP, HEAD = 20, 4
_NONE = np.iinfo(np.int64).max


class NodeTable:
    """Slots 0..n-1 of n distinct pairs of 64-bit numbers.

    At each level the keys left are hashed to twice as many cells; a key that is
    alone in its cell gets the cell, and the others go to the next level. The
    slot is the rank of the cell. Look-ups compare the key in the slot.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        base = 0
        while len(a):
            cell = self._cell(a, b, len(self.levels), 2 * len(a))
            alone = np.bincount(cell, minlength=2 * len(a)) == 1
            rank = base + np.cumsum(alone) - alone
            self.levels.append((alone, rank))
            placed = alone[cell]
            at = rank[cell[placed]]
            self.a[at], self.b[at] = a[placed], b[placed]
            a, b, base = a[~placed], b[~placed], base + int(placed.sum())

    @staticmethod
    def _cell(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a ^ mix(b + U64(2 * level + 1))) % U64(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key that the table doesn't hold."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            cell = self._cell(a[left], b[left], level, len(alone))
            hit = alone[cell]
            at = rank[cell[hit]]
            key = left[hit]
            out[key] = np.where((self.a[at] == a[key]) & (self.b[at] == b[key]), at, -1)
            left = left[~hit]
        return out


def accumulate(values: np.ndarray, parent: np.ndarray, depth: np.ndarray, add=np.add) -> np.ndarray:
    """Values of subtrees: each slot's value is added to its parent's, the deepest first; -1 is no parent."""
    out = values.copy()
    order = np.argsort(-depth, kind="stable")
    order = order[parent[order] >= 0]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        add.at(out, parent[level], out[level])
    return out


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text) and words of every row with a conv_id; a null role or text is empty."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return rows.select(F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def _sliced(turns: DataFrame, shards: int) -> DataFrame:
    """c, slice, q, digest, words: turns in order, and each one's place among those of its conversation in its slice."""
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    rows = turns.withColumn("row", F.monotonically_increasing_id())  # repeated rows can be cut apart too
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = saved(rows.select("c", F.shiftright("at", 33).alias("slice"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), "digest", "words"))
    return rows.withColumn("q", F.row_number().over(Window.partitionBy("slice", "c").orderBy("place")) - 1).drop("place")


def rebuilt(conversations: DataFrame, group: int = GROUP, head: int = HEAD) -> DataFrame:
    """c, shard, depth, length, digest, words: the turns of every rebuilt conversation, and its turnless start at depth 0.

    Conversation c has the first h turns of conversation c - c % group (all if
    it has fewer, none if it isn't there), then its own turns after its first h;
    h is crc32(c in decimals) % head. Turns go by `turn`, null first, equal ones
    by digest; repeated rows are turns of their own.
    """
    spark = conversations.sparkSession
    turns = turn_rows(conversations)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(turns.count() / SHARD_ROWS))
    rows = saved(_sliced(turns, shards))
    by_slice = Window.partitionBy("c").orderBy("slice")
    runs = rows.groupBy("c", "slice").count()
    runs = runs.select(
        "c", "slice", (F.sum("count").over(by_slice) - F.col("count")).alias("before"),
        F.sum("count").over(Window.partitionBy("c")).alias("total"), F.min("slice").over(Window.partitionBy("c")).alias("first"),
    )
    least = rows.filter(F.col("q") < head - 1).join(runs.filter(F.col("before") < head - 1), ["c", "slice"])
    least = least.withColumn("p", F.col("before") + F.col("q")).filter(F.col("p") < head - 1)
    heads = least.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("p", "digest", "words"))).alias("heads"))
    h = F.pmod(F.crc32(F.col("c").cast("string")), F.lit(head)).cast("int")
    convs = runs.filter(F.col("slice") == F.col("first")).select("c", "first", "total", h.alias("h"), (F.col("c") - F.col("c") % group).alias("base"))
    convs = convs.join(heads.withColumnRenamed("c", "base"), "base", "left")
    given = F.slice(F.coalesce("heads", F.expr("CAST(array() AS array<struct<p: bigint, digest: binary, words: bigint>>)")), F.lit(1), F.col("h"))
    convs = convs.withColumn("given", given).withColumn("k", F.size("given")).withColumn("length", F.col("k") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
    convs = saved(convs.select("c", "first", "h", "k", "length", "given"))
    root = F.array(F.struct(F.lit(-1).cast("long").alias("p"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words")))
    starts = convs.select("c", (F.col("first") * 2 + 1).alias("shard"), "length", F.posexplode(F.concat(root, "given")).alias("depth", "g"))
    starts = starts.select("c", "shard", F.col("depth").cast("long").alias("depth"), "length", "g.digest", "g.words")
    own = rows.join(runs.join(convs.drop("first", "given"), "c"), ["c", "slice"]).filter(F.col("before") + F.col("q") >= F.col("h"))
    own = own.select(
        "c", (F.col("slice") * 2 + (F.col("slice") == F.col("first")).cast("int")).alias("shard"),
        (F.col("k") + F.col("before") + F.col("q") - F.col("h") + 1).alias("depth"), "length", "digest", "words",
    )
    return starts.unionByName(own)


def prefixes(steps: DataFrame) -> DataFrame:
    """steps with the digest (k1, k2) of each prefix and that (p1, p2) of the prefix before it."""
    one = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64("depth", "digest"))
    two = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64("digest", F.lit("second"), "depth"))
    rows = steps.withColumns({"e1": one, "e2": two})
    inside = Window.partitionBy("c", "shard").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("c").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # Only a conversation that reaches over shards has a value before a shard.
    runs = rows.groupBy("c", "shard").agg(F.bit_xor("e1").alias("e1"), F.bit_xor("e2").alias("e2"))
    before = runs.select("c", "shard", F.bit_xor("e1").over(earlier).alias("b1"), F.bit_xor("e2").over(earlier).alias("b2")).filter("shard % 2 = 0")
    rows = rows.withColumns({"k1": F.bit_xor("e1").over(inside), "k2": F.bit_xor("e2").over(inside)}).join(before, ["c", "shard"], "left")
    rows = rows.withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)})
    return rows.select("c", "shard", "depth", "length", "digest", "words", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)])


def _column(t: pa.Table, name: str, fill: int | None = None) -> np.ndarray:
    c = t.column(name)
    return (c if fill is None else c.fill_null(fill)).to_numpy()


_SLOTS = "shard long, slot long, parent long, k1 long, k2 long, p1 long, p2 long, depth long, digest binary, words long, n long, least long, tail long"


def shard_nodes(t: pa.Table) -> pa.Table:
    """The node table of one shard, from its prefixes: a row per slot, with members here, the least of them, and the conversation that goes on from it in a later shard."""
    order = np.lexsort((_column(t, "depth"), _column(t, "c")))
    t = t.take(pa.array(order))
    c, depth, length, words = (_column(t, n) for n in ("c", "depth", "length", "words"))
    k1, k2, p1, p2 = (_column(t, n).view(U64) for n in ("k1", "k2", "p1", "p2"))
    first = np.ones(len(c), bool)
    first[1:] = c[1:] != c[:-1]
    last = np.append(first[1:], True)
    # What stands before a run that goes on from an earlier shard is a node too, without members of its own.
    before = np.flatnonzero(first & (depth > 0))
    a, b = np.concatenate([k1, p1[before]]), np.concatenate([k2, p2[before]])
    by = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
    nodes = NodeTable(a[by][new], b[by][new])
    n = len(nodes.a)
    slot = nodes.find(k1, k2)
    up = np.where(depth > 0, nodes.find(p1, p2), -1)
    row = np.full(n, -1, np.int64)  # a row of each node
    row[slot] = np.arange(len(c))
    parent, at = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    at[nodes.find(p1[before], p2[before])] = depth[before] - 1
    parent[slot], at[slot] = up, depth
    digest = t.column("digest").combine_chunks()
    known, place = np.unique(np.array([d or b"" for d in digest.to_pylist()], object), return_inverse=True) if len(c) else ((), np.zeros(0, np.int64))
    if not ((parent[slot] == up) & (at[slot] == depth) & (place[row[slot]] == place)).all():
        raise RuntimeError("two prefixes share a digest")
    ends = slot[last]
    count, least, tail = np.zeros(n, np.int64), np.full(n, _NONE), np.full(n, _NONE)
    np.add.at(count, ends, 1)
    np.minimum.at(least, ends, c[last])
    goes_on = last & (depth < length)
    tail[slot[goes_on]] = c[goes_on]
    count, least = accumulate(count, parent, at), accumulate(least, parent, at, np.minimum)
    own = row >= 0
    count[~own] = 0
    some = pa.array(np.maximum(row, 0), mask=~own)

    def of(x: np.ndarray, there: np.ndarray) -> pa.Array:
        return pa.array(x, mask=~there)

    shard = np.full(n, _column(t, "shard")[0])
    columns = [shard, np.arange(n), parent, nodes.a.view(np.int64), nodes.b.view(np.int64), t.column("p1").take(some), t.column("p2").take(some), at, digest.take(some), t.column("words").take(some), count, of(least, own), of(tail, tail != _NONE)]
    return pa.table(dict(zip((f.split()[0] for f in _SLOTS.split(", ")), columns)))


_SUMS = "k1 long, k2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def subtree_sums(t: pa.Table) -> pa.Table:
    """What a shard's own nodes bring to the subtrees of its slots, and each slot's parent."""
    order = np.argsort(_column(t, "slot"))
    t = t.take(pa.array(order))
    parent, depth, conv = (_column(t, n) for n in ("parent", "depth", "conv_id"))
    sums = {n: accumulate(_column(t, n), parent, depth) for n in ("n_leaves", "saved_tokens")}
    above = pa.array(conv[np.maximum(parent, 0)], mask=parent < 0)
    out = pa.table({n: t.column(n) for n in ("k1", "k2", "conv_id", "depth")} | {"parent_conv_id": above} | {n: t.column(n) for n in ("n_convs", "n_children")} | {n: pa.array(x) for n, x in sums.items()})
    return out.filter(pa.array(_column(t, "n") > 0))  # not those that only stand before a run


def by_shard(df: DataFrame, run, schema: str) -> DataFrame:
    """Each shard through run; shards are dealt in order, so that partitions have about as many rows."""
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(run, schema)


def ends(steps: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: of each node that ends conversations, SHA-256 of their ids in order, comma-joined.

    Ids are joined piece by piece in sorted slices; only pieces meet in the task that hashes a node's.
    """
    shards = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, c = (b.column(n).to_numpy() for n in ("k1", "k2", "c"))
            if len(c):
                new = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
                ids = [",".join(map(str, c[i:j].tolist())) for i, j in zip(new, np.append(new[1:], len(c)))]
                yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (k1, k2, c)] + [pa.array(ids, pa.large_string())], ["k1", "k2", "c", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["k1", "k2", "ends_sha256"])

        for b in batches:
            done = []
            for k1, k2, ids in zip(*(b.column(n).to_pylist() for n in ("k1", "k2", "ids"))):
                if (k1, k2) != key:
                    if key is not None:
                        done.append(out())
                    key, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()
        if key is not None:
            yield out()

    last = steps.filter(F.col("depth") == F.col("length")).select("k1", "k2", "c")
    parts = last.repartitionByRange(shards, "k1", "k2", "c").sortWithinPartitions("k1", "k2", "c").mapInArrow(pieces, "k1 long, k2 long, c long, ids string")
    return parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "c").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, head: int = HEAD) -> DataFrame:
    """A row per node of the trie of rebuilt conversations (conv_id, turn, role, text); columns as op11 returns them.

    Rows without a conv_id take no part; a null role or text is empty. A
    conversation without turns is a member of the root. An empty table gives no
    node. Extra columns are ignored. A text may be of any length: only its
    digest and its number of words travel.
    """
    steps = saved(prefixes(rebuilt(conversations, group, head)))
    slots = saved(by_shard(steps, shard_nodes, _SLOTS))
    agree = (F.min("depth") == F.max("depth")) & F.min("digest").eqNullSafe(F.max("digest")) & F.min("p1").eqNullSafe(F.max("p1"))
    nodes = slots.groupBy("k1", "k2").agg(
        F.when(agree, F.sum("n")).otherwise(F.raise_error(F.lit("two prefixes share a digest"))).alias("n_convs"),
        F.min("least").alias("conv_id"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"),
    )
    nodes = saved(nodes)
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.select("k1", "k2", "n_convs", "conv_id").join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = F.col("least") == F.col("conv_id")
    slots = saved(
        slots.drop("p1", "p2", "digest").join(nodes, ["k1", "k2"])
        .withColumn("n_leaves", F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long"))
        .withColumn("saved_tokens", F.when(own, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).cast("long"))
    )
    # What a conversation's own nodes in later shards bring to the node where it leaves a shard.
    brought = slots.filter("shard % 2 = 0").groupBy("shard").agg(F.min("least").alias("c"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens"))
    tails = slots.filter("tail IS NOT NULL").select("shard", F.col("tail").alias("c"))
    later = Window.partitionBy("c").orderBy(F.col("shard").desc()).rangeBetween(Window.unboundedPreceding, -1)
    both = tails.withColumns({"more_leaves": F.lit(0).cast("long"), "more_tokens": F.lit(0).cast("long"), "is_tail": F.lit(True)}).unionByName(brought.withColumn("is_tail", F.lit(False)))
    more = both.select("shard", F.col("c").alias("tail"), "is_tail", *[F.coalesce(F.sum(n).over(later), F.lit(0)).alias(n) for n in ("more_leaves", "more_tokens")]).filter("is_tail").drop("is_tail")
    slots = slots.join(more, ["shard", "tail"], "left").select(
        "shard", "slot", "parent", "k1", "k2", "depth", "n", "conv_id", "n_convs", "n_children",
        *[(F.col(n) + F.coalesce(m, F.lit(0))).alias(n) for n, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_tokens"))],
    )
    parts = by_shard(slots, subtree_sums, _SUMS)
    whole = parts.groupBy("k1", "k2").agg(
        *[F.max(n).alias(n) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")], *[F.sum(n).alias(n) for n in ("n_leaves", "saved_tokens")]
    )
    out = whole.join(ends(steps), ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC_STEP = "list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)"
SQL = rf"""WITH crc_table AS (SELECT list({_CRC_STEP} ORDER BY i) AS t FROM (SELECT range::UBIGINT AS i FROM range(256))),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY p) AS s FROM turns GROUP BY 1),
heads AS (SELECT conv_id, s, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT), lambda x, d: xor(t[(xor(x, d) & 255)::BIGINT + 1], x >> 8)), 4294967295::UBIGINT)::BIGINT % 4 AS h FROM lists, crc_table),
built AS (SELECT a.conv_id, coalesce(b.s, [])[1:a.h] || a.s[a.h + 1:] AS s FROM heads a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 20),
members AS (SELECT conv_id, s[1:d] AS node, d, len(s) AS n FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM built)),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM members GROUP BY 1, 2),
kids AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[d].t, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes LEFT JOIN kids USING (node, d)),
above AS (SELECT node[1:k] AS node, k AS d, saved, n_children FROM (SELECT *, unnest(range(d + 1)) AS k FROM known)),
sums AS (SELECT node, d, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY 1, 2)
SELECT k.conv_id, k.d::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
FROM known k JOIN sums USING (node, d) LEFT JOIN nodes up ON up.node = k.node[1:k.d - 1] AND up.d = k.d - 1"""

QUERIES = {"op11_conversation_trie": op11}
ORACLE_SQL = {"op11_conversation_trie": SQL}
