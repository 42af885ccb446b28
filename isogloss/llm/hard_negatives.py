"""Hard negatives by an exact search in multiway hyperplane trees.

Every row goes to the nearest of a few split points, which parts space by
hyperplanes into cells. Of each cell the least and greatest distance of its rows
to every split point is kept. A query asks for scores in a window, which is an
annulus around it: by the triangle inequality the annulus bounds the distance of
what it can hold to each split point, and a cell whose range lies outside of
these bounds for one of them is left out. Cells are dealt to blocks of bounded
size; inside a block the same tree goes on, down to leaves that are searched
exactly. A window narrows as soon as enough rows of it are known.

Scores are inner products. With a further coordinate that gives all rows the
same length (zero in a query), a score is a distance and a window an annulus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, saved, table

#: Split points of the first level, of a node in a block, and rows of a leaf.
SPLITS, FAN, LEAF = 64, 8, 64
#: Rows from which the first split points are taken, those with the least hash; rows of a block, and queries of a task with it.
CANDIDATES, BLOCK, PER_TASK = 1024, 1 << 14, 1 << 16
#: Components beyond this are refused, as sums of their products could be inexact.
LARGEST = 1 << 20
_LOW, _HIGH = -(1 << 60), 1 << 60


def far_points(x: np.ndarray, k: int) -> np.ndarray:
    """Places of up to k rows, each the farthest from those before it; fewer if the others equal one of them."""
    chosen = [0]
    d = _squares(x, x[:1])[:, 0]
    while len(chosen) < k and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, _squares(x, x[chosen[-1:]])[:, 0])
    return np.array(chosen)


def _squares(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T), 0)


@dataclass
class Space:
    """The further coordinate of rows of a squared length up to `most`, and the slack that rounding needs."""

    most: float

    def point(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.most - (v * v).sum(1), 0))])

    def query(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.zeros(len(v))])

    def annulus(self, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance from a query of rows whose score is in the window."""
        near, far = (np.sqrt(np.maximum(norms + self.most - 2.0 * np.asarray(s, float), 0)) for s in (high, low))
        return near, far

    @property
    def slack(self) -> float:
        return 1e-5 * np.sqrt(self.most) + 1e-6


def possible(to_split: np.ndarray, near: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    """Of each query and child, whether its range to every split point meets what the annulus allows; low and high are by (split point, child)."""
    least = np.maximum(np.maximum(to_split - far[:, None], near[:, None] - to_split), 0) - slack
    most = to_split + far[:, None] + slack
    return ((most[:, :, None] >= low) & (least[:, :, None] <= high)).all(axis=1)


class Tree:
    """The rows of one block: ids in order, so that a smaller place is a smaller id."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, rows: np.ndarray, space: Space):
        self.v, self.labels, self.rows, self.space = vectors, labels, rows, space
        self.x = space.point(vectors)
        self.root = self._node(np.arange(len(rows)))

    def _node(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        some = at[np.linspace(0, len(at) - 1, 3 * FAN).astype(np.int64)]
        split = self.x[some[far_points(self.x[some], FAN)]]
        d = np.sqrt(_squares(self.x[at], split))
        child = d.argmin(1)
        sizes = np.bincount(child, minlength=len(split))
        if sizes.max() == len(at):  # nothing parts these
            return at
        used = np.flatnonzero(sizes)
        members = [child == j for j in used]
        low, high = (np.column_stack([f(d[m], axis=0) for m in members]) for f in (np.min, np.max))
        return split, low, high, [self._node(at[m]) for m in members]

    def search(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
        """Of each query the k best rows in its window: score * number of rows + rows after it, descending; _LOW where there are fewer."""
        n = len(self.rows)
        best, low = np.full((len(q), k), _LOW), low.copy()
        x, norms = self.space.query(q), (q * q).sum(1)
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, live = todo.pop()
            if isinstance(node, np.ndarray):
                score = (q[live] @ self.v[node].T).astype(np.int64)
                fits = ((self.labels[node] == label[live, None]) == same) & (self.rows[node] != own[live, None]) & (score >= low[live, None]) & (score <= high[live, None])
                key = np.concatenate([best[live], np.where(fits, score * n + (n - 1 - node), _LOW)], axis=1)
                best[live] = np.partition(key, -k, axis=1)[:, -k:]
                kth = best[live].min(axis=1)
                low[live] = np.maximum(low[live], np.where(kth > _LOW, kth // n, _LOW))
                continue
            split, near_, far_, children = node
            near, far = self.space.annulus(norms[live], low[live], high[live])
            alive = possible(np.sqrt(_squares(x[live], split)), near, far, near_, far_, self.space.slack)
            todo += [(child, live[alive[:, j]]) for j, child in enumerate(children) if alive[:, j].any()]
        return -np.sort(-best, axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of floats, which hold these integers exactly; short ones end with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


@dataclass
class Index:
    """Rows (row, id, label, v, cell, block), with split points and ranges, both of bounded size, on the driver."""

    rows: DataFrame
    dims: int
    space: Space
    splits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.parts) - self.parts


_ROW = "row long, id long, label long, v array<int>"


def integer_vector(c: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if a component is null, not finite or too large."""
    x = F.transform(c, lambda e: F.floor(e.cast("double") * scale))
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    within = F.forall(x, lambda e: F.abs(e) <= LARGEST)
    return F.when(fine, F.when(within, x.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}"))))


def build(points: DataFrame, splits: int = SPLITS, block: int = BLOCK) -> Index | None:
    """The index of points (id, label, v: integers); None without rows. Each row is indexed; split points are taken from CANDIDATES rows."""
    rows = saved(points.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, e: s + e.cast("long") * e)
    n, dims, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return None
    some = [r.v for r in rows.select("v").orderBy(F.xxhash64("v", "id"), "id", "row").limit(CANDIDATES).collect()]
    space = Space(float(most))
    x = space.point(np.array([list(v) + [0] * (dims - len(v)) for v in some], float).reshape(len(some), dims))
    splits_ = x[far_points(x, splits)]
    k = len(splits_)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _squares(space.point(_matrix(b.column("v"), dims)), splits_).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = np.full((k, k), np.inf), np.full((k, k), -np.inf), np.zeros(k, np.int64)
        for b in batches:
            d = np.sqrt(_squares(space.point(_matrix(b.column("v"), dims)), splits_))
            cell = b.column("cell").to_numpy()
            np.minimum.at(low.T, cell, d)
            np.maximum.at(high.T, cell, d)
            count += np.bincount(cell, minlength=k)
        for j in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, j)), pa.array(np.arange(k)), pa.array(low[:, j]), pa.array(high[:, j]), pa.array(np.full(k, count[j]))], ["cell", "split", "low", "high", "n"])

    rows = saved(rows.mapInArrow(cells, f"{_ROW}, cell long"))
    low, high, count = np.full((k, k), np.inf), np.full((k, k), -np.inf), np.zeros(k, np.int64)
    found = rows.select("v", "cell").mapInArrow(ranges, "cell long, split long, low double, high double, n long").groupBy("cell", "split").agg(F.min("low"), F.max("high"), F.sum("n"))
    for j, i, a, b, c in found.collect():  # splits * splits rows at most
        low[i, j], high[i, j], count[j] = a, b, c
    # Cells beyond a block are dealt by row over several; small tables get small blocks, so that tasks have about as many rows.
    parts = -(-count // min(block, max(LEAF, n // splits)))
    first = np.cumsum(parts) - parts
    cell = F.col("cell").cast("int") + 1
    of = F.element_at(F.array(*[F.lit(int(i)) for i in first]), cell) + F.pmod(F.xxhash64("row"), F.greatest(F.element_at(F.array(*[F.lit(int(i)) for i in parts]), cell), F.lit(1)))
    return Index(rows.withColumn("block", of.cast("long")), dims, space, splits_, low, high, parts)


_QUERY = f"{_ROW}, lows array<long>, highs array<long>"


def to_blocks(index: Index, queries: DataFrame) -> DataFrame:
    """queries (row, id, label, v, lows, highs), once for each block that can hold a row of one of their windows."""
    dims, space, splits, low, high, parts, first = index.dims, index.space, index.splits, index.low, index.high, index.parts, index.first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("v"), dims)
            lows, highs = b.column("lows"), b.column("highs")
            of = np.repeat(np.arange(len(q)), np.diff(lows.offsets.to_numpy()))
            norms = (q * q).sum(1)
            near, far = space.annulus(norms[of], lows.flatten().to_numpy(), highs.flatten().to_numpy())
            live = possible(np.sqrt(_squares(space.query(q), splits))[of], near, far, low, high, space.slack)
            cells = np.zeros((len(q), len(parts)), bool)
            np.logical_or.at(cells, of, live)
            for i in range(0, len(q), 64):  # a few queries at a time, as each may go to many blocks
                at, cell = np.nonzero(cells[i : i + 64])
                n = parts[cell]
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[cell], n)
                if len(block):
                    out = b.take(pa.array(np.repeat(at, n) + i))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(block)], [*out.schema.names, "block"])

    return queries.mapInArrow(run, f"{_QUERY}, block long")


_FOUND = "anchor long, anchor_id long, win int, row long, id long, score long"


def searched(index: Index, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor (row), anchor_id, win, row, id, score: of each query in each block (queries: row, id, label, v, lows, highs, block) and each of its windows the k best rows of its label, or of others.

    A task reads a block's rows, makes their tree, and lets the queries of the
    block, which come after them, pass through it.
    """
    dims, space = index.dims, index.space
    empty = F.array().cast("array<long>")
    queries = queries.withColumn("chunk", F.lit(0))
    # A block with very many queries is searched by several tasks, each with its rows.
    copies = queries.groupBy("block").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("copies"))
    rows = index.rows.join(copies, "block").select("row", "id", "label", "v", empty.alias("lows"), empty.alias("highs"), "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("chunk"))
    many = copies.filter("copies > 1")
    queries = queries.join(many, "block", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("row"), F.col("copies")).cast("int"), F.lit(0))).drop("copies")
    both = rows.withColumn("tag", F.lit(0)).unionByName(queries.withColumn("tag", F.lit(1)))
    tasks = max(int(index.parts.sum()), 1)
    dealt = both.repartitionByRange(tasks, "block", "chunk").sortWithinPartitions("block", "chunk", "tag", F.col("id").asc_nulls_last(), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree, ids = None, [], None, None

        def parts_of(b: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
            block, chunk, tag = (b.column(c).to_numpy() for c in ("block", "chunk", "tag"))
            new = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1]) | (tag[1:] != tag[:-1])))
            for i, j in zip(new, np.append(new[1:], len(block))):
                yield (block[i], chunk[i], tag[i]), b.slice(i, j - i)

        for whole in batches:
            if not whole.num_rows:
                continue
            for (block, chunk, tag), b in parts_of(whole):
                if key != (block, chunk):
                    key, held, tree = (block, chunk), [], None
                if not tag:
                    held.append(b)
                    continue
                if tree is None and held:
                    points = pa.Table.from_batches(held)
                    ids = points.column("id").combine_chunks()
                    tree = Tree(_matrix(points.column("v"), dims), points.column("label").to_numpy(), points.column("row").to_numpy(), space)
                if tree is None:
                    continue
                for i in range(0, b.num_rows, 128):
                    yield from answer(tree, ids, b.slice(i, 128))

    def answer(tree: Tree, ids: pa.Array, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lows, highs = b.column("lows"), b.column("highs")
        size = np.diff(lows.offsets.to_numpy())
        of = np.repeat(np.arange(b.num_rows), size)
        win = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        row, label = b.column("row").to_numpy(), b.column("label").to_numpy()
        best = tree.search(_matrix(b.column("v"), dims)[of], row[of], label[of], same, lows.flatten().to_numpy(), highs.flatten().to_numpy(), k)
        at, rank = np.nonzero(best > _LOW)
        n = len(tree.rows)
        score, place = np.divmod(best[at, rank], n)
        place = n - 1 - place
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[of[at]]), b.column("id").take(pa.array(of[at])), pa.array(win[at].astype(np.int32)), pa.array(tree.rows[place]), ids.take(pa.array(place)), pa.array(score)],
            ["anchor", "anchor_id", "win", "row", "id", "score"],
        )

    return dealt.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "win").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(points: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of points (id, label, v: array of int).

    An anchor's positives are its best other rows of the same label. For each
    of them the best rows of other labels are taken whose score is between
    low (a fraction) of the positive's score and that score. Equal scores go by
    id, a null id last. Rows with a null label or vector take no part; a short
    vector ends with zeros; repeated rows and ids are rows of their own. Extra
    columns are ignored, an empty table gives an empty result.
    """
    spark = points.sparkSession
    fields = ["anchor_id long", "positive_id long", "rank int", "negative_id long", "positive_score long", "negative_score long"]
    index = build(pick(points, "id", "label", "v").filter("label IS NOT NULL AND v IS NOT NULL"))
    if index is None:
        return spark.createDataFrame([], ", ".join(fields))
    ask = index.rows.filter(anchors).select("row", "id", "label", "v", "block")
    everything = ask.withColumns({"lows": F.array(F.lit(_LOW)), "highs": F.array(F.lit(_HIGH))})
    # The anchor's own block first: the least score among its best rows there bounds the search of the others.
    home = saved(_best(searched(index, everything, True, positives), positives))
    bound = home.filter(F.col("rank") == positives).select(F.col("anchor").alias("row"), F.col("score").alias("bound"))
    wide = ask.withColumnRenamed("block", "home").join(bound, "row", "left")
    wide = saved(wide.withColumns({"lows": F.array(F.coalesce("bound", F.lit(_LOW))), "highs": F.array(F.lit(_HIGH))}))
    others = to_blocks(index, wide.select("row", "id", "label", "v", "lows", "highs")).join(wide.select("row", "home"), "row").filter("block <> home").drop("home")
    found = saved(_best(home.drop("rank").unionByName(searched(index, saved(others), True, positives)), positives))
    num, den = low
    # Windows by positive: from the least whole score that is low enough to the positive's own.
    least = F.expr(f"CAST((score * {num} - pmod(score * {num}, {den})) div {den} AS BIGINT)") + F.when(F.pmod(F.col("score") * num, F.lit(den)) > 0, 1).otherwise(0)
    windows = found.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), "score", least.alias("least")))).alias("w"))
    windows = windows.withColumn("w", F.filter("w", lambda w: w["least"] <= w["score"])).filter(F.size("w") > 0)
    asked = saved(ask.drop("block").join(windows, "row").select("row", "id", "label", "v", F.col("w.least").alias("lows"), F.col("w.score").alias("highs"), "w"))
    negative = _best(searched(index, saved(to_blocks(index, asked.drop("w"))), False, negatives), negatives)
    # The window's place tells the positive.
    named = asked.select(F.col("row").alias("anchor"), F.posexplode("w").alias("win", "p")).select("anchor", "win", "p.positive_id", F.col("p.score").alias("positive_score"))
    out = negative.join(named, ["anchor", "win"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def points_of(embeddings: DataFrame) -> DataFrame:
    """id, label, v of embeddings (vec_id, label, embedding) as op12 takes them."""
    rows = pick(embeddings, "vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").alias("id"), label.alias("label"), integer_vector(F.col("embedding")).alias("v"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(points_of(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


SQL = """WITH p AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.r, a.id AS anchor_id, b.id, b.label = a.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM p a JOIN p b ON a.r <> b.r WHERE a.id % 100 = 0),
pos AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS k FROM pairs WHERE same QUALIFY k <= 5)
SELECT pos.anchor_id, positive_id, (row_number() OVER (PARTITION BY pos.r, k ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pairs n ON n.r = pos.r AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""

QUERIES = {"op12_hard_negatives": op12}
ORACLE_SQL = {"op12_hard_negatives": SQL}
