"""Alignment and differences of sentence pairs, and their mining."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T

_OPS = Y.ArrayType(Y.StructType([Y.StructField("op", Y.StringType()), *(Y.StructField(n, Y.IntegerType()) for n in ("i1", "i2", "j1", "j2"))]))


#: Pairs of tokens of a part that are compared one by one; below it arrays cost more than they save.
SMALL = 8192


def common_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """i, j, size of the common blocks of two arrays of codes, in order: the longest (of equal ones the first in a, then in b), and so on to its left and its right.

    Runs of 1, 2, 4 ... tokens are numbered over both arrays, so any two runs of
    one length are compared by two numbers. In a part all blocks of its greatest
    length are found in one pass; what they leave has shorter ones only. Small
    parts are compared token by token.
    """
    la, lb = a.tolist(), b.tolist()

    def small(i0: int, i1: int, j0: int, j1: int) -> tuple[int, int, int]:
        best, at, ended, where = 0, (0, 0), {}, {}
        for j in range(j0, j1):
            where.setdefault(lb[j], []).append(j)
        for i in range(i0, i1):
            here = {}
            for j in where.get(la[i], ()):
                here[j] = n = ended.get(j - 1, 0) + 1
                if n > best:
                    best, at = n, (i + 1 - n, j + 1 - n)
            ended = here
        return *at, best

    codes = np.concatenate([a, b]).astype(np.int64)
    ranks: list[np.ndarray] = []

    def runs(lo: int, hi: int, size: int) -> np.ndarray:
        """A number for each run of `size` tokens inside codes[lo:hi]."""
        k = size.bit_length() - 1
        while len(ranks) <= k:
            step = 1 << len(ranks) >> 1
            pairs = ranks[-1][:-step] * len(codes) + ranks[-1][step:] if step else codes
            ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        n = hi - lo - size + 1
        return ranks[k][lo : lo + n] * len(codes) + ranks[k][lo + size - (1 << k) :][:n]

    found, parts = [], [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while parts:
        i0, i1, j0, j1, most = parts.pop()
        if (i1 - i0) * (j1 - j0) <= SMALL:
            i, j, size = small(i0, i1, j0, j1)
            if size:
                found.append((i, j, size))
                parts += [(i0, i, j0, j, size), (i + size, i1, j + size, j1, size)]
            continue
        most = min(most, i1 - i0, j1 - j0)
        sides = lambda size: (runs(i0, i1, size), runs(len(a) + j0, len(a) + j1, size))  # noqa: B023, E731
        least, size = 0, min(most, 1)
        while least < most:  # the greatest length of a common run: doubled first, as most are short, then halved in
            if np.isin(*sides(size)).any():
                least, size = size, min(2 * size, most) if most - size > size else (size + most + 1) // 2
            else:
                most, size = size - 1, (least + size) // 2
            size = max(size, least + 1)
        if not least:
            continue
        x, y = sides(least)
        order = np.argsort(y, kind="stable")
        ordered = y[order]
        at = np.flatnonzero(np.isin(x, y))
        first, last = np.searchsorted(ordered, x[at]), np.searchsorted(ordered, x[at], "right")
        i, j = 0, 0  # where the next block may begin
        for k, lo, hi in zip(at.tolist(), first.tolist(), last.tolist()):
            if k < i:
                continue
            lo += int(np.searchsorted(order[lo:hi], j))
            if lo < hi:
                to = int(order[lo])
                found.append((i0 + k, j0 + to, least))
                parts.append((i0 + i, i0 + k, j0 + j, j0 + to, least - 1))
                i, j = k + least, to + least
        parts.append((i0 + i, i1, j0 + j, j1, least - 1))
    return sorted(found)


def _gaps(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """i1, i2, j1, j2 of what lies between common blocks."""
    out, i, j = [], 0, 0
    for x, y, size in [*common_blocks(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append((i, x, j, y))
        i, j = x + size, y + size
    return out


@F.arrow_udf(_OPS)
def _opcodes(a: pa.Array, b: pa.Array) -> pa.Array:
    """Blocks are sought inside of what other blocks leave, which no expression says; tokens are numbered once for a batch, and never become Python's."""
    ends = lambda x: np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    asked = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
    at, to = ends(a), ends(b)
    encoded = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode(null_encoding="encode")
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    left, right = codes[: at[-1]], codes[at[-1] :]
    gaps = [_gaps(left[at[k] : at[k + 1]], right[to[k] : to[k + 1]]) if asked[k] else None for k in range(len(a))]
    flat = np.array([g for row in gaps if row for g in row], dtype=np.int32).reshape(-1, 4)
    gone, new = flat[:, 0] < flat[:, 1], flat[:, 2] < flat[:, 3]
    # Replaced, deleted from a, or inserted from b.
    op = pa.DictionaryArray.from_arrays(pa.array(np.where(gone & new, 0, np.where(gone, 1, 2)).astype(np.int32)), ["replace", "delete", "insert"]).cast(pa.string())
    bounds = pa.array([*np.cumsum([0, *[len(row or ()) for row in gaps]])[:-1], len(flat)], pa.int32(), mask=np.append(~asked, False))
    return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([op, *map(pa.array, flat.T)], ["op", "i1", "i2", "j1", "j2"]))


def diff_ops(pairs: DataFrame, a: str = "ta", b: str = "tb") -> DataFrame:
    """pairs (token arrays a, b) with ops: where they differ, and ratio, 2 * equal / all; both null if a side is.

    Equal pairs, and those of which a side has no word of the other, are done by
    expressions; the others' blocks are sought in Arrow batches.
    """
    x, y = F.col(a), F.col(b)
    none = F.expr("cast(array() as array<struct<op:string,i1:int,i2:int,j1:int,j2:int>>)")
    whole = F.when(F.size(x) == 0, "insert").when(F.size(y) == 0, "delete").otherwise("replace")
    one = F.array(F.struct(whole.alias("op"), F.lit(0).alias("i1"), F.size(x).alias("i2"), F.lit(0).alias("j1"), F.size(y).alias("j2")))
    apart = ~F.arrays_overlap(x, y)
    sought = ~((x == y) | apart)
    ops = F.when(x == y, none).when(apart, one).otherwise(_opcodes(F.when(sought, x), F.when(sought, y)))
    return pairs.withColumn("ops", ops).withColumn("ratio", F.when(F.col("ops").isNotNull(), _ratio(F.col("ops"), F.size(a), F.size(b))))


def _ratio(ops: Column, na: Column, nb: Column) -> Column:
    gone = F.aggregate(ops, F.lit(0), lambda n, o: n + (o["i2"] - o["i1"]) + (o["j2"] - o["j1"]))
    return F.when(na + nb > 0, (na + nb - gone) / (na + nb)).otherwise(F.lit(1.0))


def positional_ops(pairs: DataFrame, a: str = "ta", b: str = "tb") -> DataFrame:
    """For pairs of equal length: i, from, to of every place at which they differ."""
    same = pairs.filter(F.size(a) == F.size(b))
    zipped = F.zip_with(a, b, lambda x, y: F.struct(x.alias("from"), y.alias("to")))
    rest = [c for c in pairs.columns if c not in (a, b)]
    return same.select(*rest, F.posexplode(zipped).alias("i", "p")).select(*rest, "i", "p.from", "p.to").filter(F.col("from") != F.col("to"))


def substitutions(diffed: DataFrame, most: int = 4, a: str = "ta", b: str = "tb") -> DataFrame:
    """Rows of replaced spans with words on both sides, of `most` tokens or fewer: from, to, isolated (whether nothing else differs), and what the row has.

    Spans are cut inside the array, so the tokens of a row don't go along with each of them.
    """
    span = lambda t, x, y: F.array_join(F.slice(F.col(t), x + 1, y - x), " ")
    short = F.filter("ops", lambda o: (o["op"] == "replace") & (o["i2"] - o["i1"] <= most) & (o["j2"] - o["j1"] <= most))
    spans = F.transform(short, lambda o: F.struct(span(a, o["i1"], o["i2"]).alias("from"), span(b, o["j1"], o["j2"]).alias("to")))
    rest = [c for c in diffed.columns if c not in ("from", "to", "isolated")]
    o = diffed.withColumn("isolated", F.size("ops") == 1).select(*rest, "isolated", F.explode(spans).alias("_o"))
    return o.select(*rest, "_o.from", "_o.to", "isolated")


def mined(subs: DataFrame, known: DataFrame, rules: DataFrame) -> DataFrame:
    """from, to, n, mean_ratio, isolated and kind: known (pairs src, dst), rule (suffixes cut, put, number) or new."""
    isolated = F.col("isolated") if "isolated" in subs.columns else F.size("ops") == 1
    g = subs.groupBy("from", "to").agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.round(F.avg(isolated.cast("int")), 6).alias("isolated"))
    # A rule explains a pair if both sides without their suffixes are the same stem.
    stem = lambda w, s: F.substring(w, F.lit(1), F.length(w) - F.length(s))
    fits = F.col("from").endswith(F.col("cut")) & F.col("to").endswith(F.col("put")) & (stem("from", "cut") == stem("to", "put"))
    # Rules come to the pairs where these are, as a second table of pairs would be made of the text anew.
    own = ["n", "mean_ratio", "isolated"]
    out = g.join(rules, fits, "left").groupBy("from", "to").agg(*[F.max(c).alias(c) for c in own], F.min("number").alias("rule"))
    out = out.join(known.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(True).alias("known")), ["from", "to"], "left")
    return out.withColumn("kind", F.when(F.col("known"), "known").when(F.col("rule").isNotNull(), "rule").otherwise("new")).drop("known")


def structural(ops: Column, most: int = 2) -> Column:
    """Only one-to-one replacements of `most` tokens or fewer."""
    return F.forall(ops, lambda o: (o["op"] == "replace") & (o["i2"] - o["i1"] == o["j2"] - o["j1"]) & (o["i2"] - o["i1"] <= most))


def unaccented(c: Column) -> Column:
    return F.translate(c, "àáâäèéêëìíîïòóôöùúûüçñ", "aaaaeeeeiiiioooouuuucn")


def explained(positional: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """key, strict: whether every difference is a lexicon pair (src, dst) or one of accents."""
    j = positional.join(lexicon.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(True).alias("known")).distinct(), ["from", "to"], "left")
    ok = F.coalesce("known", F.lit(False)) | (unaccented(F.col("from")) == unaccented(F.col("to")))
    return j.groupBy(key).agg(F.every(ok).alias("strict"))


def align_by_position(a: DataFrame, b: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, par_no, sent_no, text_a, text_b of documents (doc, par_no, sentences) with as many paragraphs on both sides.

    Inside a paragraph sentences are paired if their numbers agree; else the whole paragraph is one unit.
    """
    n = lambda df, name: df.groupBy(doc).agg(F.count("*").alias(name))
    even = n(a, "na").join(n(b, "nb"), doc).filter("na = nb").select(doc)
    j = a.join(b.withColumnRenamed("sentences", "other"), [doc, "par_no"]).join(even, doc, "left_semi")
    units = F.when(F.size("sentences") == F.size("other"), F.arrays_zip(F.col("sentences").alias("text_a"), F.col("other").alias("text_b"))).otherwise(
        F.array(F.struct(F.array_join("sentences", " ").alias("text_a"), F.array_join("other", " ").alias("text_b")))
    )
    return j.select(doc, "par_no", F.posexplode(units).alias("sent_no", "u")).select(doc, "par_no", "sent_no", "u.text_a", "u.text_b")


def align_by_content(a: DataFrame, b: DataFrame, doc: str = "doc", least: float = 0.2) -> DataFrame:
    """doc, i, j, similarity: mutual best sentences (doc, no, text), wherever in the document they are.

    Similarity is the Jaccard index of words, `least` or more. Sentences of the
    same words are one set; best partners are sought among sets, all that share a
    word, and a set that the other side has too is its own best partner. The
    k-th sentence of a set goes with the k-th of the other; of several sets that
    are equally good, that nearest the diagonal is taken, then the smaller number.
    """

    # Sentences are shuffled once, to their document; sets, what they share and who is best are grouped there, so neither words nor pairs of sets are shuffled.
    side = lambda df, k: df.select(doc, F.lit(k).alias("side"), F.col("no").cast("long").alias("no"), F.array_join(F.array_sort(F.array_distinct(T.pair_tokens(F.col("text")))), " ").alias("words"))
    rows = side(a, 0).unionByName(side(b, 1)).filter(F.col(doc).isNotNull()).repartition(doc)
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("no"))))
    sets = rows.groupBy(doc, "words").agg(of(0).alias("la"), of(1).alias("lb"))
    all_ = lambda c: F.sum(F.size(c)).over(Window.partitionBy(doc))
    sets = sets.withColumns({"n": all_("la"), "m": all_("lb"), "a": F.get("la", F.lit(0)), "b": F.get("lb", F.lit(0))})
    # The numbers keep filters for words behind the grouping, else sentences would be dealt for each use anew.
    words = F.when(F.size("la") + F.size("lb") > 0, F.col("words"))
    sets = sets.filter(words != "").withColumn("shared", F.col("a").isNotNull() & F.col("b").isNotNull())
    # Sets that only one side has; one of theirs may be nearest to a set that both have, which is then no mutual pair.
    each = sets.select(doc, "a", "b", "shared", F.split(words, " ").alias("w")).select(doc, "a", "b", "shared", F.size("w").alias("size"), F.explode("w").alias("w"))
    listed = lambda s: F.collect_list(F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("set"), "size", "shared")))
    met = each.groupBy(doc, "w").agg(listed("a").alias("x"), listed("b").alias("y")).select(doc, F.explode("x").alias("x"), "y")
    met = met.select(doc, "x", F.explode(F.when(F.col("x.shared"), F.filter("y", lambda y: ~y["shared"])).otherwise(F.col("y"))).alias("y"))
    one = lambda c: F.max(c).alias(c.replace(".", "_"))
    near = met.groupBy(doc, F.col("x.set").alias("a"), F.col("y.set").alias("b")).agg(F.count("*").alias("both"), *map(one, ["x.size", "y.size", "x.shared", "y.shared"]))
    near = near.withColumn("similarity", F.col("both") / (F.col("x_size") + F.col("y_size") - F.col("both"))).filter(F.col("similarity") >= least)
    top = lambda side: F.max("similarity").over(Window.partitionBy(doc, side))
    near = near.withColumn("ta", top("a")).withColumn("tb", top("b")).filter("similarity = ta AND similarity = tb AND NOT x_shared AND NOT y_shared").select(doc, "a", "b", "similarity")
    near = near.join(sets.select(doc, "a", "la", "n", "m"), [doc, "a"]).join(sets.select(doc, "b", "lb"), [doc, "b"])
    found = near.select(doc, "la", "lb", "similarity", "n", "m").unionByName(sets.filter("shared").select(doc, "la", "lb", F.lit(1.0).alias("similarity"), "n", "m"))
    matched = F.slice(F.arrays_zip(F.col("la").alias("i"), F.col("lb").alias("j")), F.lit(1), F.least(F.size("la"), F.size("lb")))
    rows = found.select(doc, "similarity", "n", "m", F.explode(matched).alias("p")).select(doc, "p.i", "p.j", "similarity", "n", "m")
    off = F.abs(F.col("j") - F.floor(F.col("i") * F.col("m") / F.col("n")))
    best = lambda by, other: F.row_number().over(Window.partitionBy(doc, by).orderBy(off, other))
    return rows.withColumn("ra", best("i", "j")).withColumn("rb", best("j", "i")).filter("ra = 1 and rb = 1").select(doc, "i", "j", "similarity")


def confirmed(proposals: DataFrame, source_grams: DataFrame, target_grams: DataFrame, key: str = "id") -> DataFrame:
    """Proposed changes (key, form, put) whose new form is in the target and not in the source."""
    put = F.col("gram") == F.col("put")
    inside = proposals.join(target_grams.withColumnRenamed(key, "k"), (F.col(key) == F.col("k")) & put, "left_semi")
    return inside.join(source_grams.withColumnRenamed(key, "k"), (F.col(key) == F.col("k")) & put, "left_anti")


def phenomena(pairs: DataFrame, lexicon: DataFrame, key: str = "id") -> DataFrame:
    """key, label of lexicon pairs (src, dst, label) whose src is in the source only and whose dst is in the target (1- to 3-grams)."""
    # Where both sides are one text nothing is in the source only.
    apart = pairs.filter(F.col("a") != F.col("b"))
    grams = lambda c: apart.select(key, F.explode(F.array_distinct(T.ngrams(T.tokens(F.col(c)), 3))).alias("gram"))
    hit = grams("a").join(lexicon, F.col("gram") == F.col("src")).select(key, "src", "dst", "label")
    # Of the target only grams that the lexicon has are shuffled.
    dst = grams("b").join(lexicon.select(F.explode(F.array("src", "dst")).alias("gram")), "gram", "left_semi")
    hit = hit.join(dst.select(key, F.col("gram").alias("dst")), [key, "dst"], "left_semi")
    return hit.join(dst.select(key, F.col("gram").alias("src")), [key, "src"], "left_anti").select(key, "label").distinct()
