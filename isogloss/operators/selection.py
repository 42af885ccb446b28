"""Keep-first, caps, splits, samples, leaks and near repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*order, F.struct(*rest).alias("row"))
    return df.groupBy(*keys).agg(F.min(packed).alias("m")).select(*keys, *[F.col(f"m.row.{c}").alias(c) for c in rest]).select(*df.columns)


def at_most(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """At most k rows of each group, the first in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def seeded(seed: str, *cols: str) -> Column:
    """A shuffle order that every engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def bernoulli(key: Column, share: float) -> Column:
    """Whether a key is in a sample of this share; by the key alone."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(1_000_000)) < int(share * 1_000_000)


def md5_mod10(text: Column) -> Column:
    """The 128-bit md5 modulo 10, exactly: the high half counts 2^64 mod 10 = 6 times."""
    half = lambda a: F.conv(F.substring(F.md5(text), a, 16), 16, 10).cast("decimal(20,0)") % 10
    return ((half(1) * 6 + half(17)) % 10).cast("int")


def split_by_group(rows: DataFrame, group: str, seed: str, test: float, dev: float) -> DataFrame:
    """rows with split: whole groups in shuffled order fill test, then dev, and the rest trains."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    order = sizes.withColumn("h", seeded(seed, group))
    every = Window.partitionBy()
    # Slices of the shuffle first, then inside each, so that no task orders all groups.
    order = order.withColumn("slice", F.substring("h", 1, 2))
    slices = order.groupBy("slice").agg(F.sum("n").alias("slice_n"))
    slices = slices.select("slice", F.coalesce(F.sum("slice_n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("slice_n").over(every).alias("total"))
    inside = Window.partitionBy("slice").orderBy("h", group).rowsBetween(Window.unboundedPreceding, -1)
    at = order.join(slices, "slice").withColumn("c", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    in_test = F.col("c") < F.floor(F.col("total") * test)
    tested = at.agg(F.coalesce(F.sum(F.when(in_test, F.col("n"))), F.lit(0)).alias("n_test"))
    label = F.when(in_test, "test").when(F.col("c") - F.col("n_test") < F.floor(F.col("total") * dev), "dev").otherwise("train")
    return rows.join(at.crossJoin(tested).select(group, label.alias("split")), group)


def balanced_split(rows: DataFrame, label: str, key: str, seed: str, n_valid: int) -> DataFrame:
    """rows with split: n_valid of each class to validation, then as many of each class to train as the smallest has left.

    A row's place in the shuffle of its class is its place in a slice of the
    shuffle and the sizes of the slices before, so no task orders a class.
    """
    order = rows.withColumn("_h", seeded(seed, key)).withColumn("_s", F.substring("_h", 1, 3))
    sizes = order.groupBy(label, "_s").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(label, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    least = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    inside = F.row_number().over(Window.partitionBy(label, "_s").orderBy("_h", key))
    ranked = order.withColumn("_i", inside).join(sizes.withColumnsRenamed({label: "_l", "_s": "_t"}), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_s") == F.col("_t"))).crossJoin(least).withColumn("_r", F.col("_before") + F.col("_i"))
    return ranked.filter(F.col("_r") <= F.col("_least")).withColumn("split", F.when(F.col("_r") <= n_valid, "valid").otherwise("train")).select(*rows.columns, "split")


def near_evaluation(rows: DataFrame, evaluation: DataFrame, key: str, words: str, at_least: float = 0.6, least: int = 4) -> DataFrame:
    """key, item, jaccard of all rows near an evaluation text; both sides have word sets (`words`) of `least` words or more.

    Two sets that reach the index share a word among the rarest n - ceil(at_least
    * n) + 1 of an evaluation text of n words, and neither is smaller than
    at_least times the other, so only such are compared and no pair is lost.
    """
    items = evaluation.filter(F.size(words) >= least).select("item", F.col(words).alias("b"))
    prefix = _rarest(items, at_least)
    left = rows.filter(F.size(words) >= least).select(key, F.col(words).alias("a"))
    # The set goes along with its words, so that rows are made once; all but those that meet an item are dropped at the join.
    met = left.select(key, "a", F.explode("a").alias("word")).join(prefix, "word").filter((F.size("a") >= at_least * F.col("n")) & (F.col("n") >= at_least * F.size("a")))
    cand = met.groupBy(key, "item").agg(F.first("a").alias("a"))
    return cand.join(items, "item").withColumn("jaccard", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).filter(F.col("jaccard") >= at_least).select(key, "item", "jaccard")


def _rarest(items: DataFrame, at_least: float) -> DataFrame:
    """item, n, word: the rarest words (among items) of each set b of n words that any set that near has one of."""
    w = items.select("item", F.size("b").alias("n"), F.explode("b").alias("word"))
    ranked = w.join(w.groupBy("word").agg(F.count("*").alias("f")), "word").withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("f", "word")))
    return ranked.filter(F.col("r") <= F.col("n") - F.ceil(at_least * F.col("n") - 1e-9) + 1).select("item", "n", "word")


def zero_filled(forms: DataFrame, counts: DataFrame) -> DataFrame:
    """form, n: counts of a fixed list, 0 where there is none."""
    return forms.join(counts, "form", "left").select("form", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def coverage(pool: DataFrame, key: str, labels: str, n: int, quota: int, pairs: str | None = None, per_pair: int = 3, caps: dict[str, int] | None = None) -> DataFrame:
    """n rows of a pool that cover labels up to a quota, chosen in rounds.

    A row scores 10 / sqrt(frequency) for each of its labels that is still below
    quota, and one for each of its pairs (an array column, if given) that nothing
    chosen has. In each round the rows of largest score (ties by key) fill half
    of what each label lacks, so that a quota takes some log2(quota) rounds;
    rounds go on until no label lacks anything, no row is left, or n are chosen.
    Once none lacks, and there are pairs, scores alone decide. A row goes when all of its pairs were chosen per_pair times, or when
    one of its caps (column: most rows of a value; null is a value) is reached.
    Within a round, rows count against caps in the order of their scores.
    """
    caps = caps or {}
    pool = cut(pool.select(key, F.array_distinct(labels).alias(labels), *([F.array_distinct(pairs).alias(pairs)] if pairs else []), *caps))
    freq = pool.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("freq"))
    chosen = pool.limit(0)
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key))
    while True:  # a round that chooses nothing is the last: its best row would be within all caps
        left = n - chosen.count()
        if left <= 0:
            break
        have = chosen.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("have"))
        gaps = freq.join(have, "label", "left").select("label", "freq", F.greatest(F.lit(0), F.least(F.lit(quota), F.col("freq")) - F.coalesce("have", F.lit(0))).alias("gap")).filter("gap > 0")
        rest = pool.join(chosen.select(key), key, "left_anti")
        for c, most in caps.items():
            used = chosen.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
            rest = rest.join(used, rest[c].eqNullSafe(used["_v"]), "left").withColumn(f"_room_{c}", most - F.coalesce("_n", F.lit(0))).filter(F.col(f"_room_{c}") > 0).drop("_v", "_n")
        lacking = rest.select(key, F.explode(labels).alias("label")).join(gaps, "label")
        score = lacking.groupBy(key).agg(F.sum(10 / F.sqrt("freq")).alias("_lacks"))
        if pairs is None:
            scored = rest.join(score, key).withColumn("score", F.round("_lacks", 9))
        else:
            used = chosen.select(F.explode(pairs).alias("_pair")).groupBy("_pair").agg(F.count("*").alias("_n"))
            each = rest.select(key, F.explode(pairs).alias("_pair")).join(used, "_pair", "left").groupBy(key)
            each = each.agg(F.count_if(F.col("_n").isNull()).alias("_new"), F.count_if(F.coalesce("_n", F.lit(0)) < per_pair).alias("_open")).filter("_open > 0")
            scored = rest.join(each, key).join(score, key, "left").withColumn("score", F.round(F.coalesce("_lacks", F.lit(0.0)) + F.col("_new"), 9))
        scored = cut(scored)
        # The first filter is a constant, so that no task keeps more than these rows of a label.
        ranked = scored.select(key, "score", F.explode(labels).alias("label")).join(gaps, "label").withColumn("_r", first("label")).filter(F.col("_r") <= (quota + 1) // 2)
        best = cut(scored.join(ranked.filter(F.col("_r") <= F.ceil(F.col("gap") / 2)).select(key).distinct(), key, "left_semi"))
        fresh = best if pairs is None or not best.isEmpty() else scored
        fresh = fresh.orderBy(F.desc("score"), key).limit(left)
        for c in caps:
            fresh = fresh.withColumn("_r", first(c)).filter(F.col("_r") <= F.col(f"_room_{c}"))
        if pairs is not None:
            ahead = fresh.select(key, "score", F.explode(pairs).alias("_pair")).withColumn("_r", first("_pair")).join(used, "_pair", "left")
            fresh = fresh.join(ahead.filter(F.coalesce("_n", F.lit(0)) + F.col("_r") <= per_pair).select(key).distinct(), key, "left_semi")
        fresh = cut(fresh.select(*pool.columns))
        if fresh.isEmpty():
            break
        chosen = cut(chosen.union(fresh))
    return chosen


def near_evaluation_exact(rows: DataFrame, evaluation: DataFrame, key: str, words: str, at_least: float = 0.6, letters: int = 3) -> DataFrame:
    """As near_evaluation, over words of `letters` letters or more and sets of any size."""
    long_ = lambda df, name: df.select(name, F.filter(words, lambda w: F.length(w) >= letters).alias(words))
    return near_evaluation(long_(rows, key), long_(evaluation, "item"), key, words, at_least, 1)
