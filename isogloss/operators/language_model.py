"""Count-based language models and classifiers of ambiguous words, as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import running_sums

START, END = "<s>", "</s>"


def marked_words(lm_text: Column) -> Column:
    return F.concat(F.array(F.lit(START)), F.filter(F.split(lm_text, " "), lambda w: w != ""), F.array(F.lit(END)))


#: The words of a gram but the first. A gram that is padded to a number of words begins with blanks, one for each word that it lacks.
_SUFFIX = "substring(gram, locate(' ', gram) + 1, length(gram))"


def _padded(words: Column, lo: Column, hi: Column | None, order: int) -> Column:
    """The `order` words that end at each place of words from lo to hi (from 1; None: the last), padded."""
    at = lambda w: F.transform(F.sequence(lo, F.size(w) if hi is None else hi), lambda i: F.coalesce(F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), order - i).cast("int")), F.array_join(F.slice(w, F.greatest(F.lit(1), i - order + 1), F.least(i, F.lit(order))), " ")), F.lit("")))
    # The words are bound to a variable, else they would be made anew for every place. Grams are never null and say so: filters for nulls would make shuffles differ that are the same.
    return F.transform(F.array(words), at)[0]


def _levels(sentences: DataFrame, text: str, order: int, *by: str) -> dict[int, DataFrame]:
    """By number of words: by, gram, count, before (the different words before it, but for the longest) and whole (false for a padded gram).

    Only the longest gram that ends at each word is made of the text; shorter
    ones are sums over what ends in them, each a table made from the one before.
    """
    words = marked_words(F.col(text))
    grams = sentences.select(*by, F.explode(_padded(words, F.lit(1), None, order)).alias("gram"))
    counts = [F.count("*").alias("count"), F.count("*").alias("before")]
    # The count keeps filters by it behind the sums: what is pushed below them makes shuffles of all levels differ that are the same.
    whole = (~F.col("gram").startswith(" ")) | (F.col("count") < 0)
    out = {}
    for n in range(order, 0, -1):
        out[n] = grams.groupBy(*by, "gram").agg(*counts).withColumn("whole", whole)
        # All columns are asked for, here and by those who read a level, so its shuffle is the same one and is reused.
        grams = out[n].filter("before IS NOT NULL").select(*by, F.expr(_SUFFIX).alias("gram"), "count", F.col("whole").cast("int").alias("whole"))
        counts = [F.sum("count").alias("count"), F.sum("whole").alias("before")]
    return out


def _counted(sentences: DataFrame, text: str, order: int, *by: str) -> DataFrame:
    out = None
    for n, level in _levels(sentences, text, order, *by).items():
        part = level.filter("whole AND before IS NOT NULL").select(*by, F.lit(n).alias("n"), "gram", "count")
        out = part if out is None else out.unionByName(part)
    return out


def ngram_counts(sentences: DataFrame, text: str, order: int, *by: str) -> DataFrame:
    """by, n, gram, count of n-grams with sentence marks; single ones of order two and more are pruned."""
    return _counted(sentences, text, order, *by).filter("n = 1 or count > 1").select(*by, "n", "gram", "count")


def word_counts(sentences: DataFrame, text: str, order: int, *by: str) -> DataFrame:
    """by, gram, count of single words and marks, whose shuffles are those of a model of that order of the same sentences."""
    return _levels(sentences, text, order, *by)[1].filter("count > 0 AND before IS NOT NULL AND whole IS NOT NULL").select(*by, "gram", "count")


def kneser_ney(sentences: DataFrame, text: str, order: int, by: tuple[str, ...] = ()) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Interpolated Kneser-Ney model with three discounts an order, for each `by`, which may not be null.

    By number of words: grams (by, gram, c: its count less the discount) and
    histories (by, hist, s, gamma, size): what the counts after a history sum to,
    and the weight of the next lower order after it; of order one, of all words
    alike (size of them, one unknown). Grams below the highest order that don't
    begin a sentence count the different words before them. Grams of two words
    and more that occur once are pruned, and what they had goes to gamma. A
    discount that small tables don't settle, or that is no more than 0 by them,
    is the single one, or a half, so no word has a probability of 0.
    """
    levels = _levels(sentences, text, order, *by)
    return {n: _discounted(level, n, order, by, levels.get(n - 1)) for n, level in levels.items()}


def _discounts(t: str) -> dict[int, Column]:
    """The discounts of grams that count one, two, and three or more, by how many count one to four (columns t1 to t4)."""
    t1, t2 = F.col(f"{t}1"), F.col(f"{t}2")
    single = F.when(t1 > 0, t1 / (t1 + 2 * t2)).otherwise(0.5)

    def discount(k: int) -> Column:
        settled = (t1 > 0) & (t2 > 0) & (F.col(f"{t}{k}") > 0) & (F.col(f"{t}{k + 1}") > 0)
        value = k - (k + 1) * single * F.col(f"{t}{k + 1}") / F.col(f"{t}{k}")
        return F.when(settled & (value > 0), value).otherwise(single)

    return {k: discount(k) for k in (1, 2, 3)}


def _discounted(level: DataFrame, n: int, order: int, by: tuple[str, ...], shorter: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    hist = F.expr(f"substring_index(gram, ' ', {n - 1})") if n > 1 else F.lit("")
    own = F.lit(n == order) | F.col("gram").startswith(f"{START} ")
    adjusted = level.filter("whole AND before IS NOT NULL").select(*by, "gram", hist.alias("hist"), ((F.col("count") > 1) | F.lit(n == 1)).alias("kept"), F.when(own, F.col("count")).otherwise(F.col("before")).alias("c"))
    if n == 1:
        # The count keeps this filter behind the sums: what is pushed below them makes shuffles of all levels differ that are the same.
        adjusted = adjusted.filter((F.col("gram") != START) | (F.col("c") < 0))
    t = adjusted.groupBy(*by).agg(*[F.count_if(F.col("c") == k).alias(f"t{k}") for k in (1, 2, 3, 4)])
    # A row for each model.
    t = F.broadcast(t.select(*by, *[d.alias(f"d{k}") for k, d in _discounts("t").items()]))
    with_t = lambda df: df.join(t, list(by)) if by else df.crossJoin(t)
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    grams = with_t(adjusted.filter("kept")).select(*by, "gram", (F.col("c") - d).alias("c"))
    kept = lambda cond: F.count_if(F.col("kept") & cond)
    used = [F.sum(F.when(F.col("kept"), F.col("c")).otherwise(0)).alias("used"), kept(F.col("c") == 1).alias("k1"), kept(F.col("c") == 2).alias("k2"), kept(F.col("c") > 2).alias("k3")]
    if n == order and shorter is not None:
        # A history is followed by a word wherever it stands, but for one that ends a sentence: its sum is its own count, and of its grams only those that are kept go on.
        all_ = shorter.filter(f"whole AND before IS NOT NULL AND (NOT endswith(' ' || gram, ' {END}') OR count < 0)").select(*by, F.col("gram").alias("hist"), F.col("count").alias("s"))
        sums = all_.join(adjusted.filter("kept").groupBy(*by, "hist").agg(*used), [*by, "hist"], "left").fillna(0, ["used", "k1", "k2", "k3"])
    else:
        sums = adjusted.groupBy(*by, "hist").agg(F.sum("c").alias("s"), F.count("*").alias("kinds"), *used)
    used = F.col("used") - F.col("k1") * F.col("d1") - F.col("k2") * F.col("d2") - F.col("k3") * F.col("d3")
    return grams, with_t(sums).select(*by, "hist", "s", (1 - used / F.col("s")).alias("gamma"), *([(F.col("kinds") + 1).alias("size")] if n == 1 else []))


def _asked(places: DataFrame, order: int, by: tuple[str, ...], one: Column) -> dict[int, DataFrame]:
    """By number of words: by, gram, the distinct padded grams of places, each level made from the one before; `one` is 1 for each place."""
    out = {}
    grams = places.select(*by, "gram", one.cast("long").alias("n"))
    for n in range(order, 0, -1):
        # Without a sum that is asked for, each level would be made of the text anew.
        out[n] = grams.groupBy(*by, "gram").agg(F.sum("n").alias("n")).filter("n > 0")
        grams = out[n].select(*by, F.expr(_SUFFIX).alias("gram"), "n")
    return {n: g.select(*by, "gram") for n, g in out.items()}


def _asked_of_all(sentences: DataFrame, text: str, order: int, by: tuple[str, ...]) -> dict[int, DataFrame]:
    """As _asked() of all places of sentences: the levels themselves, whose shuffles are those of a model of the same sentences."""
    return {n: level.filter("count > 0 AND before IS NOT NULL AND whole IS NOT NULL").select(*by, "gram") for n, level in _levels(sentences, text, order, *by).items()}


def _by_level(asked: dict[int, DataFrame], order: int, by: tuple[str, ...], score, known=None) -> DataFrame:
    """by, gram, p of the distinct padded grams that are asked: score(n, grams, p of their suffixes) of each level, the shortest first.

    Each level joins distinct grams, so a history comes once for each word that
    follows it. known(n, grams) adds what goes by the grams themselves, before
    they are dealt by their suffixes.
    """
    lower = None
    for n in range(1, order + 1):
        g = known(n, asked[n]) if known else asked[n]
        if lower is not None:
            g = g.withColumn("suffix", F.expr(_SUFFIX)).join(lower.select(*by, F.col("gram").alias("suffix"), F.col("p").alias("lower")), [*by, "suffix"]).drop("suffix")
        lower = score(n, g).select(*by, "gram", "p")
    return lower


def _scorer(model: dict[int, tuple[DataFrame, DataFrame]], by: tuple[str, ...]):
    """score(n, grams) and known(n, grams) of a Kneser-Ney model, for _by_level()."""

    def known(n: int, g: DataFrame) -> DataFrame:
        return g.join(model[n][0], [*by, "gram"], "left")

    def score(n: int, g: DataFrame) -> DataFrame:
        histories = model[n][1]
        a = F.coalesce("c", F.lit(0.0)) / F.col("s")
        if n == 1:  # one history of all words
            h = F.broadcast(histories.drop("hist"))
            return (g.join(h, list(by), "left") if by else g.crossJoin(h)).withColumn("p", a + F.col("gamma") / F.col("size"))
        g = g.withColumn("hist", F.expr(f"substring_index(gram, ' ', {n - 1})")).join(histories, [*by, "hist"], "left")
        return g.withColumn("p", F.when(F.col("gamma").isNull(), F.col("lower")).otherwise(a + F.col("gamma") * F.col("lower")))

    return score, known


def scored_places(rows: DataFrame, keys: list[str], model: dict[int, tuple[DataFrame, DataFrame]], order: int, by: tuple[str, ...] = (), asked: dict[int, DataFrame] | None = None) -> DataFrame:
    """keys, by, words, logprob (natural log, six places) of the words from lo to hi (from 1, both in) of w, a sentence with its marks.

    asked: the grams of these places and perhaps more, by number of words (by, gram), if they are there already.
    """
    places = rows.select(*keys, *by, F.explode(_padded(F.col("w"), F.col("lo"), F.col("hi"), order)).alias("gram"))
    if asked is None:
        # Places are dealt once, to be asked and to be answered. Each is counted by all of its columns, so the shuffle is the same one.
        places = places.repartition(*by, "gram")
        asked = _asked(places, order, by, F.when(F.length(F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])) >= 0, 1).otherwise(0))
    p = _by_level(asked, order, by, *_scorer(model, by))
    out = places.join(p, [*by, "gram"]).groupBy(*keys, *by).agg(F.count("*").alias("words"), F.round(F.sum(F.log("p")), 6).alias("logprob"))
    # The count keeps filters for keys that aren't null, as joins make, behind the sums: else places that are asked and places that are answered would differ.
    return out.select(*[F.when(F.col("words") > 0, F.col(k)).alias(k) for k in keys], *by, "words", "logprob")


def scored_sentences(sentences: DataFrame, keys: list[str], text: str, model: dict[int, tuple[DataFrame, DataFrame]], order: int, by: tuple[str, ...] = ()) -> DataFrame:
    """keys, by, words, logprob of whole sentences, the end mark included."""
    rows = sentences.select(*keys, *by, marked_words(F.col(text)).alias("w")).withColumns({"lo": F.lit(2), "hi": F.size("w")})
    return scored_places(rows, keys, model, order, by, _asked_of_all(sentences, text, order, by))


def scored_by_themselves(sentences: DataFrame, keys: list[str], text: str, order: int, by: tuple[str, ...] = ()) -> DataFrame:
    """keys, by, words, logprob as scored_sentences() by the kneser_ney() model of the same sentences, of order three or more.

    All that a place asks of its levels of three words and more lies with places
    whose history ends in the same two words, so places are shuffled once, to
    these two, and levels are counted over sorted rows there. Only pairs of words
    and single words, which levels of three sum up to, are tables of their own; what
    they say comes to the places with the distinct grams of three words.
    """
    levels = _levels(sentences, text, 3, *by)
    model = {n: _discounted(levels[n], n, order, by, levels.get(n - 1)) for n in (1, 2)}
    asked = {n: levels[n].filter("count > 0 AND before IS NOT NULL AND whole IS NOT NULL").select(*by, "gram") for n in (1, 2, 3)}
    pairs = _by_level(asked, 2, by, *_scorer(model, by)).select(*by, F.col("gram").alias("two"), F.col("p").alias("lower"))
    lower = asked[3].withColumn("two", F.expr(_SUFFIX)).join(pairs, [*by, "two"])
    places = sentences.select(*keys, *by, F.explode(_padded(marked_words(F.col(text)), F.lit(2), None, order)).alias("gram"))
    types = dict(places.dtypes)
    rows = places.withColumn("lower", F.lit(None).cast("double")).unionByName(lower.select(*[F.lit(None).cast(types[k]).alias(k) for k in keys], *by, "gram", "lower"))
    three = F.expr("substring_index(gram, ' ', -3)")
    # A first word has no history of two, and goes with its equals.
    rows = rows.withColumn("_part", F.when(three.startswith(" "), three).otherwise(F.substring_index(three, " ", 2))).repartition(*by, "_part")
    part = lambda *c: Window.partitionBy(*by, "_part", *c)
    rows = rows.withColumn("_p", F.max("lower").over(part(three))).filter("lower IS NULL").drop("lower")
    for n in range(order, 2, -1):
        gram = F.expr(f"substring_index(gram, ' ', -{n})")
        same = part(gram)
        count, whole = F.count("*").over(same), ~gram.startswith(" ")
        c = count if n == order else F.when(gram.startswith(f"{START} "), count).otherwise(F.sum(F.col(f"_f{n + 1}").cast("long")).over(same))
        rows = rows.withColumns({f"_c{n}": F.when(whole, c), f"_k{n}": count > 1, f"_f{n}": F.row_number().over(same.orderBy(gram)) == 1})
    # How many grams of each level count one to four: a row for each model. All columns are asked for (the filter holds for any row), so the shuffle is the same one and is reused.
    t = rows.filter((F.length(F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])) >= 0) & F.col("_p").isNotNull()).groupBy(*by).agg(*[F.count_if(F.col(f"_f{n}") & (F.col(f"_c{n}") == k)).alias(f"_t{n}{k}") for n in range(3, order + 1) for k in (1, 2, 3, 4)])
    t = F.broadcast(t.select(*by, *[d.alias(f"_d{n}{k}") for n in range(3, order + 1) for k, d in _discounts(f"_t{n}").items()]))
    rows = rows.join(t, list(by)) if by else rows.crossJoin(t)
    for n in range(3, order + 1):
        after = part(F.expr(f"substring_index(substring_index(gram, ' ', -{n}), ' ', {n - 1})"))
        c = F.col(f"_c{n}")
        left = F.when(F.col(f"_k{n}"), c - F.when(c == 1, F.col(f"_d{n}1")).when(c == 2, F.col(f"_d{n}2")).otherwise(F.col(f"_d{n}3"))).otherwise(0.0)
        once = F.col(f"_f{n}") & c.isNotNull()
        total = lambda x: F.sum(F.when(once, x)).over(after)  # noqa: B023, E731
        rows = rows.withColumn("_q", (left + (total(c) - total(left)) * F.col("_p")) / total(c))
        rows = rows.withColumn("_p", F.when(c.isNull(), F.col("_p")).otherwise(F.col("_q"))).drop("_q")
    return rows.groupBy(*keys, *by).agg(F.count("*").alias("words"), F.round(F.sum(F.log("_p")), 6).alias("logprob"))


def scored_candidates(tokens: DataFrame, points: DataFrame, keys: list[str], model: dict[int, tuple[DataFrame, DataFrame]], order: int, by: tuple[str, ...] = ()) -> DataFrame:
    """keys, by, i, form, candidate, words, logprob of each candidate of each ambiguous word of tokens (keys, by, w: array).

    points is a table of ambiguous words that fits a task's memory, as all words of
    the text meet it. Only the words whose probability the candidate changes are
    scored: itself and the order - 1 after it. The rest of the sentence is the same for all candidates.
    """
    forms = [r.form for r in points.select("form").distinct().collect()]

    def cut(w: Column) -> Column:
        """Places of ambiguous words, with what stands before and after each."""
        asked = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("form"))), lambda p: p["form"].isin(forms))
        marked = F.concat(F.array(F.lit(START)), w, F.array(F.lit(END)))
        place = lambda m: F.transform(asked, lambda p: F.struct(p["i"].alias("i"), p["form"].alias("form"), F.slice(m, F.greatest(F.lit(1), p["i"] + 3 - order), F.least(p["i"] + 1, F.lit(order - 1))).alias("left"), F.slice(m, p["i"] + 3, F.lit(order - 1)).alias("right")))
        return F.transform(F.array(marked), place)[0]

    # Contexts are cut inside the array, so a place doesn't carry its sentence on, and only at ambiguous words.
    at = tokens.select(*keys, *by, F.explode(F.transform(F.array("w"), cut)[0]).alias("p")).select(*keys, *by, "p.*").join(F.broadcast(points), "form")
    rows = at.select(*keys, *by, "i", "form", "candidate", F.concat("left", F.array("candidate"), "right").alias("w"), (F.size("left") + 1).alias("lo"), (F.size("left") + 1 + F.size("right")).alias("hi"))
    return scored_places(rows, [*keys, "i", "form", "candidate"], model, order, by)


def log_probability(sentences: DataFrame, key: str, text: str, counts: DataFrame, order: int, backoff: float = 0.4, by: tuple[str, ...] = ()) -> DataFrame:
    """key, by, words, logprob under stupid backoff (natural log), by a model for each `by`, which may not be null.

    The score of a word is count(history word) / count(history) for the longest
    history whose n-gram was counted, times backoff for each word given up; a
    word never seen counts as half of a single one.
    """
    # The count keeps the filter behind the sums (_discounted).
    total = counts.filter(f"n = 1 and (gram <> '{START}' or count < 0)").groupBy(*by).agg(F.sum("count").alias("total"))
    words = marked_words(F.col(text))
    # A place is a row with the words that its score depends on; each distinct such text is scored once.
    places = sentences.select(key, *by, F.explode(_padded(words, F.lit(2), None, order)).alias("gram"))

    def score(n: int, g: DataFrame) -> DataFrame:
        c = counts.filter(F.col("n") == n).select(*by, "gram", F.col("count").alias("c"))
        if n == 1:
            # A row for each model.
            t = F.broadcast(total)
            g = g.join(c, [*by, "gram"], "left")
            return (g.join(t, list(by)) if by else g.crossJoin(t)).withColumn("p", F.log(F.coalesce("c", F.lit(0.5)) / F.col("total")))
        # Counts get their history's beside them first: a gram whose history was not counted says nothing.
        history = counts.filter(F.col("n") == n - 1).select(*by, F.col("gram").alias("history"), F.col("count").alias("ch"))
        known = c.withColumn("history", F.expr(f"substring_index(gram, ' ', {n - 1})")).join(history, [*by, "history"]).select(*by, "gram", F.log(F.col("c") / F.col("ch")).alias("own"))
        given_up = F.when(F.col("gram").startswith(" "), F.col("lower")).otherwise(F.col("lower") + F.log(F.lit(backoff)))
        return g.join(known, [*by, "gram"], "left").withColumn("p", F.coalesce("own", given_up))

    scored = _by_level(_asked_of_all(sentences, text, order, by), order, by, score)
    return places.join(scored, [*by, "gram"]).groupBy(key, *by).agg(F.count("*").alias("words"), F.sum("p").alias("logprob"))


def prior(n: Column, tokens: Column) -> Column:
    return F.log((n + 1) / tokens)


def candidate_texts(tokens: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """key, i, form, candidate, text of tokens (key, w: array): each ambiguous word replaced by each candidate (points: form, candidate)."""
    at = tokens.select(key, F.posexplode("w").alias("i", "form")).join(points, "form")
    new = F.concat(F.slice("w", F.lit(1), F.col("i")), F.array("candidate"), F.slice("w", F.col("i") + 2, F.size("w")))
    return at.join(tokens, key).select(key, "i", "form", "candidate", F.array_join(new, " ").alias("text"))


def candidate_scores(candidates: DataFrame, lams: dict[str, float], otherwise: float, mean: bool = False) -> DataFrame:
    """candidates (logprob, prior, type, words) with score: logprob - lam * prior, lam by the type of point; mean divides logprob by words."""
    lam: Column = F.lit(otherwise)
    for kind, x in lams.items():
        lam = F.when(F.col("type") == kind, x).otherwise(lam)
    lp = F.col("logprob") / F.col("words") if mean else F.col("logprob")
    return candidates.withColumn("score", lp - lam * F.col("prior"))


def prior_swapped(candidates: DataFrame, frequencies: DataFrame) -> DataFrame:
    """candidates with prior taken anew from a table of frequencies (form, n); a form that it lacks counts as zero."""
    n = frequencies.groupBy(F.lower("form").alias("_form")).agg(F.sum("n").alias("_n"))
    total = frequencies.agg(F.sum("n").alias("_total"))  # one row
    j = candidates.withColumn("_form", F.lower("candidate")).join(n, "_form", "left").join(total)
    return j.withColumn("prior", prior(F.coalesce("_n", F.lit(0)), F.col("_total"))).drop("_form", "_n", "_total")


def decided(candidates: DataFrame, by: list[str], lam: float, margin: float) -> DataFrame:
    """by, default, best, gap, chosen of candidates (by, candidate, logprob, prior, is_default).

    Score: logprob - lam * prior. The default stays unless the best leads it by more than margin.
    """
    s = candidates.withColumn("score", F.col("logprob") - lam * F.col("prior"))
    g = s.groupBy(*by).agg(F.max_by("candidate", F.struct("score", "candidate")).alias("best"), F.max("score").alias("top"), F.max(F.when(F.col("is_default"), F.col("candidate"))).alias("default"), F.max(F.when(F.col("is_default"), F.col("score"))).alias("base"))
    return g.select(*by, "default", "best", (F.col("top") - F.col("base")).alias("gap")).withColumn("chosen", F.when(F.col("gap") > margin, F.col("best")).otherwise(F.col("default")))


@dataclass(frozen=True)
class Criteria:
    """How ambiguous words are decided.

    lam weighs the prior, by type of point or for all others. Scores are divided
    by words if `mean`. The classifier decides where the best leads the second by
    less than `tie` (None: never). What stands by default, the engine's candidate
    or the word of the source ('engine', 'source'), gives way only to a lead of
    more than `margin`. The part of speech decides first for the types in `veto`;
    the model is asked for the types in `model` (None: all).
    """

    lam: float = 0.0
    lams: dict[str, float] = field(default_factory=dict)
    mean: bool = False
    tie: float | None = None
    margin: float = 0.0
    default: str = "engine"
    veto: tuple[str, ...] = ()
    model: tuple[str, ...] | None = None


def cascade(slots: DataFrame, candidates: DataFrame, by: list[str], criteria: Criteria) -> DataFrame:
    """by, chosen, decided ('pos', 'engine', 'classifier', 'source' or 'model'), best, gap, lead of each slot.

    slots: by, type, form, engine, reading (what the part of speech decides for,
    or null), sense (the classifier's choice, or null). candidates: by,
    candidate, logprob, words, prior. gap is what the best leads the second by,
    lead what it leads the default by, without division by words. Of equal
    scores the smaller candidate is the better. A slot without candidates keeps
    the engine's; a classifier's choice that is no candidate doesn't count.
    """
    lam: Column = F.lit(criteria.lam)
    for kind, x in criteria.lams.items():
        lam = F.when(F.col("type") == kind, F.lit(x)).otherwise(lam)
    raw = F.col("logprob") - lam * F.col("prior")
    score = raw / F.greatest(F.col("words"), F.lit(1)) if criteria.mean else raw
    c = candidates.join(slots.select(*by, "type"), by).select(*by, (-score).alias("cost"), "candidate", raw.alias("raw"))
    # Candidates of one point are few: all of a slot lie in one small array, the best first.
    found = c.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cost", "candidate", "raw"))).alias("c"))
    s = slots.join(found, by, "left")
    at = lambda name: F.filter("c", lambda x: x["candidate"].eqNullSafe(F.col(name)))
    source = F.filter("c", lambda x: F.lower(x["candidate"]) == F.lower(F.col("form")))
    none = F.lit(None).cast("string")
    own = F.coalesce(F.when(F.col("engine").isNotNull(), F.try_element_at(source, F.lit(1))["candidate"]), none) if criteria.default == "source" else none
    s = s.withColumn("best", F.col("c")[0]["candidate"]).withColumn("gap", F.try_element_at("c", F.lit(2))["cost"] - F.col("c")[0]["cost"])
    s = s.withColumn("_own", own).withColumn("_default", F.coalesce("_own", "engine"))
    s = s.withColumn("lead", F.col("c")[0]["raw"] - F.try_element_at(at("_default"), F.lit(1))["raw"])
    asked = F.col("c").isNotNull() & (F.lit(True) if criteria.model is None else F.col("type").isin(*criteria.model))
    tied = (F.col("gap") < F.lit(criteria.tie)) & (F.size(at("sense")) > 0) & F.col("sense").isNotNull() if criteria.tie is not None else F.lit(False)
    kept = (F.size(at("_default")) > 0) & (F.col("best") != F.col("_default")) & (F.col("lead") <= criteria.margin)
    stage = (
        F.when(F.col("type").isin(*criteria.veto) & F.col("reading").isNotNull(), "pos").when(~asked, "engine").when(F.coalesce(tied, F.lit(False)), "classifier")
        .when(F.coalesce(kept, F.lit(False)), F.when(F.col("_own").isNotNull(), "source").otherwise("engine")).otherwise("model")
    )
    chosen = {"pos": F.col("reading"), "classifier": F.col("sense"), "source": F.col("_default"), "model": F.col("best")}
    pick: Column = F.col("engine")
    for name, value in chosen.items():
        pick = F.when(F.col("decided") == name, value).otherwise(pick)
    return s.withColumn("decided", stage).withColumn("chosen", pick).select(*by, "chosen", "decided", "best", "gap", "lead")


def reversed_words(text: Column) -> Column:
    """The words of a text in reverse order, for a model that looks at what follows."""
    return F.array_join(F.reverse(F.split(text, " ")), " ")


def combined_scores(parts: dict[str, DataFrame], key: list[str], sums: dict[str, dict[str, float]]) -> DataFrame:
    """key, a column for each part (tables with a column logprob), and weighted sums of them: a mean, a mix, or a difference where a weight is below 0."""
    out = None
    for name, df in parts.items():
        part = df.select(*key, F.col("logprob").alias(name))
        out = part if out is None else out.join(part, key)
    return out.withColumns({total: sum((w * F.col(name) for name, w in weights.items()), F.lit(0.0)) for total, weights in sums.items()})


def applied(texts: DataFrame, key: str, choices: DataFrame, text: str = "text") -> DataFrame:
    """key, text: texts (key, text: words parted by blanks) with the choices (key, i, chosen) put in.

    Texts go through the shuffle as they are, not as arrays, and choices without those that keep the word (default, if there is such a column).
    """
    if "default" in choices.columns:
        choices = choices.filter(~F.col("chosen").eqNullSafe(F.col("default")))
    m = choices.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "chosen"))).alias("m"))
    put = F.transform(F.split(text, " "), lambda w, i: F.coalesce(F.try_element_at("m", i), w))
    return texts.select(key, text).join(m, key, "left").select(key, F.when(F.col("m").isNull(), F.col(text)).otherwise(F.array_join(put, " ")).alias("text"))


def margin_sweep(candidates: DataFrame, by: list[str], settings: dict[str, dict[str, float]], expected: str = "expected", digits: int = 9) -> DataFrame:
    """setting, margin, hits, serious of every margin at which a decision changes, for each setting (lam by type).

    candidates: by, type, candidate, logprob, prior, is_default, and the
    expected candidate of the slot. A default gives way to the best if the best
    leads it by more than the margin. Serious: a default is given up for a wrong
    candidate. Margins are leads themselves, rounded, and 0; nothing between two of them changes a decision.
    Sums over all leads above a margin run through slices of a range sort.
    """
    rows = F.array(*[F.struct(F.lit(name).alias("setting"), F.coalesce(*[F.when(F.col("type") == t, F.lit(float(x))) for t, x in lams.items()], F.lit(0.0)).alias("lam")) for name, lams in settings.items()])
    c = candidates.select("*", F.explode(rows).alias("s")).withColumn("score", F.col("logprob") - F.col("s.lam") * F.col("prior"))
    slot = c.groupBy("s.setting", *by).agg(
        F.min_by("candidate", F.struct(-F.col("score"), "candidate")).alias("best"), F.max("score").alias("top"),
        F.max(F.when(F.col("is_default"), F.col("candidate"))).alias("default"), F.max(F.when(F.col("is_default"), F.col("score"))).alias("base"), F.max(expected).alias("want"),
    )
    is_ = lambda c: F.col(c).eqNullSafe(F.col("want"))
    slot = slot.withColumn("lead", F.round(F.col("top") - F.col("base"), digits))
    # What a slot adds where the default is kept, and by how much that changes where it is given up.
    kept = is_("default").cast("int")
    other = F.col("best") != F.col("default")
    each = slot.groupBy("setting", F.greatest("lead", F.lit(0.0)).alias("margin")).agg(
        F.sum(kept).alias("kept"), F.sum(F.when(other, is_("best").cast("int") - kept).otherwise(0)).alias("gain"), F.count_if(other & ~is_("best")).alias("wrong"),
    )
    zero = each.select("setting").distinct().select("setting", F.lit(0.0).alias("margin"), *[F.lit(0).cast("long").alias(n) for n in ("kept", "gain", "wrong")])
    each = each.unionByName(zero).groupBy("setting", "margin").agg(*[F.sum(n).alias(n) for n in ("kept", "gain", "wrong")])
    run = running_sums(each, ["setting"], [F.col("margin").desc()], {"gained": F.col("gain"), "serious": F.col("wrong")})
    total = each.groupBy("setting").agg(F.sum("kept").alias("all_kept"))
    run = run.join(total, "setting")
    return run.select("setting", "margin", (F.col("all_kept") + F.col("gained") - F.col("gain")).alias("hits"), (F.col("serious") - F.col("wrong")).alias("serious"))


def best_margins(sweep: DataFrame, most_serious: int, top: int = 1) -> DataFrame:
    """The `top` rows of a sweep of each setting: most hits among margins with `most_serious` serious errors at most, then fewest of these, then the least margin."""
    w = Window.partitionBy("setting").orderBy(F.desc("hits"), "serious", "margin")
    return sweep.filter(F.col("serious") <= most_serious).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def grid(decisions: DataFrame, parameters: DataFrame) -> DataFrame:
    """margin, lam, hits, serious of decisions (default, best, expected, gap0, dprior) for each row of parameters, a small table: each decision is taken once for each."""
    x = decisions.crossJoin(parameters)
    chosen = F.when(F.col("gap0") - F.col("lam") * F.col("dprior") > F.col("margin"), F.col("best")).otherwise(F.col("default"))
    x = x.withColumn("chosen", chosen)
    return x.groupBy("margin", "lam").agg(F.count_if(F.col("chosen") == F.col("expected")).alias("hits"), F.count_if((F.col("chosen") != F.col("expected")) & (F.col("expected") == F.col("default"))).alias("serious"))


def slot_features(words: Column, i: Column, window: int = 8) -> Column:
    """Features of the slot at i (from 0): neighbours, two bigrams, and the bag around it."""
    get = lambda k: F.coalesce(F.when(i + k >= 0, F.try_element_at(words, (i + k + 1).cast("int"))), F.lit("_"))
    f = lambda name, *ks: F.concat(F.lit(f"{name}="), F.concat_ws(" ", *[get(k) for k in ks]))
    lo = F.greatest(F.lit(0), i - window)
    bag = F.concat(F.slice(words, lo + 1, i - lo), F.slice(words, i + 2, F.lit(window)))
    return F.concat(F.array(f("L1", -1), f("L2", -2), f("R1", 1), f("R2", 2), f("LL", -2, -1), f("RR", 1, 2)), F.transform(F.array_distinct(bag), lambda w: F.concat(F.lit("B="), w)))


def bayes_train(examples: DataFrame, least: int = 2) -> DataFrame:
    """group, feature, n0, n1, t0, t1, v of examples (group, cls 0 or 1, features): counts, totals, and vocabulary size; rare features go."""
    n = examples.select("group", "cls", F.explode("features").alias("feature")).groupBy("group", "feature").agg(F.count_if(F.col("cls") == 0).alias("n0"), F.count_if(F.col("cls") == 1).alias("n1"))
    n = n.filter(F.col("n0") + F.col("n1") >= least)
    t = n.groupBy("group").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count("*").alias("v"))
    return n.join(t, "group")


def _odds(alpha: float) -> Column:
    p = lambda n, t: (F.col(n) + alpha) / (F.col(t) + alpha * F.col("v"))
    return F.log(p("n0", "t0")) - F.log(p("n1", "t1"))


#: Features whose odds go to the slots; slots' rarer features are shuffled to theirs.
COMMON = 10_000


def bayes_logodds(slots: DataFrame, key: list[str], model: DataFrame, alpha: float = 0.5) -> DataFrame:
    """key, logodds of class 0 (equal priors); features that the model doesn't know don't count.

    Odds of the COMMON most frequent features go to all tasks, where they are
    summed for each slot; a feature of most slots would be one task's work.
    """
    odds = model.select("group", "feature", (F.col("n0") + F.col("n1")).alias("_n"), _odds(alpha).alias("_o"))
    top = odds.orderBy(F.desc("_n"), "group", "feature").limit(COMMON).select("group", "feature", "_o")
    f = slots.select(*key, "group", F.explode("features").alias("feature")).join(F.broadcast(top), ["group", "feature"], "left")
    rest = f.filter("_o IS NULL").drop("_o").join(odds.drop("_n"), ["group", "feature"])
    met = f.filter("_o IS NOT NULL").select(*key, "_o").unionByName(rest.select(*key, "_o"))
    return met.groupBy(*key).agg(F.round(F.sum("_o"), 6).alias("logodds"))


def informative(model: DataFrame, least: int = 20, top: int = 10, alpha: float = 0.5) -> DataFrame:
    """group, feature, odds of the `top` features of each class and group; each end is a window of its own, so that partial sorts keep only `top` rows before the shuffle."""
    m = model.filter(F.col("n0") + F.col("n1") >= least).select("group", "feature", F.round(_odds(alpha), 6).alias("odds"))

    def end(order: Column) -> DataFrame:
        w = Window.partitionBy("group").orderBy(order, "feature")
        return m.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")

    return end(F.desc("odds")).union(end(F.asc("odds"))).distinct()


def balanced_accuracy(scored: DataFrame, *by: str) -> DataFrame:
    """by, accuracy (mean recall of the classes) of scored (cls, logodds)."""
    hit = F.when(F.col("logodds") > 0, 0).otherwise(1) == F.col("cls")
    recall = scored.groupBy(*by, "cls").agg(F.avg(hit.cast("int")).alias("recall"))
    return recall.groupBy(*by).agg(F.round(F.avg("recall"), 6).alias("accuracy"))


def labelled_examples(slots: DataFrame, key: str, cap: int, seed: str) -> DataFrame:
    """Slots (key, group, cls, ...) of texts that hold one class of a group only, at most cap of each class in a seeded order."""
    one = slots.groupBy(key, "group").agg(F.count_distinct("cls").alias("k")).filter("k = 1").select(key, "group")
    kept = slots.join(one, [key, "group"], "left_semi")
    w = Window.partitionBy("group", "cls").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("i").cast("string"))), key, "i")
    return kept.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


def bayes_choice(logodds: DataFrame, first: str, second: str) -> DataFrame:
    """logodds with choice: the first candidate for a positive score."""
    return logodds.withColumn("choice", F.when(F.col("logodds") > 0, first).otherwise(second))


def gold_label(expected: Column, candidates: Column, reference_words: Column) -> Column:
    """The expected candidate, else the only candidate that the reference has."""
    inside = F.array_intersect(candidates, reference_words)
    return F.coalesce(expected, F.when(F.size(inside) == 1, inside[0]))


def pos_veto(pos: Column, gender: Column, noun: Column, verb: Column) -> Column:
    """The reading that a part of speech decides for: the noun, the verb, or null."""
    return F.when(pos.isin("VERB", "AUX"), verb).when(pos.isin("NOUN", "PROPN") | gender.isNotNull(), noun)


def lemmatised(tokens: DataFrame, key: str, keep: DataFrame) -> DataFrame:
    """key, text, n_changed of tokens (key, i, form, lemma, pos): lemmas, but for forms to keep, marks and numbers."""
    j = tokens.join(keep.select("form", F.lit(True).alias("kept")).distinct(), "form", "left")
    out = F.when(F.col("kept") | F.col("pos").isin("PUNCT", "NUM") | F.col("lemma").isNull(), F.col("form")).otherwise(F.col("lemma"))
    j = j.withColumn("out", out)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "out"))), lambda x: x["out"])
    return j.groupBy(key).agg(F.array_join(listed, " ").alias("text"), F.count_if(F.col("out") != F.col("form")).alias("n_changed"))


def mixed_scores(scores: list[tuple[DataFrame, float]], key: list[str]) -> DataFrame:
    """key, score: weighted sum of tables with a column logprob (a difference has a negative weight)."""
    out = None
    for k, (df, weight) in enumerate(scores):
        part = df.select(*key, (weight * F.col("logprob")).alias(f"s{k}"))
        out = part if out is None else out.join(part, key)
    return out.select(*key, sum((F.col(f"s{k}") for k in range(len(scores))), F.lit(0.0)).alias("score"))


def fusion(cases: DataFrame, weights: list[float], gaps: list[float]) -> DataFrame:
    """rule, value, grp, accuracy of cases (grp, gap, logodds, first_right): gap + w * logodds, or the classifier where the gap is small."""
    rules = [("sum", w, F.col("gap") + w * F.col("logodds") > 0) for w in weights] + [("below", g, F.when(F.abs("gap") < g, F.col("logodds") > 0).otherwise(F.col("gap") > 0)) for g in gaps]
    tried = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(float(v)).alias("value"), says.alias("says")) for n, v, says in rules])
    x = cases.select("grp", "first_right", F.explode(tried).alias("t")).select("grp", "first_right", "t.*")
    return x.groupBy("rule", "value", "grp").agg(F.round(F.avg((F.col("says") == F.col("first_right")).cast("int")), 6).alias("accuracy"))
