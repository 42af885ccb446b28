"""Agreement with a rewritten noun along the paths of a dependency parse, and repairs of elision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from .lineage import cut
from .rewrite import dependents_changed, phrase_agreed

# The relations by which a word agrees with its head, and a subject with its predicate.
UP = ("det", "amod", "acl", "flat", "conj")
SUBJECT = ("nsubj", "nsubj:pass")
COMPLEMENT = ("obj", "nsubj", "obl", "iobj", "ccomp")
#: The auxiliary of compound tenses, and those that leave a participle agreeing all the same.
COMPOUND, COPULAS = ("haver", "haure"), ("ser", "ésser", "estar")


def controllers(tokens: DataFrame, key: str, up: tuple[str, ...] = UP, subject: tuple[str, ...] = SUBJECT, complement: tuple[str, ...] = COMPLEMENT) -> DataFrame:
    """tokens with `controller`: the place i of the noun that a word agrees with, null for none.

    tokens: key, i, head (place of the head, null for none), dep, agrees (whether
    the word is an adjective, participle or determiner), participle, lemma, and
    relative (whether it is a relative pronoun). A word that agrees looks to its
    head if it hangs on it by one of `up`, and a predicate to its subject, so an
    attribute of a predicate, one joined to another, or a participle behind a
    relative reach the noun over several steps; all paths are followed at once,
    each round doubling how far they go. A path stops at a participle with a
    complement of its own without a preposition (that is what it agrees with,
    not its head), and at one of a compound tense. Heads in a circle control nothing.
    """
    t = tokens.select(key, "i", "head", "dep", "agrees", "participle", "lemma", "relative")
    cased = t.filter(F.col("dep") == "case").select(key, F.col("head").alias("i")).distinct().withColumn("_cased", F.lit(True))
    child = t.join(cased, [key, "i"], "left").filter("head IS NOT NULL")
    lemma = F.lower("lemma")
    of = child.groupBy(key, F.col("head").alias("i")).agg(
        F.bool_or(F.col("dep").isin(*complement) & F.col("_cased").isNull() & ~F.coalesce("relative", F.lit(False))).alias("_own"),
        F.bool_or((F.col("dep") == "aux") & lemma.isin(*COMPOUND)).alias("_compound"), F.bool_or(lemma.isin(*COPULAS)).alias("_copula"),
        F.min(F.when(F.col("dep").isin(*subject) & ~F.coalesce("relative", F.lit(False)), F.col("i"))).alias("_subject"),
        F.bool_or(F.col("dep").isin(*subject) & F.coalesce("relative", F.lit(False))).alias("_by_relative"),
    )
    t = t.join(of, [key, "i"], "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    tense = is_("participle") & is_("_compound") & ~is_("_copula")
    hangs = F.col("dep").isin(*up)
    # A predicate's own subject goes before its head; behind a relative the head is what the relative stands for.
    alone = is_("participle") & is_("_own") & F.col("_subject").isNull()
    step = F.when(tense | alone | ~is_("agrees"), None).when(F.col("_subject").isNotNull(), F.col("_subject")).when(hangs | is_("_by_relative"), F.col("head"))
    at = cut(t.select(key, "i", F.coalesce(step, "i").alias("to"), is_("agrees").alias("agrees")))
    longest = at.groupBy(key).count().agg(F.max("count")).first()[0] or 1
    for _ in range(int(longest).bit_length()):
        beyond = at.select(key, F.col("i").alias("to"), F.col("to").alias("_far"))
        at = cut(at.join(beyond, [key, "to"], "left").select(key, "i", F.coalesce("_far", "to").alias("to"), "agrees"))
        if at.join(at.select(key, F.col("i").alias("to"), F.col("to").alias("_far")), [key, "to"]).filter("_far <> to").isEmpty():
            break
    # Only what has come to rest at a word that doesn't agree itself has a controller.
    rest = at.filter((F.col("i") == F.col("to")) & ~F.col("agrees")).select(key, F.col("i").alias("controller"))
    ends = at.filter(F.col("i") != F.col("to")).select(key, "i", F.col("to").alias("controller")).join(rest, [key, "controller"])
    return tokens.join(ends, [key, "i"], "left")


def path_agreed(tokens: DataFrame, key: str, morphology: DataFrame, gender: str = "gender") -> DataFrame:
    """Where a noun was rewritten: all words that agree with it over any path take its gender (controllers, phrase_agreed)."""
    return phrase_agreed(controllers(tokens, key), key, morphology, gender, "controller").drop("controller")


# What controllers() asks of a word, a bit each.
_CASE, _COMPLEMENT, _COMPOUND, _COPULA, _SUBJECT, _RELATIVE, _PARTICIPLE, _AGREES, _HANGS = (1 << k for k in range(9))


@F.pandas_udf(Y.ArrayType(Y.IntegerType()))
def _ends(heads: pd.Series, bits: pd.Series) -> pd.Series:
    """Paths are followed over heads of any order, which no expression says; all texts of a batch go together, as one array."""
    n = np.array([len(x) for x in heads], dtype=np.int64)
    if not n.sum():
        return pd.Series([[]] * len(n), dtype=object)
    start = np.repeat(np.cumsum(n) - n, n)
    head, b = np.concatenate(list(heads)).astype(np.int64), np.concatenate(list(bits)).astype(np.int64)
    me = np.arange(len(head))
    there = (head >= 0) & (head < np.repeat(n, n))
    to = np.where(there, head + start, me)
    is_ = lambda bit: (b & bit) > 0

    def of(children: np.ndarray) -> np.ndarray:
        """Whether a word has one of these children."""
        out = np.zeros(len(head), dtype=bool)
        out[to[children & there]] = True
        return out

    own = of(is_(_COMPLEMENT) & ~of(is_(_CASE)))
    tense = is_(_PARTICIPLE) & of(is_(_COMPOUND)) & ~of(is_(_COPULA))
    subject = np.full(len(head), len(head))
    first = is_(_SUBJECT) & there
    np.minimum.at(subject, to[first], me[first])
    has = subject < len(head)
    stops = tense | (is_(_PARTICIPLE) & own & ~has) | ~is_(_AGREES)
    at = np.where(stops, me, np.where(has, subject, np.where((is_(_HANGS) | of(is_(_RELATIVE))) & there, to, me)))
    for _ in range(int(n.max()).bit_length()):
        far = at[at]
        if (far == at).all():
            break
        at = far
    end = np.where((at != me) & (at[at] == at) & ~is_(_AGREES)[at], at - start, -1).astype(np.int32)
    return pd.Series(np.split(end, np.cumsum(n)[:-1]), dtype=object)


def text_controllers(words: Column, up: tuple[str, ...] = UP, subject: tuple[str, ...] = SUBJECT, complement: tuple[str, ...] = COMPLEMENT) -> Column:
    """As controllers(), of the words of a text in one array (head, dep, agrees, participle, lemma, relative).

    Heads and the controllers that come out are positions in the array (from 0; below 0: none).
    """

    def bits(x: Column) -> Column:
        relative, lemma = F.coalesce(x["relative"], F.lit(False)), F.lower(x["lemma"])
        held = [(_CASE, x["dep"] == "case"), (_COMPLEMENT, x["dep"].isin(*complement) & ~relative), (_COMPOUND, (x["dep"] == "aux") & lemma.isin(*COMPOUND)), (_COPULA, lemma.isin(*COPULAS)), (_SUBJECT, x["dep"].isin(*subject) & ~relative),
                (_RELATIVE, x["dep"].isin(*subject) & relative), (_PARTICIPLE, x["participle"]), (_AGREES, x["agrees"]), (_HANGS, x["dep"].isin(*up))]
        return sum((F.when(c, bit).otherwise(0) for bit, c in held), F.lit(0))

    return _ends(F.transform(words, lambda x: F.coalesce(x["head"], F.lit(-1))), F.transform(words, bits))


def path_changes(texts: DataFrame, key: str, morphology: DataFrame, words: str = "t") -> DataFrame:
    """key, i, put: what path_agreed() changes, of texts whose words lie in one array each (text_controllers, dependents_changed), so no token is shuffled to meet its head."""
    return dependents_changed(texts.withColumn("_controller", text_controllers(F.col(words))), key, morphology, words, "_controller")


def undone_elision(tokens: DataFrame, key: str, full: dict[str, str | tuple[str, str]], contracted: dict[str, str], gender: str = "gender", vowel: str = r"^h?[aeiouàèéíòóúïü]") -> DataFrame:
    """Where a word was rewritten: what is elided before it stands in full before a consonant, and a contraction before it is undone before a vowel.

    full: of an elided letter the word, or its forms before a masculine and a
    feminine (column gender; null is masculine). contracted: of a contraction
    what stands for it, with the elision, and without the blank that followed.
    """
    prefix, rest = T.elided(F.col("translated"))
    changed, low = F.col("rule").isNotNull(), F.lower(prefix)
    word: Column = F.lit(None).cast("string")
    for letter, forms in full.items():
        form = F.lit(forms) if isinstance(forms, str) else F.when(F.col(gender) == "f", forms[1]).otherwise(forms[0])
        word = F.when(low == letter, form).otherwise(word)
    # A capital letter alone says nothing of a word in capitals: the rest does.
    capitals = F.when(rest.rlike(r"^[^\p{Ll}]*$") & (F.length(rest) > 1), F.upper(word)).otherwise(T.keep_case(prefix, word))
    consonant = changed & (prefix != "") & ~F.lower(rest).rlike(vowel)
    t = tokens.withColumn("translated", F.when(consonant & word.isNotNull(), F.concat(capitals, F.lit(" "), rest)).otherwise(F.col("translated")))
    w = Window.partitionBy(key).orderBy("i")
    table = F.create_map(*[F.lit(x) for kv in contracted.items() for x in kv])
    before = F.map_contains_key(table, F.lower("translated")) & (F.lead("translated").over(w) == " ") & F.lead("rule", 2).over(w).isNotNull() & F.lower(F.lead("translated", 2).over(w)).rlike(vowel)
    t = t.withColumn("_open", F.coalesce(before, F.lit(False)))
    t = t.withColumn("_gone", F.coalesce(F.lag("_open").over(w), F.lit(False)))
    put = F.when(F.col("_open"), T.keep_case(F.col("translated"), F.try_element_at(table, F.lower("translated")))).when(F.col("_gone"), "").otherwise(F.col("translated"))
    return t.withColumn("translated", put).drop("_open", "_gone")
