"""Row predicates and classes on text and pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# How list items and dotted leaders look.
LIST_START = r"^\s*(?:\d+[.\)º]|[a-zA-Z]\s?\)|[-–—•·*]|[IVXLC]+\.)\s"
LEADERS = r"\.\s*\.\s*\.\s*\."


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def valid_sentence(text: Column, least: int = 8, most: int = 40) -> Column:
    """A whole sentence of least to most words: capital or quote first, mark last, no list, few numbers."""
    t = F.trim(text)
    n = F.size(words(t))
    digits = F.size(F.filter(words(t), lambda w: w.rlike(r"\d")))
    return (
        n.between(least, most) & t.rlike(r'^[\p{Lu}«"“]') & t.rlike(r"[.?!]$") & ~t.endswith("...") & ~t.rlike(LIST_START) & (F.upper(t) != t)
        & (digits <= F.greatest(F.lit(2), F.floor(n / 8)))
    )


def letter_share(text: Column) -> Column:
    """Letters among the characters that aren't blanks; null if there are none."""
    solid = F.regexp_replace(text, " ", "")
    return F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, r"[^\p{L}]", "")) / F.length(solid))


def looks_tabular(paragraph: Column, share: float = 0.55, least: int = 8) -> Column:
    p = F.trim(paragraph)
    return (F.length(p) >= least) & (p.rlike(LEADERS) | F.coalesce(letter_share(p) < share, F.lit(False)))


def length_window(text: Column, least_words: int, least: int, most: int, share: float = 0.55) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (F.size(words(text)) >= least_words) & F.length(text).between(least, most) & F.coalesce(letters / F.length(text) >= share, F.lit(False))


def about_words(text: Column, terms: list[str]) -> Column:
    """Whether a text speaks of words themselves."""
    return F.lower(text).rlike(rf"(?<![\p{{L}}])(?:{'|'.join(terms)})(?![\p{{L}}])")


def good_paragraph(quality: Column, lang: Column, heading: Column, sensitive: Column, score: Column, want_quality: str, want_lang: str, least: float) -> Column:
    return (quality == want_quality) & (lang == want_lang) & (heading != "yes") & (sensitive != "yes") & (score >= least)


def length_ratio(a: Column, b: Column) -> Column:
    """Longer by shorter length; infinite if one is empty."""
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(low > 0, high / low).otherwise(F.lit(float("inf")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def pair_kept(a: Column, b: Column, similarity: Column, safe: float = 0.3, ratio: float = 2.0) -> Column:
    """safe, no_words, uneven or rescued; the first and the last are kept."""
    no_words = (F.size(T.pair_tokens(a)) == 0) | (F.size(T.pair_tokens(b)) == 0)
    return F.when(similarity >= safe, "safe").when(no_words, "no_words").when(length_ratio(a, b) > ratio, "uneven").otherwise("rescued")


def pair_noise(a: Column, b: Column, least: int = 4) -> Column:
    """identical, case_only, reordered (same words, least or more of them) or net."""
    ta, tb = T.pair_tokens(a), T.pair_tokens(b)
    return F.when(F.trim(a) == F.trim(b), "identical").when(ta == tb, "case_only").when((F.size(ta) >= least) & (F.array_sort(ta) == F.array_sort(tb)), "reordered").otherwise("net")


def aligned(a: Column, b: Column, similarity: Column, low: float = 0.85, high: float = 1.15, least: float = 0.6) -> Column:
    return (F.length(a) >= low * F.length(b)) & (F.length(a) <= high * F.length(b)) & (similarity >= least) & (a != b)


def suspicions(source: Column, target: Column, entities: list[str], leaks: list[str], notes: list[str], low: float = 0.5, high: float = 1.8) -> Column:
    """Flags of a generated pair: empty, leak, entity_lost, entity_new, glitch, note, length, untranslated."""
    has = lambda c, w: c.rlike(rf"(?<![\p{{L}}\d_]){w}(?![\p{{L}}\d_])")
    lost = [F.when(has(source, e) & ~has(target, e), F.lit("entity_lost")).when(~has(source, e) & has(target, e), F.lit("entity_new")) for e in entities]
    ratio = F.length(target) / F.greatest(F.length(source), F.lit(1))
    flags = [
        *[F.when(F.lower(target).contains(x.lower()), F.lit("leak")) for x in leaks], *lost,
        F.when(target.rlike(r"(?i)(?<![\p{L}\d_])([\p{L}\d_])'\1-"), F.lit("glitch")), F.when(target.rlike(rf"(?i)(?:{'|'.join(notes)})"), F.lit("note")),
        F.when((ratio < low) | (ratio > high), F.lit("length")), F.when(F.trim(F.lower(source)) == F.trim(F.lower(target)), F.lit("untranslated")),
    ]
    return F.when(F.trim(target) == "", F.array(F.lit("empty"))).otherwise(F.array_distinct(F.filter(F.array(*flags), lambda x: x.isNotNull())))


def band(index: Column) -> Column:
    """Seven bands of an index between 0 and 1, and none."""
    return (
        F.when(index.isNull(), "none").when(index == 0, "0").when(index < 0.25, "0-0.25").when(index < 0.5, "0.25-0.5").when(index < 0.75, "0.5-0.75").when(index < 1, "0.75-1").otherwise("1")
    )


def decile(score: Column) -> Column:
    return F.least(F.floor(score * 10), F.lit(9)) / 10


def marker_group(n: Column) -> Column:
    return F.when(n >= 5, "5+").otherwise(n.cast("string"))


def error_class(default: Column, expected: Column, chosen: Column) -> Column:
    """hit, needless (the default was right), untranslated (it was kept) or wrong."""
    return F.when(chosen == expected, "hit").when(expected == default, "needless").when(chosen == default, "untranslated").otherwise("wrong")


def one_present(text_words: Column, a: Column, b: Column) -> Column:
    """The form of the two that is in the words, if just one is."""
    in_a, in_b = F.array_contains(text_words, a), F.array_contains(text_words, b)
    return F.when(in_a & ~in_b, a).when(in_b & ~in_a, b)
