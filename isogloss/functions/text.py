"""Column functions on text: tokens, normal forms, keys and repairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, all patterns down to ENCLITIC: what counts as a token, a number, an apostrophe or an elision must match.
#: Words of letters; the middle dot and the hyphen hold parts together, an apostrophe parts them.
WORDS = r"[\p{L}\p{M}]+(?:[·\-][\p{L}\p{M}]+)*"
LETTERS = r"[\p{L}\p{M}]+"
#: Words for pairs: the apostrophe holds too.
PAIR_WORDS = r"[\p{L}\p{M}]+(?:['·\-][\p{L}\p{M}]+)*"
#: As WORDS, but only the hyphen holds.
HYPHEN_WORDS = r"[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*"
#: Lossless: number, word, blanks, or any one character.
LOSSLESS = r"(?s)[0-9]+(?:[.,][0-9]+)*|[A-Za-zÀ-ÖØ-öø-ÿ·]+(?:['’ʼ\-][A-Za-zÀ-ÖØ-öø-ÿ·]+)*|\s+|."
APOSTROPHES = "´‘’ʼ`"
#: Units of language-model text: word with the apostrophe after it, number, or one other mark.
LM_UNITS = r"[\p{L}\p{M}]+(?:[·\-][\p{L}\p{M}]+)*'?|[0-9]+(?:[.,][0-9]+)*|[^\s\p{L}\p{M}0-9]"
ELIDED = r"(?i)^([dlsmtn])['’ʼ](.+)$"
#: Pronouns behind a verb; several may follow one another.
ENCLITICS = ["me", "te", "se", "nos", "vos", "los", "les", "la", "lo", "li", "ho", "hi", "ne", "ls", "ns", "m", "t", "s", "n", "l", "en"]
ENCLITIC = rf"(?i)^(.+?)((?:['’ʼ-](?:{'|'.join(ENCLITICS)}))+)$"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fold_apostrophes(text: Column) -> Column:
    return F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))


def tokens(text: Column) -> Column:
    return matches(F.lower(text), WORDS)


def bare_words(text: Column) -> Column:
    return matches(F.lower(text), LETTERS)


def word_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(bare_words(text)))


def pair_tokens(text: Column) -> Column:
    return matches(fold_apostrophes(F.lower(text)), PAIR_WORDS)


def hyphen_words(text: Column) -> Column:
    return matches(fold_apostrophes(F.lower(text)), HYPHEN_WORDS)


def lossless(text: Column) -> Column:
    return matches(text, LOSSLESS)


def detokenise(parts: Column) -> Column:
    return F.array_join(parts, "")


def lm_text(text: Column) -> Column:
    """Lower case, numbers as 0, marks as units of their own, one blank between units."""
    units = matches(F.lower(fold_apostrophes(text)), LM_UNITS)
    return F.array_join(F.transform(units, lambda u: F.when(u.rlike("^[0-9]"), "0").otherwise(u)), " ")


def repeat_text(text: Column) -> Column:
    """What is left of a text when case, digits, marks and blanks don't count."""
    return F.array_join(matches(F.regexp_replace(F.lower(text), "[0-9]+", ""), WORDS), " ")


def repeat_key(text: Column) -> Column:
    return F.xxhash64(repeat_text(text))


def pair_key(a: Column, b: Column) -> Column:
    return F.struct(F.lower(F.trim(a)).alias("a"), F.lower(F.trim(b)).alias("b"))


def sentence_id(text: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.trim(text))), 1, 16)


def url_id(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


def numbered_id(prefix: Column, number: Column) -> Column:
    return F.format_string("%s-%04d", prefix.cast("string"), number)


def rejoin_lines(text: Column) -> Column:
    """A line that starts in lower case goes on with the one before."""
    return F.regexp_replace(text, r"\s*\n\s*(?=\p{Ll})", " ")


def join_open_lines(text: Column) -> Column:
    """Lines that don't end in . ! ? or : go on in the next."""
    return F.regexp_replace(text, r"(?<![.!?:])[ \t]*\n[ \t]*", " ")


def bracketed(text: Column) -> Column:
    """Texts in square brackets."""
    return F.regexp_extract_all(text, F.lit(r"\[([^\[\]\n]+)\]"), F.lit(1))


def repair_breaks(text: Column, width: int = 45, merges: int = 5) -> Column:
    """Undo line breaks inside sentences.

    A line takes in the next one if that starts with a closing mark, or if it is
    shorter than width and has no closing mark itself; up to `merges` times. A
    leading [dd/mm/yyyy] goes, blank lines fold to one, and no blank stays before
    a mark.
    """
    lines = F.transform(F.split(F.regexp_replace(text, r"^\[\d{2}/\d{2}/\d{4}\]\s*", ""), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    start = F.expr("named_struct('out', cast(array() as array<string>), 'line', '', 'n', 0)")

    def merge(acc: Column, line: Column) -> Column:
        open_ = (F.length(acc["line"]) < width) & ~acc["line"].rlike(r'[.?!:;"»]$')
        mark = line.rlike(r"^[,:;.!?)»]")
        join = (acc["line"] != "") & (line != "") & (acc["n"] < merges) & (open_ | mark)
        joined = F.concat(acc["line"], F.when(mark, "").otherwise(" "), line)
        done = F.when(acc["line"] != "", F.array_append(acc["out"], acc["line"])).when((F.size(acc["out"]) > 0) & (F.try_element_at(acc["out"], F.lit(-1)) != ""), F.array_append(acc["out"], F.lit(""))).otherwise(acc["out"])
        return F.when(join, F.struct(acc["out"].alias("out"), joined.alias("line"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(done.alias("out"), line.alias("line"), F.lit(0).alias("n")))

    # A first blank line would count as a line of its own, so the fold starts at the first of all.
    folded = F.aggregate(F.array_append(lines, F.lit("")), start, merge, lambda acc: F.array_join(acc["out"], "\n"))
    folded = F.regexp_replace(F.regexp_replace(folded, r"\n{3,}", "\n\n"), r" ([,:;.!?])", "$1")
    return F.regexp_replace(folded, r"^\s+|\s+$", "")


def filled(parts: Column) -> Column:
    """Parts without blanks around them; empty ones are left out."""
    # F.trim itself would be given the index as the characters to take off.
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def drop_lines(text: Column, patterns: list[str]) -> Column:
    """Drop lines that match a pattern; the rest in one line."""
    any_ = "|".join(f"(?:{p})" for p in patterns)
    return F.trim(F.array_join(F.filter(filled(F.split(text, "\n")), lambda x: ~x.rlike(any_)), " "))


def keep_case(original: Column, new: Column) -> Column:
    """new in the case of original: all capitals (of two letters or more), a capital first, or as it is."""
    capital = F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))
    return F.when((F.length(original) > 1) & original.rlike(r"^[^\p{Ll}]*$") & original.rlike(r"\p{Lu}"), F.upper(new)).when(original.rlike(r"^\p{Lu}"), capital).otherwise(new)


def elided(text: Column) -> tuple[Column, Column]:
    """Prefix letter and rest of an elided word; both empty if it isn't one."""
    return F.regexp_extract(text, ELIDED, 1), F.regexp_extract(text, ELIDED, 2)


def enclitic(text: Column) -> tuple[Column, Column]:
    """Core and enclitics of a word; both empty if it has none."""
    return F.regexp_extract(text, ENCLITIC, 1), F.regexp_extract(text, ENCLITIC, 2)


def lookup_word(token: Column) -> Column:
    """The word to look up: the token if it is letters, the part after an elided prefix, or null."""
    rest = F.regexp_extract(token, ELIDED, 2)
    return F.when(token.rlike(rf"^{LETTERS}$"), token).when(rest != "", rest)


def clean_answer(text: Column, labels: list[str]) -> Column:
    """Take labels, a first line that ends in a colon, and wrapping quotes off an answer."""
    c = F.trim(text)
    c = F.regexp_replace(c, r"^[^\n]*:[ \t]*\n+", "")
    c = F.regexp_replace(c, rf"(?i)^(?:{'|'.join(labels)})[ \t]*:[ \t]*", "")
    return F.trim(F.regexp_replace(c, r'^["«“](.*)["»”]$', "$1"))


def tld(host: Column) -> Column:
    """Last label of a host; ? if there is none."""
    last = F.element_at(F.split(host, r"\."), -1)
    return F.when(host.contains(".") & (last != ""), last).otherwise("?")


def ngrams(words: Column, most: int, least: int = 1) -> Column:
    """All n-grams of least to most words, joined by a blank."""

    def grams(w: Column) -> Column:
        one = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.concat(*[one(n) for n in range(least, most + 1)])

    # The words are bound to a variable, else they would be made anew for every n-gram.
    return F.transform(F.array(words), grams)[0]
