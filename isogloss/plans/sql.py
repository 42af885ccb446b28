"""Pieces of DuckDB SQL that stand for the library's expressions."""

from __future__ import annotations

from ..functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def find(expr: str, pattern: str) -> str:
    """All matches of a pattern without look-arounds, as a list."""
    return f"regexp_extract_all({expr}, {lit(pattern)})"


def sub(expr: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, '{flags}')"


def tokens(expr: str) -> str:
    return find(f"lower({expr})", T.WORDS)


def bare(expr: str) -> str:
    return find(f"lower({expr})", T.LETTERS)


def fold(expr: str) -> str:
    return f"translate({expr}, {lit(T.APOSTROPHES)}, {lit(chr(39) * len(T.APOSTROPHES))})"


def pair_tokens(expr: str) -> str:
    return find(fold(f"lower({expr})"), T.PAIR_WORDS)


def repeat_text(expr: str) -> str:
    return f"array_to_string({find(sub(f'lower({expr})', '[0-9]+', ''), T.WORDS)}, ' ')"


def marked(expr: str, after: str) -> str:
    """Break after a closing mark and blanks where `after` (a class) follows; as a list."""
    return f"string_split(regexp_replace({expr}, {lit('([.!?])[ \\t\\n\\x0B\\f\\r]+(' + after + ')')}, '\\1' || chr(1) || '\\2', 'g'), chr(1))"


def sentences(expr: str) -> str:
    return marked(expr, '[«"“A-ZÀ-Ý]')


def trim(expr: str) -> str:
    return f"trim({expr})"


#: Sentences of documents: doc_id, lang, source, sent_no, text.
SENT = f"sent AS (SELECT doc_id, lang, source, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS sent_no FROM (SELECT doc_id, lang, source, {sentences('text')} AS p FROM documents))"
#: Distinct turn pairs of conversations: id, a, b.
PAIR = "pair AS (SELECT conv_id * 1000000000 + x.turn AS id, x.text AS a, y.text AS b FROM conversations x JOIN conversations y USING (conv_id) WHERE y.turn = x.turn + 1)"
