"""Queries and SQL of the subpackage."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, conversation_trie, decontaminate, hard_negatives, language_id, mixing, near_dups, privacy, quality_model, quality_rules, substrings, token_counts, warc

_MODULES = (privacy, warc, decontaminate, quality_rules, substrings, language_id, mixing, quality_model, near_dups, token_counts, conversation_trie, hard_negatives, bpe)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
