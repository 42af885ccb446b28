"""The queries of the library and their SQL; plan modules add to them when imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the tables of a folder, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Queries that were once held to a part of the rows; the names of their whole forms stay, and mean the same now.
WHOLE = [
    "lmd_01_ngram_counts", "lmd_02_log_probability", "lmd_03_prior", "lmd_04_lm_export", "lmd_08_detected", "lmd_09_candidate_texts",
    "lmd_06_decided", "lmd_10_applied", "lmd_11_grid", "nbc_01_slot_features", "nbc_03_train", "nbc_04_logodds",
    "nbc_05_balanced_accuracy", "nbc_06_informative", "nbc_02_labelled_examples", "nbc_07_choices", "nbc_08_gold_labels", "lmd_13_lemmatised",
    "lmd_14_mixed_scores", "lmd_15_fusion", "lmd_16_labelled_benchmark", "lmd_07_pos_veto", "lmd_05_scores", "lmd_12_prior_swapped",
    "dif_01_positional_ops", "dif_02_substitutions", "dif_05_context", "jon_15_explained", "prd_13_structural", "prd_14_strict_pairs",
    "jon_16_phenomena", "jon_17_text_phenomena", "jon_23_confirmed", "agg_29_rule_outcome", "met_01_exact", "met_05_evaluated",
    "agg_34_summary", "agg_35_by_group", "agg_36_leaderboard", "agg_37_judge_scores", "agg_38_error_classes", "jon_18_contrast",
    "agg_44_base_and_final", "dif_04_failed_items", "agg_42_pseudo_systems", "agg_43_points_by_type", "agg_40_layer_bookkeeping", "met_06_metric_rows",
    "src_11_frequency_table", "lex_01_invert", "lex_02_forward", "lex_03_lookup", "lex_04_one_to_one", "lex_05_collided",
    "lex_06_verb_collision", "lex_09_neutral", "lex_10_marker_index", "lex_11_homographs", "lex_12_noun_only", "lex_13_ambiguity_points",
    "lex_14_candidate_forms", "lex_15_mood_pairs", "lex_16_flag_within_file", "lex_17_merge_sources", "lex_18_difference", "lex_19_alternatives",
    "lex_20_labels", "lex_21_sense_groups", "lex_23_phrases", "lex_07_inverse_canonical", "lex_08_first_wins",
]


def load() -> None:
    from . import evaluation, index, lexicons, models, pairs, rewriting, selection, sources, text  # noqa: F401

    for name in WHOLE:
        query(f"{name}_whole", ORACLE_SQL.get(name))(QUERIES[name])
