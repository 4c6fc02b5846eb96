"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, language_id, maxent_lm, minhash, packing, pair_bpe, quality_rules, resampling, secret_scan, spelling, suffix_dedup, token_counts, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_token_store": token_store.query,
        "op3_pair_bpe": pair_bpe.query,
        "op4_suffix_dedup": suffix_dedup.query,
        "op5_language_id": language_id.query,
        "op6_maxent_lm": maxent_lm.query,
        "op7_token_counts": token_counts.query,
        "op8_packing": packing.query,
        "op9_minhash": minhash.query,
        "op10_fingerprints": fingerprints.query,
        "op11_spelling": spelling.query,
        "op12_secret_scan": secret_scan.query,
        "op13_resampling": resampling.query,
        "language_id_pages": language_id.pages_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE_SQL,
        "op11_spelling": spelling.ORACLE_SQL,
        "op12_secret_scan": secret_scan.ORACLE_SQL,
        "op13_resampling": resampling.ORACLE_SQL,
    }
