"""The corpus queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, crosswalk, language, license, lines, mixing, packing, pii, quality, simhash, sketch, tokengroups, wavelet


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_packing": packing.op3_packing,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_license_scan": license.op5_license_scan,
        "op6_wavelet_ids": wavelet.op6_wavelet_ids,
        "op7_mixing": mixing.op7_mixing,
        "op8_bottom_k": sketch.op8_bottom_k,
        "op9_language_id": language.op9_language_id,
        "op10_pii_surrogates": pii.op10_pii_surrogates,
        "op11_ngram_join": tokengroups.op11_ngram_join,
        "op12_filter_audit": audit.op12_filter_audit,
        "op13_crosswalk": crosswalk.op13_crosswalk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality.OP4_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op11_ngram_join": tokengroups.op11_ngram_join,
        "op12_filter_audit": audit.OP12_SQL,
    }
