"""The corpus queries by name, with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lakeloom.llm import bpe, decontaminate, lexical_search, license_scan, mixing, near_dedup, order_minhash, quality, secret_scan, suffix_dedup, toxicity, url_reputation, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": secret_scan.op1_secret_scans,
        "op2_license_scans": license_scan.op2_license_scans,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_quality": quality.op5_quality,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_order_minhash": order_minhash.op7_order_minhash,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_url_filters": url_reputation.op9_url_filters,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_whitening": whitening.op11_whitening,
        "op12_mixing": mixing.op12_mixing,
        "op13_lexical_search": lexical_search.op13_lexical_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    piped = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return piped | {
        "op1_secret_scans": secret_scan.SQL,
        "op2_license_scans": license_scan.SQL,
        "op6_decontaminate": decontaminate.SQL,
        "op10_near_dedup": near_dedup.SQL,
        "op13_lexical_search": lexical_search.SQL,
    }
