"""Queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.ship import shipped
from plumbline.llm import exact_dedup, hamming_search, html_extract, jaccard_join, language_model, mixing, packing, secrets, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        "op1_substring_dedup": substring_dedup.query,
        "op2_toxicity": toxicity.query,
        "op3_mixing": mixing.query,
        "op4_jaccard_join": jaccard_join.query,
        "op5_html_extract": html_extract.query,
        "op6_language_model": language_model.query,
        "op7_secrets": secrets.query,
        "op8_packing": packing.query,
        "op9_exact_dedup": exact_dedup.query,
        "op10_hamming_search": hamming_search.query,
    }
    return {name: shipped(fn) for name, fn in own.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.SQL,
        "op4_jaccard_join": jaccard_join.SQL,
        "op9_exact_dedup": exact_dedup.SQL,
        "op10_hamming_search": hamming_search.SQL,
    }
