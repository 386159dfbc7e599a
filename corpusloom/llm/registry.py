"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import chat_format, decontaminate, fingerprint, hard_negatives, html_extract, lang_id, quality_rules, secret_scan, sentencepiece_bpe, simhash, substring_dedup, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": html_extract.query,
        "op2_lang_id": lang_id.query,
        "op3_sentencepiece": sentencepiece_bpe.query,
        "op4_secret_scan": secret_scan.query,
        "op5_chat_format": chat_format.query,
        "op6_decontaminate": decontaminate.query,
        "op7_simhash": simhash.query,
        "op8_substring_dedup": substring_dedup.query,
        "op9_toxicity": toxicity.query,
        "op10_fingerprint": fingerprint.query,
        "op11_vector_codes": vector_codes.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_quality_rules": quality_rules.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat_format.SQL, "op11_vector_codes": vector_codes.SQL, "op12_hard_negatives": hard_negatives.SQL}
