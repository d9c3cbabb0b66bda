"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, html, infill, jpeg, language, minhash, pieces, pii, prefixes, quality, sharding, substrings, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1,
        "op2_token_store": tokens.op2,
        "op3_sentencepiece": pieces.op3,
        "op4_progressive_jpeg": jpeg.op4,
        "op5_quality": quality.op5,
        "op6_minhash": minhash.op6,
        "op7_decontaminate": decontaminate.op7,
        "op8_html_main_text": html.op8,
        "op9_substring_dedup": substrings.op9,
        "op10_language_id": language.op10,
        "op11_prefix_trie": prefixes.op11,
        "op12_feistel_shards": sharding.op12,
        "op13_fill_in_middle": infill.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": prefixes.ORACLE_SQL, "op12_feistel_shards": sharding.ORACLE_SQL, "op13_fill_in_middle": infill.ORACLE_SQL}
