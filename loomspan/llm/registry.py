"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, packing, pii, quality, search, secrets, simhash, substrings, token_counts, token_files, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        quality.op1_quality,
        packing.op2_packing,
        pii.op3_pii,
        toxicity.op4_toxicity,
        substrings.op5_substring_dedup,
        search.op6_top_k,
        simhash.op7_simhash,
        token_files.op8_token_files,
        decontaminate.op9_decontamination,
        secrets.op10_secrets,
        token_counts.op11_token_counts,
        whitening.op12_whitening,
        conversations.op13_conversation_repair,
    )
}
ORACLE_SQL: dict[str, str] = {"op5_substring_dedup": substrings.OP5_SQL, "op6_top_k": search.OP6_SQL}
