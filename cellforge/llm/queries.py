"""The queries of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellforge.llm import decontaminate, embedding, language, license_scan, pieces, pii, simhash, suffix_array, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op7_simhash": simhash.op7_simhash,
        "op10_suffix_array": suffix_array.op10_suffix_array,
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_pii": pii.op2_pii,
        "op3_embedding": embedding.op3_embedding,
        "op4_license": license_scan.op4_license,
        "op5_pieces": pieces.op5_pieces,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op8_token_files": token_files.op8_token_files,
        "op9_language": language.op9_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding": embedding.ORACLE_SQL, "op6_decontaminate": decontaminate.ORACLE_SQL}
