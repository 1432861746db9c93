"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module of this package that holds it.
MODULES = {
    "op1_packing": "packing",
    "op2_suffix_dedup": "suffixes",
    "op3_language_id": "langid",
    "op4_embedding_dedup": "embeddings",
    "op5_quality_classifier": "quality",
    "op6_mixing": "mixing",
    "op7_token_counts": "token_counts",
    "op8_minhash_dedup": "minhash",
    "op9_media_columns": "media",
    "op10_license_scan": "licenses",
    "op11_byte_bpe": "byte_bpe",
    "op12_spelling_variants": "spelling",
    "op13_prefix_trie": "conversations",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"atlasframe.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"atlasframe.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
