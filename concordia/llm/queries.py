"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concordia.llm import exact_dedup, fingerprint, intervals, language, licenses, mixing, packing, personal, prefix_trie, simhash_dedup, suffix_dedup, toxicity, window_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprint": fingerprint.op1_fingerprint,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_language_id": language.op5_language_id,
        "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
        "op7_packing": packing.op7_packing,
        "op8_substring_dedup": window_dedup.op8_substring_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op10_personal_data": personal.op10_personal_data,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_interval_join": intervals.op12_interval_join,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.SQL, "op9_mixing": mixing.SQL, "op11_prefix_trie": prefix_trie.SQL, "op12_interval_join": intervals.SQL}
