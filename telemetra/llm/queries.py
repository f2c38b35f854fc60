"""The named queries of this folder, their SQL answers, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telemetra.llm import chat, decontaminate, dedup, divergence, hilbert, language, licenses, mixing, packing, quality, secrets, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack": packing.op1_pack,
        "op2_context_mixing": mixing.op2_context_mixing,
        "op3_typed_parts": chat.op3_typed_parts,
        "op4_levenshtein": toxicity.op4_levenshtein,
        "op5_minhash": dedup.op5_minhash,
        "op6_language_bitmask": language.op6_language_bitmask,
        "op7_entropy_windows": secrets.op7_entropy_windows,
        "op8_isolation_forest": quality.op8_isolation_forest,
        "op9_aho_corasick": decontaminate.op9_aho_corasick,
        "op10_hilbert": hilbert.op10_hilbert,
        "op11_polarisation": whitening.op11_polarisation,
        "op12_spimi": divergence.op12_spimi,
        "op13_template_automata": licenses.op13_template_automata,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_typed_parts": chat.OP3_SQL,
        "op5_minhash": dedup.OP5_SQL,
        "op9_aho_corasick": decontaminate.OP9_SQL,
        "op12_spimi": divergence.OP12_SQL,
    }
