"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from kbspark.llm import (
    alignment, best_fit, exact_dedup, html_text, langid, lexical, lm, mixing, packing, pii, quality, sharding, simhash,
)

REGISTRY = {
    "op1_mix": mixing.op1_mix,
    "op2_simhash": simhash.op2_simhash,
    "op3_shard": sharding.op3_shard,
    "op4_language": langid.op4_language,
    "op5_pack": packing.op5_pack,
    "op6_quality": quality.op6_quality,
    "op7_lm_score": lm.op7_lm_score,
    "op8_main_text": html_text.op8_main_text,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_pii": pii.op10_pii,
    "op11_search": lexical.op11_search,
    "op12_align": alignment.op12_align,
    "op13_best_fit": best_fit.op13_best_fit,
}

ORACLES = {"op9_exact_dedup": exact_dedup.ORACLE_SQL, "op11_search": lexical.ORACLE_SQL}
