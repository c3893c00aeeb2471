"""The registered queries of this package and their DuckDB twins."""

from __future__ import annotations

from thalweg.llm import bpe, factorisation, html_text, imatch, langid, mixing, neardup, quality_rules, secret_scan, toxicity


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_mixing": mixing.op2_mixing,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_secrets": secret_scan.op5_secrets,
        "op7_imatch": imatch.op7_imatch,
        "op3_toxicity": toxicity.op3_toxicity,
        "op6_quality": factorisation.op6_quality,
        "op8_neardup": neardup.op8_neardup,
        "op9_html": html_text.op9_html,
        "op10_language": langid.op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.OP2_SQL, "op4_quality_rules": quality_rules.OP4_SQL, "op8_neardup": neardup.OP8_SQL}
