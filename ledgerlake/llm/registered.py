"""The queries of this folder and their oracle SQL, as __spark_entry__ adds them."""

from __future__ import annotations

from ledgerlake.llm import chat, decontaminate, language, linededup, mixing, neardup, periodic, pii, quality, ranked, secret_scan, token_trees, tokenfile


def queries() -> dict:
    return {
        "op1_token_counts": token_trees.op1_token_counts,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_token_files": tokenfile.op3_token_files,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_near_duplicates": neardup.op5_near_duplicates,
        "op6_pii": pii.op6_pii,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_language_id": language.op8_language_id,
        "op9_mixing": mixing.op9_mixing,
        "op10_secret_scans": secret_scan.op10_secret_scans,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_line_dedup": linededup.op12_line_dedup,
        "op13_ranked_search": ranked.op13_ranked_search,
    }


def oracle_sql() -> dict:
    return {
        "op2_quality_rules": quality.OP2_SQL,
        "op4_decontamination": decontaminate.OP4_SQL,
        "op7_chat_formatting": chat.OP7_SQL,
        "op9_mixing": mixing.OP9_SQL,
        "op11_periodic_runs": periodic.OP11_SQL,
        "op12_line_dedup": linededup.OP12_SQL,
        "op13_ranked_search": ranked.OP13_SQL,
    }
