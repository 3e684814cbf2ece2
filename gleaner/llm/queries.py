"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from gleaner.llm import mixing, neighbours, packing, passages, pii, quality, repair, simhash, urls, wordpiece

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_pii": pii.op2_pii,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_token_output": repair.op4_token_output,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_url_filter": urls.op8_url_filter,
    "op9_token_counts": wordpiece.op9_token_counts,
    "op10_substring_dedup": passages.op10_substring_dedup,
}

ORACLE_SQL = {"op7_quality_rules": quality.ORACLE_SQL, "op8_url_filter": urls.ORACLE_SQL}
