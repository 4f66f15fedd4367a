"""All queries of this package, and SQL that DuckDB can run for the same rows."""

from __future__ import annotations

from cartulary.llm import archives, chat, decontaminate, digests, hard_negatives, host_rules, line_dedup, minhash, mixing, packing, quality, runs, substring_dedup

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_archives": archives.op4_archives,
    "op6_near_duplicates": minhash.op6_near_duplicates,
    "op5_chat": chat.op5_chat,
    "op7_packing": packing.op7_packing,
    "op8_mixing": mixing.op8_mixing,
    "op9_host_rules": host_rules.op9_host_rules,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_fingerprints": digests.op11_fingerprints,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

SQL = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op4_archives": archives.OP4_SQL,
    "op5_chat": chat.OP5_SQL,
    "op6_near_duplicates": minhash.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_host_rules": host_rules.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_periodic_runs": runs.OP13_SQL,
}
