"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from quarry.llm import decontaminate, exact_dedup, html_text, jaccard_join, lm_score, lz_fingerprint, mixing, quality, sharding, token_align, token_files, vector_codes, warc

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_sharding": sharding.op2_sharding,
    "op3_mixing": mixing.op3_mixing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_html_text": html_text.op5_html_text,
    "op6_token_files": token_files.op6_token_files,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_quality": quality.op9_quality,
    "op10_warc": warc.op10_warc,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_lz_fingerprint": lz_fingerprint.op12_lz_fingerprint,
    "op13_token_align": token_align.op13_token_align,
}

ORACLE_SQL = {"op4_exact_dedup": exact_dedup.OP4_SQL, "op11_vector_codes": vector_codes.OP11_SQL}
