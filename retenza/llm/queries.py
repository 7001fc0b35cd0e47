"""The registered corpus queries and their DuckDB statements."""

from __future__ import annotations

from . import (
    decontaminate, filter_audit, hilbert_shards, language_id, level_packing, line_dedup, line_quality, near_dup,
    packing, substring_dedup, token_align, token_files, url_filter)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_files": token_files.op2_token_files,
    "op3_quality_lines": line_quality.op3_quality_lines,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_hilbert_shards": hilbert_shards.op5_hilbert_shards,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_near_duplicates": near_dup.op7_near_duplicates,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_pack": packing.op9_pack,
    "op10_language_id": language_id.op10_language_id,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_level_packing": level_packing.op12_level_packing,
    "op13_token_align": token_align.op13_token_align,
}

ORACLE = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_quality_lines": line_quality.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
}
