"""Queries of this subpackage, and the SQL to compare them with."""

from __future__ import annotations

from ranktide.llm import decontam, interplay, language, licences, lines, lm, mixing, neardup, privacy, quality, secrets, turns, urls

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_secrets": secrets.op2_secrets,
    "op3_lm_score": lm.op3_lm_score,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_surrogates": privacy.op5_surrogates,
    "op6_quality": quality.op6_quality,
    "op7_licence_scan": licences.op7_licence_scan,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_mixing": mixing.op10_mixing,
    "op11_url_filters": urls.op11_url_filters,
    "op12_turn_repair": turns.op12_turn_repair,
    "op13_filter_audit": interplay.op13_filter_audit,
}
ORACLE_SQL = {"op6_quality": quality.SQL, "op10_mixing": mixing.SQL, "op11_url_filters": urls.SQL, "op12_turn_repair": turns.SQL, "op13_filter_audit": interplay.SQL}
