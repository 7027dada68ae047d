"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from termloom.llm import chat_format, decontaminate, language_id, media, mixing, quality, simhash, substring_dedup, token_counts, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_mixing": mixing.op4_mixing,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality": quality.op7_quality,
    "op8_warc": warc.op8_warc,
    "op9_media": media.op9_media,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op8_warc": warc.ORACLE,
}
