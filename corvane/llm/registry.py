"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, bwt_dedup, chat, fill_middle, html_text, jaccard, line_dedup, mixing, multi_index, quality, spelling, token_files, unit_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_chat_format": chat.op2_chat_format,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_multi_index": multi_index.op4_multi_index,
    "op5_unit_dedup": unit_dedup.op5_unit_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_bwt_dedup": bwt_dedup.op8_bwt_dedup,
    "op9_html_text": html_text.op9_html_text,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_token_files": token_files.op12_token_files,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLE: dict[str, str] = {"op1_mix_sources": mixing.ORACLE, "op2_chat_format": chat.ORACLE, "op5_unit_dedup": unit_dedup.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
