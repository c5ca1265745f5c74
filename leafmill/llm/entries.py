"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, html_extract, language_id, lm_scoring, mixing, prefix_trie, quality_rules, simhash_dedup, spelling, substring_dedup, token_output, warc


def queries() -> dict:
    found = [
        lm_scoring.op1_lm_scoring,
        html_extract.op2_html_extraction,
        decontaminate.op3_benchmark_decontamination,
        quality_rules.op4_quality_rules,
        mixing.op5_source_mixing,
        language_id.op6_language_id,
        token_output.op7_token_output,
        chat_format.op8_chat_formatting,
        simhash_dedup.op9_simhash_near_dedup,
        substring_dedup.op10_substring_dedup,
        warc.op11_warc,
        prefix_trie.op12_prefix_trie,
        spelling.op13_spelling_variants,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {**decontaminate.ORACLE, **chat_format.ORACLE, **substring_dedup.ORACLE, **warc.ORACLE, **prefix_trie.ORACLE}
