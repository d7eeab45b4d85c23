"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontaminate, kneser_ney, language_id, near_dedup, prefix_trie, quality_rules, secret_scan, spelling_variants, substring_dedup, token_count, toxicity

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_near_dedup": near_dedup.query,
    "op4_chat_format": chat_format.query,
    "op5_byte_bpe": byte_bpe.query,
    "op6_token_count": token_count.query,
    "op7_language_id": language_id.query,
    "op8_toxicity": toxicity.query,
    "op9_decontaminate": decontaminate.query,
    "op10_quality_rules": quality_rules.query,
    "op11_kneser_ney": kneser_ney.query,
    "op12_spelling_variants": spelling_variants.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": secret_scan.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op4_chat_format": chat_format.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_kneser_ney": kneser_ney.SQL,
    "op12_spelling_variants": spelling_variants.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
