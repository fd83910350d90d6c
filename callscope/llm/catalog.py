"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from callscope.llm import audit, bpe, chat, collocations, hosts, lcp, licences, mixing, pii, quality, rules, simhash, tokens

QUERIES = {
    "op1_license_scan": licences.query,
    "op2_document_fingerprints": lcp.query,
    "op3_quality_classifier": quality.query,
    "op4_token_output": tokens.query,
    "op5_source_mixing": mixing.query,
    "op6_pii_sanitisation": pii.query,
    "op7_bpe_codec": bpe.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_chat_formatting": chat.query,
    "op10_quality_rules": rules.query,
    "op11_url_filters": hosts.query,
    "op12_phrase_collocations": collocations.query,
    "op13_filter_audit": audit.query,
}

ORACLE_SQL = {
    "op5_source_mixing": mixing.SQL,
    "op9_chat_formatting": chat.SQL,
    "op10_quality_rules": rules.SQL,
    "op11_url_filters": hosts.SQL,
    "op12_phrase_collocations": collocations.SQL,
    "op13_filter_audit": audit.SQL,
}
