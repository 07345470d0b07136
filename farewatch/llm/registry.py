"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import conversations, decontaminate, fingerprints, html_extract, language_id, line_rules, mixing, ngram_join, periodic, pii, quality, token_store, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_quality": quality.op4_quality,
    "op5_pii_surrogates": pii.op5_pii_surrogates,
    "op6_token_store": token_store.op6_token_store,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_line_rules": line_rules.op8_line_rules,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE = {
    "op2_decontamination": decontaminate.ORACLE,
    "op8_line_rules": line_rules.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_conversation_repair": conversations.ORACLE,
}
