"""Registry of this subpackage's queries; a module per operator."""

from __future__ import annotations

from tessera.llm import caps, chat, gru, jaccard, ledger, mixture, pieces, quality, runs, spelling, tokenfiles, toxicity, urlfilter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_token_files": tokenfiles.op2_token_files,
    "op3_chat": chat.op3_chat,
    "op4_gru": gru.op4_gru,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_mixture": mixture.op6_mixture,
    "op7_quality_cascade": quality.op7_quality_cascade,
    "op8_urls": urlfilter.op8_urls,
    "op9_cap_filters": caps.op9_cap_filters,
    "op10_pieces": pieces.op10_pieces,
    "op11_blob_ledger": ledger.op11_blob_ledger,
    "op12_letter_parity": spelling.op12_letter_parity,
    "op13_runs": runs.op13_runs,
    "jaccard_links": jaccard.jaccard_links,
}

ORACLE = {
    "op3_chat": chat.OP3_SQL,
    "op5_jaccard_join": jaccard.OP5_SQL,
    "op6_mixture": mixture.OP6_SQL,
    "op7_quality_cascade": quality.OP7_SQL,
    "op9_cap_filters": caps.OP9_SQL,
    "op11_blob_ledger": ledger.OP11_SQL,
    "op12_letter_parity": spelling.OP12_SQL,
    "op13_runs": runs.OP13_SQL,
    "jaccard_links": jaccard.LINKS_SQL,
}
