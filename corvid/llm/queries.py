"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from corvid.llm import alignment, chat, embeddings, licences, mixing, packing, personal, quality, simhash, spelling, substrings, tokens, toxicity

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_packing": packing.op2_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_compression": quality.op5_quality_compression,
    "op6_embedding_dedup": embeddings.op6_embedding_dedup,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_licence_scan": licences.op10_licence_scan,
    "op11_spelling_groups": spelling.op11_spelling_groups,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_personal_data": personal.op13_personal_data,
}
ORACLES = {"op1_chat_format": chat.SQL, "op6_embedding_dedup": embeddings.SQL, "op8_substring_dedup": substrings.SQL, "op10_licence_scan": licences.SQL, "op11_spelling_groups": spelling.SQL}
