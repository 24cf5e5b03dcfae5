"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from quillgraph.llm import chat, fingerprints, jaccard, language, media, mixing, packing, pii, quality, toxicity

QUERIES = {
    "op1_progressive_jpeg": media.op1_progressive_jpeg,
    "op2_language_id": language.op2_language_id,
    "op3_pii": pii.op3_pii,
    "op4_toxicity": toxicity.op4_toxicity,
    "op10_best_fit": packing.op10_best_fit,
    "op5_imatch": fingerprints.op5_imatch,
    "op6_quality": quality.op6_quality,
    "op7_chat_format": chat.op7_chat_format,
    "op8_systematic_mix": mixing.op8_systematic_mix,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
}
ORACLE_SQL = {"op8_systematic_mix": mixing.ORACLE}
