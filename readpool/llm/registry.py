"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from readpool.llm import chat, jaccard, langid, linededup, media, mixing, oracles, pieces, suffixdedup, topk, toxicity

QUERIES = {f.__name__: f for f in (media.op1_media_columns, chat.op2_chat_formatting, langid.op3_language_id, suffixdedup.op4_suffix_dedup, linededup.op5_line_dedup, toxicity.op6_toxicity, pieces.op7_sentencepiece, mixing.op8_mixing, jaccard.op9_jaccard_join, topk.op10_topk_search)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": chat.OP2_SQL,
        "op4_suffix_dedup": oracles.OP4_SQL,
        "op5_line_dedup": oracles.OP5_SQL,
        "op8_mixing": oracles.OP8_SQL,
        "op9_jaccard_join": oracles.OP9_SQL,
        "op10_topk_search": topk.OP10_SQL,
    }
