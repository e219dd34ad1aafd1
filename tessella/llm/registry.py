"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessella.llm import ann, chat, decontam, jaccard, lm, media, mixing, negatives, phrases, quality, tokenbin, urls, warc


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_mixing": mixing.op2_mixing,
        "op3_warc": warc.op3_warc,
        "op4_jaccard": jaccard.op4_jaccard,
        "op5_nearest": ann.op5_nearest,
        "op6_lm_score": lm.op6_lm_score,
        "op7_token_output": tokenbin.op7_token_output,
        "op8_quality": quality.op8_quality,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_url_filter": urls.op10_url_filter,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_collocations": phrases.op12_collocations,
        "op13_media": media.op13_media,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.OP1_SQL,
        "op2_mixing": mixing.OP2_SQL,
        "op3_warc": warc.OP3_SQL,
        "op9_decontamination": decontam.OP9_SQL,
        "op11_hard_negatives": negatives.OP11_SQL,
        "op12_collocations": phrases.OP12_SQL,
    }
