"""The registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, fingerprint, hardneg, htmltext, language, linedup, merkle, mixing, neardup, packing, quality, sharding

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_mixing": mixing.op2_mixing,
    "op3_line_dedup": linedup.op3_line_dedup,
    "op4_quality": quality.op4_quality,
    "op5_html_text": htmltext.op5_html_text,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_fingerprint": fingerprint.op7_fingerprint,
    "op8_sharding": sharding.op8_sharding,
    "op9_chat": chat.op9_chat,
    "op10_language": language.op10_language,
    "op11_packing": packing.op11_packing,
    "op12_merkle": merkle.op12_merkle,
    "op13_hard_negatives": hardneg.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": linedup.OP3_SQL,
    "op9_chat": chat.OP9_SQL,
    "op12_merkle": merkle.OP12_SQL,
    "op13_hard_negatives": hardneg.OP13_SQL,
}
