"""The corpus operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chats, decontaminate, langid, licenses, linededup, media, merkle, neardup, quantize, repeats, toxicity, urls

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_media": media.op2,
    "op3_toxicity": toxicity.op3,
    "op4_licenses": licenses.op4,
    "op5_bpe": bpe.op5,
    "op6_line_dedup": linededup.op6,
    "op7_near_duplicates": neardup.op7,
    "op8_url_filter": urls.op8,
    "op9_language": langid.op9,
    "op10_chat_format": chats.op10,
    "op11_merkle": merkle.op11,
    "op12_repeats": repeats.op12,
    "op13_quantize": quantize.op13,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op6_line_dedup": linededup.OP6_SQL,
    "op10_chat_format": chats.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_repeats": repeats.OP12_SQL,
    "op13_quantize": quantize.OP13_SQL,
}
