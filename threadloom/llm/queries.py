"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audit, bpe, chat, html, jaccard, licenses, mixing, quality, search, suffix, tiff, toxicity, urls

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_tiff": tiff.op2_tiff,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality": quality.op6_quality,
    "op7_licenses": licenses.op7_licenses,
    "op8_html": html.op8_html,
    "op9_suffix": suffix.op9_suffix,
    "op10_bpe": bpe.op10_bpe,
    "op11_urls": urls.op11_urls,
    "op12_search": search.op12_search,
    "op13_audit": audit.op13_audit,
}
ORACLES = {
    "op1_chat": chat.OP1_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_quality": quality.OP6_SQL,
    "op7_licenses": licenses.OP7_SQL,
    "op11_urls": urls.OP11_SQL,
    "op12_search": search.OP12_SQL,
    "op13_audit": audit.OP13_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
