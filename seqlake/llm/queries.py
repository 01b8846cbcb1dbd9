"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, licences, line_templates, minhash, mixing, sanitise, token_store, topk, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_toxicity": toxicity.query,
    "op3_topk_search": topk.query,
    "op4_order_minhash": minhash.query,
    "op5_token_store": token_store.query,
    "op6_pii_sanitise": sanitise.query,
    "op7_url_filter": url_filter.query,
    "op8_decontaminate": decontaminate.query,
    "op9_licences": licences.query,
    "op10_line_templates": line_templates.query,
}
SQL = {
    "op3_topk_search": topk.sql,
    "op7_url_filter": url_filter.sql,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: f() for k, f in SQL.items()}
