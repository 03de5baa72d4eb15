"""Queries and SQL of this subpackage, by the names that ``__spark_entry__`` gives them."""

from __future__ import annotations

from . import exact_dedup, exact_topk, hard_negatives, language_id, mixing, packing, pii, quality, secret_scan, simhash, spelling, token_store, url_filter


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_mixing": mixing.op2_mixing,
        "op3_exact_topk": exact_topk.op3_exact_topk,
        "op4_packing": packing.op4_packing,
        "op5_simhash": simhash.op5_simhash,
        "op6_secrets": secret_scan.op6_secrets,
        "op7_quality": quality.op7_quality,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_language_id": language_id.op9_language_id,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_token_ids": token_store.op12_token_ids,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return exact_dedup.SQL | exact_topk.SQL | url_filter.SQL | hard_negatives.SQL
