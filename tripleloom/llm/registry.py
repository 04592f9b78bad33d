"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import (
    context_tree,
    decontamination,
    html_extraction,
    language_id,
    mixing,
    quality,
    sharding,
    simhash,
    toxicity,
    url_filter,
)


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_simhash": simhash.op2_simhash,
        "op3_context_tree": context_tree.op3_context_tree,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_language_id": language_id.op5_language_id,
        "op6_html_extraction": html_extraction.op6_html_extraction,
        "op7_shard_documents": sharding.op7_shard_documents,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_decontaminate": decontamination.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_decontaminate": decontamination.OP10_SQL}
