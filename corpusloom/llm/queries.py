"""The operators' registered queries and their SQL."""

from __future__ import annotations

from corpusloom.llm import (
    chat_format, embedding_dedup, hard_negatives, jaccard_join, language_id, license_scan, mixing, packing, piece_codec, quality_classifier, quality_rules, turn_repair, url_filter,
)

_MODULES = (quality_rules, quality_classifier, mixing, license_scan, packing, language_id, jaccard_join, chat_format, url_filter, embedding_dedup, piece_codec, hard_negatives, turn_repair)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
