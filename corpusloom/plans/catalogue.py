"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from corpusloom.plans import audits, comparisons, compositions, geography, inference, labelling, lineages, records, rows, storage, trees

_MODULES = (compositions, geography, inference, records, trees, labelling, audits, lineages, rows, comparisons, storage)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
