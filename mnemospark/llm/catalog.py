"""All queries of the subpackage."""

from __future__ import annotations

from mnemospark.llm import queries_conversations, queries_encode, queries_mixing, queries_neardup, queries_overlap, queries_pii, queries_reading

_MODULES = [queries_overlap, queries_pii, queries_neardup, queries_conversations, queries_encode, queries_mixing, queries_reading]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
