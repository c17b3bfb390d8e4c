"""All queries outside the llm subpackage."""

from __future__ import annotations

from mnemospark.plans import belief, experience, graph, orphans, rendering, tables, text

_MODULES = [text, belief, graph, experience, rendering, orphans, tables]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
