"""The registered queries: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "quality_queries", "time_queries", "rule_queries", "ledger_queries", "evidence_queries", "registry_queries", "quote_queries", "stream_queries",
)


def registered() -> dict:
    found: dict = {}
    for m in MODULES:
        for name, entry in import_module(f"{__name__}.{m}").QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = entry
    return found
