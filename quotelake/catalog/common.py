"""Helpers for the registered queries and their oracle SQL."""

from __future__ import annotations

from ..plans.inputs import BARS_SQL, EXTERNAL_SQL, QUOTES_SQL

VIEWS = {"quotes": QUOTES_SQL, "bars": BARS_SQL, "external": EXTERNAL_SQL}


def with_views(names: str, *ctes: str, select: str) -> str:
    parts = [VIEWS[n] for n in names.split()] + list(ctes)
    head = "WITH RECURSIVE " + ",\n".join(parts) if parts else ""
    return f"{head}\n{select}"
