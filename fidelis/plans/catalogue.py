"""All registered queries and their SQL."""

from __future__ import annotations

from fidelis.plans import expressions, fits, learning, measures

MODULES = [expressions, measures, fits, learning]


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
