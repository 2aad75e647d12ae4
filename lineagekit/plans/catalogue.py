"""The query catalogue: every query by name, and its SQL for an independent engine."""

from __future__ import annotations

from . import graph, knowledge, linking, matching, meaning, pages, quantity

MODULES = (quantity, meaning, linking, matching, knowledge, graph, pages)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
