"""The registered queries and, where SQL can say the same, the SQL to compare them with."""

from __future__ import annotations

from veritrim.catalog import grouped, preparation, prompts, scoring

_PARTS = (grouped, preparation, prompts, scoring)

QUERIES = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
WITHOUT_SQL = prompts.WITHOUT_SQL
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
