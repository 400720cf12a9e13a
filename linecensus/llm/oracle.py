"""DuckDB statements of the queries that SQL can express; the others have brute-force tests."""

from __future__ import annotations

from linecensus.llm.exact_dedup import OP10_SQL


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL}
