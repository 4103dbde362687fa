"""Every query of the library by name, with the SQL that says the same."""

from __future__ import annotations

from waygrid.plans import classic_queries, match_queries, report_queries, track_queries

MODULES = (track_queries, match_queries, report_queries, classic_queries)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
