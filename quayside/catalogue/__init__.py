"""Queries over the driver's tables, each with the SQL that states the same."""

from __future__ import annotations

from quayside.catalogue import converting, outcomes, profiling, records

MODULES = (profiling, converting, records, outcomes)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
