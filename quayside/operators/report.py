"""A readiness report as Markdown, from frames of a few rows each."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, limit: int | None = None) -> str:
    """All rows of a frame that is one row per group, in the caller's order; with a limit, a last line says how many of them."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.collect() if limit is None else df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    shown = [] if limit is None or len(rows) < limit else [f"\n{len(rows)} of {df.count()} rows"]
    return "\n".join([*lines, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows], *shown])


def render(title: str, gates: DataFrame, coverage: DataFrame, work: DataFrame, checks: DataFrame, notes: DataFrame) -> str:
    state = {r["gate"]: r["state"] for r in gates.collect()}
    parts = [f"# {title}", f"Verdict: **{state.get('verdict', 'unknown')}**"]
    for name, df in (("Gates", gates.where("gate <> 'verdict'").orderBy("gate")), ("Coverage", coverage.orderBy("entity")), ("Work", work), ("Checks", checks.orderBy("entity", "check")), ("What was normalized", notes)):
        parts.append(f"## {name}\n\n{table(df)}")
    return "\n\n".join(parts) + "\n"
