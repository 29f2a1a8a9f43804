"""Small helpers that write DuckDB oracle SQL for repeated shapes."""

from __future__ import annotations

from collections.abc import Sequence


def with_views(body: str, **views: str) -> str:
    # MATERIALIZED: DuckDB may otherwise inline a CTE into every lambda call
    ctes = ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in views.items())
    return f"WITH {ctes}\n{body}"


def mode_cte(src: str, keys: Sequence[str], col: str, out: str) -> str:
    """Most frequent non-null value per group, ties to the smallest value."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    return (f"SELECT {k + ', ' if keys else ''}{col} AS {out} FROM ("
            f"SELECT {k + ', ' if keys else ''}{col}, row_number() OVER ({part} ORDER BY count(*) DESC, {col}) AS _rn "
            f"FROM {src} WHERE {col} IS NOT NULL GROUP BY {k + ', ' if keys else ''}{col}) WHERE _rn = 1")


def join_on(keys: Sequence[str], left: str, right: str) -> str:
    return " AND ".join(f"{left}.{k} IS NOT DISTINCT FROM {right}.{k}" for k in keys)
