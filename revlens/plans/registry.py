"""Registry of named queries.

Each entry is a Spark job ``(spark, sf_dir) -> DataFrame`` over the given
tables plus, where the result is expressible in SQL, an oracle SQL string
DuckDB runs on the same parquet files.  Double columns are rounded to six
decimals on both sides (engines differ in the last float digits).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from revlens.functions.stats import round_doubles


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def round_sql(sql: str, dbl: Sequence[str]) -> str:
    if not dbl:
        return sql
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in dbl)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


def register(name: str, sql: str | None = None, dbl: Sequence[str] = ()):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), 6)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, run, round_sql(sql, dbl) if sql else None)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules fills the registry
    from revlens.plans import (q_explore, q_features, q_full, q_io, q_metrics, q_models, q_prep,  # noqa: F401
                               q_quality, q_reports, q_stream)
    return REGISTRY
