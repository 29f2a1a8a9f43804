"""Aggregation building blocks that stay safe under skew and high cardinality.

``grouped_modes`` and ``grouped_distinct_counts`` avoid Spark's built-in
``mode``/``count(DISTINCT)`` buffers: those keep one in-memory map of all
distinct values per group, which for a hot group (a category holding a
third of all rows, or a timestamp column with billions of distinct values)
lands in one task and cannot spill.  Here every measure becomes a
(group, value) histogram first -- a normal hash aggregation with map-side
partial combine that spills -- and the per-group answer is picked from the
histogram in a second aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL keys match each other (pandas groupby
    semantics); output carries each key once."""
    if not keys:
        return left.crossJoin(right)  # one-row aggregates only
    r = right.select([F.col(k).alias(f"__r_{k}") for k in keys]
                     + [c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def _histogram(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, v_0..v_n, _cnt): one row per group and distinct value of each
    column; exactly one v_i is set per row."""
    entries = []
    for i, c in enumerate(columns):
        fields = [(F.col(c) if j == i else F.lit(None).cast(df.schema[cj].dataType)).alias(f"v_{j}")
                  for j, cj in enumerate(columns)]
        entries.append(F.struct(*fields))
    long = (df.select(*keys, F.explode(F.array(*entries)).alias("_e"))
              .select(*keys, "_e.*"))
    present = None
    for j in range(len(columns)):
        cond = F.col(f"v_{j}").isNotNull()
        present = cond if present is None else (present | cond)
    return (long.where(present)
                .groupBy(*keys, *[f"v_{j}" for j in range(len(columns))])
                .agg(F.count(F.lit(1)).alias("_cnt")))


def grouped_modes_and_distincts(df: DataFrame, keys: Sequence[str],
                                mode_cols: dict[str, str],
                                distinct_cols: dict[str, str]) -> DataFrame:
    """Per group: the most frequent non-null value of each ``mode_cols``
    column (ties -> smallest value) and the number of distinct non-null
    values of each ``distinct_cols`` column, in one histogram pass.

    ``mode_cols`` / ``distinct_cols`` map output name -> input column.
    """
    cols = list(mode_cols.values()) + list(distinct_cols.values())
    hist = _histogram(df, keys, cols)
    aggs = []
    for i, (out, _c) in enumerate(mode_cols.items()):
        v = F.col(f"v_{i}")
        order = F.when(v.isNotNull(), F.struct((-F.col("_cnt")).alias("n"), v.alias("v")))
        aggs.append(F.min_by(v, order).alias(out))
    off = len(mode_cols)
    for i, (out, _c) in enumerate(distinct_cols.items()):
        aggs.append(F.count(F.col(f"v_{off + i}")).alias(out))
    return hist.groupBy(*keys).agg(*aggs)


#: Rows of a task, in the mean, of steps that keep values in memory; larger tables get more tasks.
TASK_ROWS = 500_000


def spread(df: DataFrame, columns: Sequence[str], rows: int | None, task_rows: int) -> DataFrame:
    """``df`` in tasks of ``task_rows`` rows by ``columns``, where the session's
    number of partitions would make them larger: a task's memory must not grow
    with the table."""
    tasks = -(-(rows or 0) // task_rows)
    return df.repartition(tasks, *columns) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def value_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """(keys, _tag, v_0..v_n, _cnt): one row per group and value of each
    column, nulls included; ``_tag`` is the column's place and only its v is
    set.  The counts of any one tag add up to the group's rows.  ``rows`` (of
    ``df``, counted if not given) tells the tasks of the first counting."""
    names = list(dict.fromkeys([*keys, *columns]))
    df = spread(df.select(*names), names, df.count() if rows is None else rows, TASK_ROWS)
    entries = []
    for i, c in enumerate(columns):
        fields = [(F.col(c) if j == i else F.lit(None).cast(df.schema[cj].dataType)).alias(f"v_{j}")
                  for j, cj in enumerate(columns)]
        entries.append(F.struct(F.lit(i).alias("_tag"), *fields))
    long = df.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")
    return long.groupBy(*keys, "_tag", *[f"v_{j}" for j in range(len(columns))]).agg(F.count(F.lit(1)).alias("_cnt"))


def weighted_std(v: Column, n: Column) -> Column:
    """Sample standard deviation of values ``v`` with multiplicities ``n``
    (null for one value); exact while the sums of integers stay below 2^53."""
    x = v.cast("double")
    w = F.sum(F.when(v.isNotNull(), n)).cast("double")
    s1, s2 = F.sum(x * n), F.sum(x * x * n)
    return F.when(w > 1, F.sqrt(F.greatest((w * s2 - s1 * s1) / (w * (w - 1)), F.lit(0.0))))


def round_doubles(df: DataFrame, scale: int = 6) -> DataFrame:
    """Round every float/double column (for cross-engine comparison)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(F.round(F.col(f.name), scale).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double; NULL when b is 0 or NULL."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))
