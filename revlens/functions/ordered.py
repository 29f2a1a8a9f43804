"""Running totals over a global order without a window that sees all rows.

Rows are range-partitioned by the order and written once, with the number of
their partition.  The totals of each partition (one row per partition and
group) give every partition its offset; inside it a local window does the
rest.  A task therefore holds one range of rows, and the only window over
all of them runs on partition totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.stats import null_safe_join
from revlens.session import shared_table


def running(df: DataFrame, order: Sequence[Column | str], weights: dict[str, Column], by: Sequence[str] = (),
            group_info: DataFrame | None = None) -> DataFrame:
    """``df`` with one column for each entry of ``weights``: the sum of that
    weight (null counts 0) over the rows that come earlier in the order,
    within the same values of ``by`` (null is a value).

    Rows that agree in all of ``order`` cannot be cut apart, so the caller
    gives an order that tells rows apart, or one row with a weight for each
    set of equal rows; among rows that still tie, any order holds.
    ``group_info`` has one row for each group of ``by``; its columns are added
    to the group's rows without a join on the group alone, which may be hot.
    An empty table gives no rows.
    """
    by = list(by)
    keys = [F.col(c).asc_nulls_first() for c in by] + [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    temp = {out: f"_w{i}" for i, out in enumerate(weights)}
    rows = df.withColumns({temp[o]: F.coalesce(w, F.lit(0)) for o, w in weights.items()})
    rows = shared_table(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = rows.groupBy("_part", *by).agg(*[F.sum(t).alias(t) for t in temp.values()])
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *by, *[F.coalesce(F.sum(t).over(ahead), F.lit(0)).alias(f"_off{t}") for t in temp.values()])
    if group_info is not None:
        totals = null_safe_join(totals, group_info, by)
    local = Window.partitionBy("_part", *by).orderBy(*keys[len(by):]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({o: F.coalesce(F.sum(t).over(local), F.lit(0)) for o, t in temp.items()})
    rows = null_safe_join(rows, totals, ["_part", *by])
    rows = rows.withColumns({o: F.col(o) + F.col(f"_off{t}") for o, t in temp.items()})
    return rows.drop("_part", *temp.values(), *[f"_off{t}" for t in temp.values()])
