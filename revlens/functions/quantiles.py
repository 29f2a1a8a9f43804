"""Exact quantiles (linear interpolation) without a task that sees all values.

The distinct values with their counts are range-partitioned, which makes each
partition a cell of a range histogram.  The cells' totals (one row per cell
and group) tell which cells hold the wanted ranks; only rows of those cells
are looked at again, cell by cell, to pick the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.stats import null_safe_join
from revlens.session import shared_table


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per group of ``by`` (one row in all without groups): the group's
    columns and ``q``, an array of doubles in the order of ``probs``.

    Nulls and NaNs of ``column`` are left out; a group without values has no
    row, except that without groups the row is always there, its ``q`` null.
    ``weight`` names a column of counts (rows of weight 0 or less are left out).
    """
    by, probs = list(by), [float(p) for p in probs]
    v = F.col(column).cast("double")
    n = F.sum(F.col(weight)).cast("long") if weight else F.count(F.lit(1))
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.col(weight) > 0 if weight else F.lit(True)))
    hist = rows.groupBy(*by, v.alias("_v")).agg(n.alias("_c"))
    order = [F.col(c).asc_nulls_first() for c in [*by, "_v"]]
    hist = shared_table(hist.repartitionByRange(*order).withColumn("_cell", F.spark_partition_id()), "value-counts")

    cells = hist.groupBy("_cell", *by).agg(F.sum("_c").alias("_t"))
    ahead = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_off", F.coalesce(F.sum("_t").over(ahead), F.lit(0)))
    total = cells.groupBy(*by).agg(F.sum("_t").alias("_n"))
    at = F.array(*[F.lit(p) * (F.col("_n") - 1) for p in probs])
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(F.floor(p), F.ceil(p)))))
    total = total.withColumn("_ranks", ranks)
    inside = F.filter("_ranks", lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_t")))
    # cells that hold a rank: at most two per group and probability
    wanted = null_safe_join(cells, total, by).withColumn("_ranks", inside).where(F.size("_ranks") > 0).select("_cell", *by, "_off", "_ranks")

    local = Window.partitionBy("_cell", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = null_safe_join(hist, wanted, ["_cell", *by]).withColumn("_from", F.col("_off") + F.coalesce(F.sum("_c").over(local), F.lit(0)))
    hit = F.explode(F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_c"))))
    picked = near.select(*by, "_v", hit.alias("_r")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))

    both = null_safe_join(picked, total.select(*by, "_n"), by)
    q = []
    for p in probs:
        pos = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.element_at("_at", F.floor(pos)), F.element_at("_at", F.ceil(pos))
        q.append(lo + (hi - lo) * (pos - F.floor(pos)))
    one = both.select(*by, F.when(F.col("_n") > 0, F.array(*q)).alias("q"))
    return one if by else one.agg(F.max("q").alias("q"))
