"""Grouped review metrics (by category, author, app name, category+author).

Shared metric block per group: row count; min, max, mean, most frequent
value and sample standard deviation of rating, review_length, vote_count
and vote_sum; min, max and most frequent value of date.

Plan: group sizes are counted first.  Groups of up to ``HOT`` rows go through
one aggregation on the group: each row is shuffled once, and a group's values
fit in memory.  Larger groups go through a (group, column, value) histogram
with map-side combine, from which a second aggregation takes every figure, so
no task holds all values of a hot group.  Both give the same figures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.stats import TASK_ROWS, safe_div, spread, value_counts, weighted_std
from revlens.session import shared_table

MEASURES = ("rating", "review_length", "vote_count", "vote_sum")


#: Rows of the largest group that is aggregated directly.
HOT = 100_000


def metric_block(df: DataFrame, keys: Sequence[str], distincts: dict[str, str], hot: int = HOT) -> DataFrame:
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    groups, large, rows = sizes.agg(F.count(F.lit(1)), F.count_if(F.col("_n") > hot), F.sum("_n")).first()
    if large == 0:
        return _direct(spread(df, keys, rows, TASK_ROWS), keys, distincts)
    if large == groups:
        return _by_histogram(df, keys, distincts, rows or 0)
    marks = shared_table(sizes.where(F.col("_n") > hot).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), "hot-groups")
    same = [df[k].eqNullSafe(marks[f"_k{i}"]) for i, k in enumerate(keys)]
    return _direct(spread(df.join(marks, same, "left_anti"), keys, rows, TASK_ROWS), keys, distincts).unionByName(
        _by_histogram(df.join(marks, same, "left_semi"), keys, distincts, rows or 0))


def _direct(df: DataFrame, keys: Sequence[str], distincts: dict[str, str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("review_count")]
    for m in (*MEASURES, "date"):
        aggs += [F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.mode(m, True).alias(f"{m}_mode")]
        if m != "date":
            aggs += [F.avg(m).alias(f"{m}_avg"), F.stddev_samp(m).alias(f"{m}_std")]
    aggs += [F.size(F.collect_set(c)).cast("long").alias(out) for out, c in distincts.items()]
    return df.groupBy(*keys).agg(*aggs)


def _by_histogram(df: DataFrame, keys: Sequence[str], distincts: dict[str, str], rows: int) -> DataFrame:
    n = F.col("_cnt")
    aggs = [F.sum(F.when(F.col("_tag") == 0, n)).alias("review_count")]
    for i, m in enumerate((*MEASURES, "date")):
        v = F.col(f"v_{i}")
        order = F.when(v.isNotNull(), F.struct((-n).alias("n"), v.alias("v")))
        aggs += [F.min(v).alias(f"{m}_min"), F.max(v).alias(f"{m}_max"), F.min_by(v, order).alias(f"{m}_mode")]
        if m != "date":
            aggs += [(F.sum(v.cast("double") * n) / F.sum(F.when(v.isNotNull(), n))).alias(f"{m}_avg"),
                     weighted_std(v, n).alias(f"{m}_std")]
    aggs += [F.count(F.col(f"v_{len(MEASURES) + 1 + i}")).alias(out) for i, out in enumerate(distincts)]
    return value_counts(df, keys, [*MEASURES, "date", *distincts.values()], rows).groupBy(*keys).agg(*aggs)


def _ordered(df: DataFrame, head: Sequence[str]) -> DataFrame:
    tail = []
    for m in MEASURES:
        tail += [f"{m}_min", f"{m}_max", f"{m}_avg", f"{m}_mode", f"{m}_std"]
    tail += ["date_min", "date_max", "date_mode"]
    return df.select(*head, *tail)


def category_metrics(df: DataFrame) -> DataFrame:
    b = metric_block(df, ["category"], {"app_count": "app_id", "author_count": "author"})
    b = (b.withColumn("reviews_per_app", safe_div(F.col("review_count"), F.col("app_count")))
          .withColumn("reviews_per_author", safe_div(F.col("review_count"), F.col("author_count"))))
    return _ordered(b, ["category", "app_count", "author_count", "review_count",
                        "reviews_per_app", "reviews_per_author"])


def author_metrics(df: DataFrame) -> DataFrame:
    # the distinct-category count is named ``category`` (reference output)
    b = metric_block(df, ["author"], {"app_count": "app_id", "category": "category"})
    b = (b.withColumn("reviews_per_app", safe_div(F.col("review_count"), F.col("app_count")))
          .withColumn("reviews_per_category", safe_div(F.col("review_count"), F.col("category"))))
    return _ordered(b, ["author", "app_count", "category", "review_count",
                        "reviews_per_app", "reviews_per_category"])


def app_metrics(df: DataFrame) -> DataFrame:
    b = metric_block(df, ["app_name"], {"author_count": "author"})
    b = b.withColumn("reviews_per_author", safe_div(F.col("review_count"), F.col("author_count")))
    return _ordered(b, ["app_name", "author_count", "review_count", "reviews_per_author"])


def category_author_metrics(df: DataFrame) -> DataFrame:
    b = metric_block(df, ["category", "author"], {"app_count": "app_id"})
    b = b.withColumn("reviews_per_app", safe_div(F.col("review_count"), F.col("app_count")))
    return _ordered(b, ["category", "author", "app_count", "review_count", "reviews_per_app"])
