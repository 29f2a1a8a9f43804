"""Dataset reports: flag overview, quality report, category summaries,
column profile, frequency tables.

Every report is one aggregation over the fact rows (map-side combine,
bounded output), followed by cheap window/ordering work on the small
aggregated result only.  No window ever runs over fact rows without a
partition key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, ByteType, DateType, DoubleType,
                               FloatType, IntegerType, LongType, ShortType, StringType,
                               TimestampNTZType, TimestampType)

from revlens.functions.ordered import running
from revlens.functions.quantiles import exact_quantiles
from revlens.functions.stats import null_safe_join, safe_div, value_counts
from revlens.operators.clean import impact_config


def _long_one_row(row_df: DataFrame, names: Sequence[str], name_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Unpivot a one-row aggregate whose columns are ``{n}__{v}``."""
    entries = [F.struct(F.lit(n).alias(name_col), *[F.col(f"{n}__{v}").alias(v) for v in value_cols])
               for n in names]
    return row_df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


# --------------------------------------------------------------------------- A5 / A6
def dqa_overview(df: DataFrame) -> DataFrame:
    """Per ``dqa_`` column: number of true rows and percent of all rows."""
    flags = [c for c in df.columns if c.startswith("dqa_")]
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(F.col(f)).alias(f"{f}__count") for f in flags]
    one = df.agg(*aggs)
    for f in flags:
        one = one.withColumn(f"{f}__percent", F.col(f"{f}__count") / F.col("_n") * 100)
    return _long_one_row(one, flags, "flag", ["count", "percent"])


def dqa_report(df: DataFrame) -> DataFrame:
    """Characteristic, impact, count, percent (2 dp) ordered by impact."""
    ov = dqa_overview(df)
    cfg = impact_config(df.sparkSession)
    # impact table has 15 rows: a fixed-size broadcast
    j = ov.join(F.broadcast(cfg), ov.flag == cfg.issue, "left")
    return j.select("characteristic", "impact", "count",
                    F.bround(F.col("percent"), 2).alias("percent")).orderBy("impact", "characteristic")


# --------------------------------------------------------------------------- A7 / A8 / A9 / A10
def category_summary(df: DataFrame, key: str = "category") -> DataFrame:
    """Rows and percent of rows (2 dp) per category."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return (g.crossJoin(F.broadcast(total))
             .select(key, "count", F.bround(F.col("count") / F.col("_t") * 100, 2).alias("percent")))


_FIXED_WIDTH = {BooleanType: 1, ByteType: 1, ShortType: 2, IntegerType: 4, LongType: 8, FloatType: 4,
                DoubleType: 8, DateType: 4, TimestampType: 8, TimestampNTZType: 8}


def value_bytes(df: DataFrame, c: str):
    """Size of a column's values: UTF-8 bytes for strings, fixed width otherwise."""
    t = type(df.schema[c].dataType)
    if t in (StringType, BinaryType):
        return F.coalesce(F.sum(F.octet_length(F.col(c))), F.lit(0)).cast("bigint")
    if t is ArrayType:
        return F.coalesce(F.sum(F.aggregate(F.col(c), F.lit(0), lambda a, x: a + F.octet_length(x))),
                          F.lit(0)).cast("bigint")
    return (F.count(F.col(c)) * _FIXED_WIDTH.get(t, 8)).cast("bigint")


def dataset_overview(df: DataFrame) -> DataFrame:
    """One row: reviews, users, apps, categories, features, size (MB), first
    and last review date."""
    size = None
    for c in df.columns:
        e = value_bytes(df, c)
        size = e if size is None else size + e
    return df.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_distinct("author").alias("users"),
        F.count_distinct("app_name").alias("apps"),
        F.count_distinct("category").alias("categories"),
        F.lit(len(df.columns)).cast("bigint").alias("features"),
        F.bround(size / (1024 * 1024), 2).alias("size_mb"),
        F.to_date(F.min("date")).alias("first_review"),
        F.to_date(F.max("date")).alias("last_review"),
    )


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per data type (schema metadata, no data pass)."""
    spark = df.sparkSession
    rows = [(f.dataType.simpleString(),) for f in df.schema.fields]
    return spark.createDataFrame(rows, "data_type string").groupBy("data_type").agg(
        F.count(F.lit(1)).alias("count"))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, complete, null, completeness, unique, duplicate,
    uniqueness, bytes.  Distinct counts come from one (column, value)
    histogram pass; the other measures from one plain aggregation."""
    from revlens.functions.stats import grouped_modes_and_distincts
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs += [F.count(F.col(c)).alias(f"{c}__complete"), value_bytes(df, c).alias(f"{c}__bytes")]
    one = df.agg(*aggs)
    uniq = grouped_modes_and_distincts(df, [], {}, {f"{c}__unique": c for c in cols})
    one = one.crossJoin(uniq)  # two one-row aggregates
    entries = [F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                        F.col(f"{c}__complete").alias("complete"), F.col(f"{c}__unique").alias("unique"),
                        F.col(f"{c}__bytes").alias("bytes"), F.col("_n").alias("_n")) for c in cols]
    long = one.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
    return long.select(
        "column", "data_type", "complete",
        (F.col("_n") - F.col("complete")).alias("null"),
        (F.col("complete") / F.col("_n")).alias("completeness"),
        "unique",
        (F.col("_n") - F.col("unique")).alias("duplicate"),
        (F.col("unique") / F.col("_n")).alias("uniqueness"),
        "bytes")


# --------------------------------------------------------------------------- A11 - A14
def by_category(df: DataFrame, key: str = "category") -> DataFrame:
    """Distinct reviews, apps, authors per category, reviews per app (2 dp)."""
    # nulls are counted as values too, so a group whose ids are all null keeps its row
    g = value_counts(df, [key], ["id", "app_id", "author"]).groupBy(key).agg(
        *[F.count(F.col(f"v_{i}")).alias(name) for i, name in enumerate(("reviews", "apps", "authors"))])
    return g.select(key, "reviews", "apps", "authors",
                    F.bround(safe_div(F.col("reviews"), F.col("apps")), 2).alias("reviews_per_app"))


def describe_column(df: DataFrame, x: str) -> DataFrame:
    """count, mean, std, min, quartiles (linear), max of a numeric column."""
    base = df.agg(F.count(F.col(x)).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"))
    q = exact_quantiles(df, x, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    return base.crossJoin(q).select("count", "mean", "std", "min", F.col("_q")[0].alias("p25"),
                                    F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")


def counts_by_category(df: DataFrame, x: str, key: str = "category",
                       sort_by_value: bool = True, ascending: bool = False) -> DataFrame:
    """Value, running total, share (2 dp) and running share of the rounded
    share, over an already-aggregated per-category table ``df``."""
    if sort_by_value:
        o = [F.col(x).asc() if ascending else F.col(x).desc(), F.col(key).asc()]
    else:
        o = [F.col(key).asc()]
    tot = df.agg(F.sum(x).alias("_t"))
    t = df.select(key, x).crossJoin(F.broadcast(tot))
    # shares are whole hundredths: their running sum is one of integers
    t = t.withColumn("percent", F.bround(F.col(x) / F.col("_t"), 2)).withColumn("_h", F.round(F.col("percent") * 100).cast("long"))
    t = running(t, o, {"_x": F.col(x), "_p": F.col("_h")})
    return t.select(key, x, (F.col("_x") + F.col(x)).alias("cumulative"), "percent",
                    F.bround((F.col("_p") + F.col("_h")) / 100, 2).alias("cumulative_percent"))


def apps_by_category(df: DataFrame, store: DataFrame, key: str = "category") -> DataFrame:
    """Distinct app names per category beside a reference table of store app
    counts (``category``, ``app_store``), shares rounded to 2 dp."""
    ours = df.groupBy(key).agg(F.count_distinct("app_name").alias("app_voc"))
    ot = ours.agg(F.sum("app_voc").alias("_ot"))
    st = store.agg(F.sum("app_store").alias("_st"))
    o = ours.crossJoin(F.broadcast(ot)).withColumn("pct_app_voc", F.bround(F.col("app_voc") / F.col("_ot"), 2))
    s = store.crossJoin(F.broadcast(st)).withColumn("pct_app_store", F.bround(F.col("app_store") / F.col("_st"), 2))
    j = null_safe_join(s.drop("_st"), o.drop("_ot"), [key])
    return j.select(key, "app_store", "pct_app_store", "app_voc", "pct_app_voc").orderBy(F.col("app_voc").desc())


# --------------------------------------------------------------------------- A15 - A18
def describe_categorical(df: DataFrame, x: str) -> DataFrame:
    """count, unique, top (most frequent, ties to the smallest), freq."""
    h = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return h.agg(F.sum("_c").cast("bigint").alias("count"), F.count(F.lit(1)).alias("unique"),
                 F.min_by("_v", F.struct((-F.col("_c")).alias("n"), F.col("_v").alias("v"))).alias("top"),
                 F.max("_c").alias("freq"))


def unique_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def top_n_frequency(df: DataFrame, x: str, n: int = 10) -> DataFrame:
    """The n commonest values (ties by value): count, running count, share of
    all rows, running share.  Counting is one aggregation; only the n
    winners are ordered (a top-k, not a global sort)."""
    g = df.groupBy(x).agg(F.count(F.lit(1)).alias("count"))
    total = g.agg(F.sum("count").alias("_t"))
    top = g.orderBy(F.col("count").desc(), F.col(x).asc_nulls_first()).limit(n)  # the feature: top-n
    w = Window.orderBy(F.col("count").desc(), F.col(x).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    t = top.crossJoin(F.broadcast(total))
    return t.select(x, "count", F.sum("count").over(w).alias("cumulative"),
                    (F.col("count") / F.col("_t")).alias("proportion"),
                    (F.sum("count").over(w) / F.col("_t")).alias("cumulative_proportion"))


def countstats(df: DataFrame, x: str) -> DataFrame:
    """describe() of the per-value counts of ``x``."""
    return describe_column(count_values(df, x), "n")


def count_values(df: DataFrame, x: str) -> DataFrame:
    """Rows per value of ``x`` (null is a value), the table that ``countstats`` describes."""
    return df.groupBy(x).agg(F.count(F.lit(1)).alias("n"))
