"""Sources, sinks, stage runner, run metrics, registry.

Queries that write do so under the session's shared checkpoint folder
(fresh sub-folder per call) and return the table read back."""

import os

from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.operators import clean as C
from revlens.operators import quality as Q
from revlens.plans import stages as E
from revlens.plans.q_quality import _CLEAN_REV, _outlier_cte, rev_flags_sql
from revlens.plans.registry import register
from revlens.plans.sqlgen import with_views
from revlens.sources import files as S
from revlens.sources.tables import DOC_REVIEWS_SQL, REVIEWS_SQL, doc_reviews, reviews, table


@register("scan_parquet", sql="SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def scan_parquet(spark, sf):
    """Projection and filter reach the scan (ReadSchema, PushedFilters)."""
    li = table(spark, sf, "lineitem")
    return li.where(F.col("l_quantity") > 45).select("l_orderkey", "l_partkey", "l_quantity")


@register("partitioned_roundtrip", sql=with_views("SELECT id, vote_count, category FROM d", d=DOC_REVIEWS_SQL))
def partitioned_roundtrip(spark, sf):
    path = S.shared_scratch(spark, "partitioned")
    S.write_partitioned(doc_reviews(spark, sf).select("id", "vote_count", "category"), path, ["category"])
    return spark.read.parquet(path).select("id", "vote_count", F.col("category").cast("string"))


@register("stage_files", sql=with_views("SELECT id, vote_sum, category FROM r", r=REVIEWS_SQL))
def stage_files(spark, sf):
    path = S.shared_scratch(spark, "staged")
    S.stage_files(reviews(spark, sf).select("id", "vote_sum", "category"), path)
    back = spark.read.schema("id string, vote_sum long, category string").option("header", True) \
        .option("sep", "\t").option("escape", "\\").csv(path)
    return back.select("id", "vote_sum", "category")


def _raw_files(spark, sf):
    """Raw per-category TSV files in the source layout (all columns kept)."""
    r = reviews(spark, sf).hint("rebalance", "category")  # before columns are repeated, so that they move once
    raw = r.select("id", "app_id", "app_name", F.col("category").alias("category_id"), "category", "author",
                   F.col("rating").cast("double").alias("rating"), F.lit("").alias("title"),
                   F.col("app_name").alias("content"), "vote_count", "vote_sum",
                   F.col("date").cast("timestamp").alias("date"), F.col("category").alias("_part"))
    path = S.shared_scratch(spark, "raw")
    (raw.write.mode("overwrite").partitionBy("_part").option("header", True)
        .option("sep", "\t").option("escape", "\\").csv(path))
    return path


@register("acquire_reviews", sql=with_views(
    "SELECT DISTINCT id, app_id, app_name, category AS category_id, category, substr(sha256(author), 1, 20) AS author, "
    "rating::DOUBLE AS rating, app_name AS content, vote_count, vote_sum, date FROM r "
    f"WHERE category IS DISTINCT FROM '{K.EXCLUDED_CATEGORY}'", r=REVIEWS_SQL), dbl=["rating"])
def acquire_reviews(spark, sf):
    path = _raw_files(spark, sf)
    out = S.acquire_reviews(spark, os.path.join(path, "*", "*.csv"))
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


_FILE_BYTES = ("octet_length(encode(concat(id, app_id, app_name, category, category, author, cast(rating::DOUBLE AS VARCHAR), app_name, "
               "cast(vote_count AS VARCHAR), cast(vote_sum AS VARCHAR)))) + 24")  # the title is empty, a date is 24 characters
_FILE_SUMS = f"count(*) AS rows, 12::BIGINT AS columns, cast(sum({_FILE_BYTES}) AS BIGINT) AS value_bytes FROM r"


@register("fileset_overview", sql=with_views(
    f"SELECT category, {_FILE_SUMS} GROUP BY category UNION ALL SELECT 'Total', {_FILE_SUMS}", r=REVIEWS_SQL))
def fileset_overview(spark, sf):
    """Raw files: rows, columns and value bytes, by category (file names and sizes depend on the writer)."""
    files = S.fileset_overview(spark, os.path.join(_raw_files(spark, sf), "*", "*.csv"), key="_part")
    return files.groupBy("category").agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.sum("value_bytes").alias("value_bytes"))


@register("staged_completeness", sql=with_views(
    "SELECT CASE WHEN grouping(category) = 1 THEN 'Total' ELSE category END AS category, count(*) AS rows, "
    "7 AS columns, count_if(id IS NOT NULL AND category IS NOT NULL AND lang IS NOT NULL AND content IS NOT NULL "
    "AND vote_count IS NOT NULL AND rating IS NOT NULL AND toxic IS NOT NULL)::BIGINT AS complete, "
    "round_even(count_if(id IS NOT NULL AND category IS NOT NULL AND lang IS NOT NULL AND content IS NOT NULL "
    "AND vote_count IS NOT NULL AND rating IS NOT NULL AND toxic IS NOT NULL) * 100.0 / count(*), 2) AS percent "
    "FROM d GROUP BY ROLLUP (category)", d=DOC_REVIEWS_SQL), dbl=["percent"])
def staged_completeness(spark, sf):
    return S.staged_completeness(doc_reviews(spark, sf))


# ------------------------------------------------------------------ E1 - E6
def _pipeline(spark, sf):
    """norm -> dqa -> clean as durable stages with run metrics."""
    base = S.shared_scratch(spark, "stages")
    src = os.path.join(base, "00_raw")
    reviews(spark, sf).write.mode("overwrite").parquet(src)
    m = os.path.join(base, "run_metrics")
    dqa = E.run_stage(spark, lambda d: Q.assess_quality(d, text_column=None), src,
                      os.path.join(base, "02_dqa"), "DetectDuplicateRowTask", m)
    E.run_stage(spark, lambda d: C.clean_reviews(d, [c for c in C.issues_to_remove() if c in d.columns]),
                os.path.join(base, "02_dqa"), os.path.join(base, "03_clean"), "DataCleaningTask", m)
    # second call finds the stored table and does not recompute (no new metrics row)
    E.run_stage(spark, lambda d: d, src, os.path.join(base, "02_dqa"), "DetectDuplicateRowTask", m)
    return base, m, dqa


_RUN_VIEWS = dict(r=REVIEWS_SQL, s="SELECT * FROM r", bs=_outlier_cte("s", "vote_sum"), bc=_outlier_cte("s", "vote_count"),
                  f=rev_flags_sql((K.DATE_LOWER, K.DATE_UPPER)))
_CLEAN_RUN = ("SELECT 'DataCleaningTask' AS task, 'clean' AS stage, 'data_prep' AS phase, count(*) AS input_records, "
              f"count_if(NOT ({' OR '.join(_CLEAN_REV)}))::BIGINT AS output_records FROM f")


@register("run_metrics", sql=with_views(
    "SELECT 'DetectDuplicateRowTask' AS task, 'data_quality_assessment' AS stage, 'data_prep' AS phase, "
    f"count(*) AS input_records, count(*) AS output_records FROM s UNION ALL {_CLEAN_RUN}", **_RUN_VIEWS))
def run_metrics(spark, sf):
    """Rows in and out per stage of a small durable pipeline."""
    _b, m, _d = _pipeline(spark, sf)
    return E.read_metrics(spark, m).select("task", "stage", "phase", "input_records", "output_records")


@register("run_metrics_by_stage", sql=with_views(_CLEAN_RUN, **_RUN_VIEWS))
def run_metrics_by_stage(spark, sf):
    _b, m, _d = _pipeline(spark, sf)
    return E.read_metrics(spark, m, stage="clean").select("task", "stage", "phase", "input_records", "output_records")


@register("dataset_registry", sql=with_views(
    "SELECT 'reviews' AS name, 'data_prep' AS phase, 'norm' AS stage, count(*) AS nrows, 10::INTEGER AS ncols, "
    "'revlens' AS creator FROM r", r=REVIEWS_SQL))
def dataset_registry(spark, sf):
    """Register the reviews; return the registry rows."""
    base = S.shared_scratch(spark, "registry")
    reg = os.path.join(base, "dataset_registry")
    E.register_dataset(spark, reg, reviews(spark, sf), "reviews", "data_prep", "norm",
                       os.path.join(base, "01_norm"), "revlens")
    return E.read_registry(spark, reg).select("name", "phase", "stage", "nrows", "ncols", "creator")
