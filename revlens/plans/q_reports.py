"""Dataset overview, profile, category summaries, frequency tables."""

from pyspark.sql import functions as F

from revlens.operators import reports as R
from revlens.plans.registry import register
from revlens.plans.sqlgen import with_views
from revlens.sources.tables import DOC_REVIEWS_SQL, REVIEWS_SQL, doc_reviews, reviews

_BYCAT = ("SELECT category, count(DISTINCT id) AS reviews, count(DISTINCT app_id) AS apps, "
          "count(DISTINCT author) AS authors, round_even(count(DISTINCT id) / count(DISTINCT app_id), 2) AS reviews_per_app "
          "FROM r GROUP BY category")


@register("category_summary", sql=with_views(
    "SELECT category, count(*) AS count, round_even(count(*) * 100.0 / (SELECT count(*) FROM r), 2) AS percent "
    "FROM r GROUP BY category", r=REVIEWS_SQL), dbl=["percent"])
def category_summary(spark, sf):
    return R.category_summary(reviews(spark, sf))


@register("dataset_overview", sql=with_views(
    """SELECT count(*) AS reviews, count(DISTINCT author) AS users, count(DISTINCT app_name) AS apps,
       count(DISTINCT category) AS categories, 10::BIGINT AS features,
       round_even((sum(strlen(id)) + sum(strlen(app_id)) + sum(strlen(app_name)) + sum(strlen(category))
              + sum(strlen(author)) + count(rating) * 4 + count(review_length) * 4 + count(vote_count) * 8
              + count(vote_sum) * 8 + count(date) * 8) / (1024 * 1024), 2) AS size_mb,
       min(date)::DATE AS first_review, max(date)::DATE AS last_review FROM r""", r=REVIEWS_SQL),
    dbl=["size_mb"])
def dataset_overview(spark, sf):
    return R.dataset_overview(reviews(spark, sf))


@register("dtype_counts")
def dtype_counts(spark, sf):
    """Columns per data type (schema metadata; rows check)."""
    return R.dtype_counts(reviews(spark, sf))


def _profile_sql():
    cols = [("id", "string", "strlen(id)"), ("app_id", "string", "strlen(app_id)"),
            ("app_name", "string", "strlen(app_name)"), ("category", "string", "strlen(category)"),
            ("author", "string", "strlen(author)"), ("rating", "int", None), ("review_length", "int", None),
            ("vote_count", "bigint", None), ("vote_sum", "bigint", None), ("date", "timestamp_ntz", None)]
    width = {"int": 4, "bigint": 8, "timestamp_ntz": 8}
    parts = []
    for c, t, b in cols:
        by = f"coalesce(sum({b}), 0)::BIGINT" if b else f"(count({c}) * {width[t]})::BIGINT"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{t}' AS data_type, count({c}) AS complete, count(*) - count({c}) AS \"null\", "
            f"count({c}) / count(*) AS completeness, count(DISTINCT {c}) AS \"unique\", "
            f"count(*) - count(DISTINCT {c}) AS duplicate, count(DISTINCT {c}) / count(*) AS uniqueness, "
            f"{by} AS bytes FROM r")
    return with_views(" UNION ALL ".join(parts), r=REVIEWS_SQL)


@register("column_profile", sql=_profile_sql(), dbl=["completeness", "uniqueness"])
def column_profile(spark, sf):
    return R.column_profile(reviews(spark, sf))


@register("by_category", sql=with_views(_BYCAT, r=REVIEWS_SQL), dbl=["reviews_per_app"])
def by_category(spark, sf):
    return R.by_category(reviews(spark, sf))


@register("describe_by_category", sql=with_views(
    "SELECT count(reviews) AS count, avg(reviews) AS mean, stddev_samp(reviews) AS std, min(reviews)::DOUBLE AS min, "
    "quantile_cont(reviews, 0.25) AS p25, quantile_cont(reviews, 0.5) AS p50, quantile_cont(reviews, 0.75) AS p75, "
    "max(reviews)::DOUBLE AS max FROM b", r=REVIEWS_SQL, b=_BYCAT),
    dbl=["mean", "std", "min", "p25", "p50", "p75", "max"])
def describe_by_category(spark, sf):
    return R.describe_column(R.by_category(reviews(spark, sf)), "reviews")


@register("counts_by_category", sql=with_views(
    "SELECT category, reviews, (sum(reviews) OVER w)::BIGINT AS cumulative, percent, "
    "round_even(sum(percent) OVER w, 2) AS cumulative_percent "
    "FROM (SELECT *, round_even(reviews / sum(reviews) OVER (), 2) AS percent FROM b) "
    "WINDOW w AS (ORDER BY reviews DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    r=REVIEWS_SQL, b=_BYCAT), dbl=["percent", "cumulative_percent"])
def counts_by_category(spark, sf):
    return R.counts_by_category(R.by_category(reviews(spark, sf)), "reviews")


def _counts_sql(order):
    return ("SELECT category, reviews, (sum(reviews) OVER w)::BIGINT AS cumulative, percent, "
            "round_even(sum(percent) OVER w, 2) AS cumulative_percent "
            "FROM (SELECT *, round_even(reviews / sum(reviews) OVER (), 2) AS percent FROM b) "
            f"WINDOW w AS (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


@register("counts_by_category_name", sql=with_views(_counts_sql("category"), r=REVIEWS_SQL, b=_BYCAT), dbl=["percent", "cumulative_percent"])
def counts_by_category_name(spark, sf):
    return R.counts_by_category(R.by_category(reviews(spark, sf)), "reviews", sort_by_value=False)


@register("counts_by_category_rising", sql=with_views(_counts_sql("reviews, category"), r=REVIEWS_SQL, b=_BYCAT),
          dbl=["percent", "cumulative_percent"])
def counts_by_category_rising(spark, sf):
    return R.counts_by_category(R.by_category(reviews(spark, sf)), "reviews", ascending=True)


_STORE_SQL = ("SELECT category, (count(DISTINCT app_id) * 3)::BIGINT AS app_store FROM r GROUP BY category")


def store_table(spark, sf):
    """Stand-in for the external store-count table: derived from the data
    (three listed apps per reviewed app id) so the report runs end to end."""
    r = reviews(spark, sf)
    return r.groupBy("category").agg((F.count_distinct("app_id") * 3).cast("bigint").alias("app_store"))


@register("apps_by_category", sql=with_views(
    """SELECT s.category, s.app_store, round_even(s.app_store / sum(s.app_store) OVER (), 2) AS pct_app_store,
              o.app_voc, round_even(o.app_voc / sum(o.app_voc) OVER (), 2) AS pct_app_voc
       FROM s JOIN (SELECT category, count(DISTINCT app_name) AS app_voc FROM r GROUP BY category) o
         ON s.category IS NOT DISTINCT FROM o.category""", r=REVIEWS_SQL, s=_STORE_SQL),
    dbl=["pct_app_store", "pct_app_voc"])
def apps_by_category(spark, sf):
    return R.apps_by_category(reviews(spark, sf), store_table(spark, sf))


@register("describe_numeric", sql=with_views(
    "SELECT count(vote_sum) AS count, avg(vote_sum) AS mean, stddev_samp(vote_sum) AS std, min(vote_sum)::DOUBLE AS min, "
    "quantile_cont(vote_sum, 0.25) AS p25, quantile_cont(vote_sum, 0.5) AS p50, quantile_cont(vote_sum, 0.75) AS p75, "
    "max(vote_sum)::DOUBLE AS max FROM r", r=REVIEWS_SQL), dbl=["mean", "std", "min", "p25", "p50", "p75", "max"])
def describe_numeric(spark, sf):
    return R.describe_column(reviews(spark, sf), "vote_sum")


@register("describe_categorical", sql=with_views(
    "SELECT sum(c)::BIGINT AS count, count(*) AS \"unique\", arg_min(app_name, (-c, app_name)) AS top, max(c) AS freq "
    "FROM (SELECT app_name, count(*) AS c FROM r WHERE app_name IS NOT NULL GROUP BY app_name)", r=REVIEWS_SQL))
def describe_categorical(spark, sf):
    return R.describe_categorical(reviews(spark, sf), "app_name")


@register("unique_values", sql=with_views("SELECT DISTINCT category, rating FROM r", r=REVIEWS_SQL))
def unique_values(spark, sf):
    return R.unique_values(reviews(spark, sf), ["category", "rating"])


@register("top_n_frequency", sql=with_views(
    "SELECT app_name, c AS count, (sum(c) OVER w)::BIGINT AS cumulative, c / t AS proportion, sum(c) OVER w / t AS cumulative_proportion "
    "FROM (SELECT app_name, count(*) AS c, sum(count(*)) OVER () AS t FROM r GROUP BY app_name "
    "ORDER BY c DESC, app_name NULLS FIRST LIMIT 10) "
    "WINDOW w AS (ORDER BY c DESC, app_name NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    r=REVIEWS_SQL), dbl=["proportion", "cumulative_proportion"])
def top_n_frequency(spark, sf):
    return R.top_n_frequency(reviews(spark, sf), "app_name", 10)


@register("countstats", sql=with_views(
    "SELECT count(n) AS count, avg(n) AS mean, stddev_samp(n) AS std, min(n)::DOUBLE AS min, "
    "quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, max(n)::DOUBLE AS max "
    "FROM (SELECT app_id, count(*) AS n FROM r GROUP BY app_id)", r=REVIEWS_SQL),
    dbl=["mean", "std", "min", "p25", "p50", "p75", "max"])
def countstats(spark, sf):
    return R.countstats(reviews(spark, sf), "app_id")


@register("count_values", sql=with_views("SELECT app_id, count(*) AS n FROM r GROUP BY app_id", r=REVIEWS_SQL))
def count_values(spark, sf):
    return R.count_values(reviews(spark, sf), "app_id")


@register("doc_category_summary", sql=with_views(
    "SELECT category, count(*) AS count, round_even(count(*) * 100.0 / (SELECT count(*) FROM d), 2) AS percent "
    "FROM d GROUP BY category", d=DOC_REVIEWS_SQL), dbl=["percent"])
def doc_category_summary(spark, sf):
    return R.category_summary(doc_reviews(spark, sf))
