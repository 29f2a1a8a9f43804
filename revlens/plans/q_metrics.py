"""A1-A4: grouped metric tables over the reviews view."""

from __future__ import annotations

from revlens.operators import metrics as M
from revlens.plans.registry import register
from revlens.plans.sqlgen import join_on, mode_cte, with_views
from revlens.sources.tables import REVIEWS_SQL, reviews


def _metric_sql(keys, distincts: dict[str, str], ratios: dict[str, tuple[str, str]],
                head: list[str]) -> str:
    k = ", ".join(keys)
    aggs = [f"count(DISTINCT {c}) AS {o}" for o, c in distincts.items()]
    aggs.append("count(*) AS review_count")
    for m in M.MEASURES:
        aggs += [f"min({m}) AS {m}_min", f"max({m}) AS {m}_max",
                 f"avg({m}) AS {m}_avg", f"stddev_samp({m}) AS {m}_std"]
    aggs += ["min(date) AS date_min", "max(date) AS date_max"]
    views = {"r": REVIEWS_SQL, "base": f"SELECT {k}, {', '.join(aggs)} FROM r GROUP BY {k}"}
    joins = []
    for m in (*M.MEASURES, "date"):
        views[f"m_{m}"] = mode_cte("r", keys, m, f"{m}_mode")
        joins.append(f"LEFT JOIN m_{m} ON {join_on(keys, 'base', f'm_{m}')}")
    cols = [f"base.{c}" for c in head if c not in ratios]
    for o, (a, b) in ratios.items():
        cols.append(f"CASE WHEN base.{b} <> 0 THEN base.{a} / base.{b} END AS {o}")
    for m in M.MEASURES:
        cols += [f"base.{m}_min", f"base.{m}_max", f"base.{m}_avg", f"m_{m}.{m}_mode", f"base.{m}_std"]
    cols += ["base.date_min", "base.date_max", "m_date.date_mode"]
    body = f"SELECT {', '.join(cols)} FROM base {' '.join(joins)}"
    return with_views(body, **views)


_DBL = [f"{m}_{s}" for m in M.MEASURES for s in ("avg", "std")]


@register("category_metrics",
          sql=_metric_sql(["category"], {"app_count": "app_id", "author_count": "author"},
                          {"reviews_per_app": ("review_count", "app_count"),
                           "reviews_per_author": ("review_count", "author_count")},
                          ["category", "app_count", "author_count", "review_count"]),
          dbl=_DBL + ["reviews_per_app", "reviews_per_author"])
def category_metrics(spark, sf):
    return M.category_metrics(reviews(spark, sf))


@register("author_metrics",
          sql=_metric_sql(["author"], {"app_count": "app_id", "category": "category"},
                          {"reviews_per_app": ("review_count", "app_count"),
                           "reviews_per_category": ("review_count", "category")},
                          ["author", "app_count", "category", "review_count"]),
          dbl=_DBL + ["reviews_per_app", "reviews_per_category"])
def author_metrics(spark, sf):
    return M.author_metrics(reviews(spark, sf))


@register("app_metrics",
          sql=_metric_sql(["app_name"], {"author_count": "author"},
                          {"reviews_per_author": ("review_count", "author_count")},
                          ["app_name", "author_count", "review_count"]),
          dbl=_DBL + ["reviews_per_author"])
def app_metrics(spark, sf):
    return M.app_metrics(reviews(spark, sf))


@register("category_author_metrics",
          sql=_metric_sql(["category", "author"], {"app_count": "app_id"},
                          {"reviews_per_app": ("review_count", "app_count")},
                          ["category", "author", "app_count", "review_count"]),
          dbl=_DBL + ["reviews_per_app"])
def category_author_metrics(spark, sf):
    return M.category_author_metrics(reviews(spark, sf))
