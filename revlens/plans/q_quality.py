"""Quality flags, overview, report, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.functions import text as T
from revlens.operators import clean as C
from revlens.operators import quality as Q
from revlens.operators import reports as R
from revlens.operators.sampling import hex_threshold, sample_by_hash
from revlens.plans.registry import register
from revlens.plans.sqlgen import with_views
from revlens.session import shared_table
from revlens.sources.tables import DOC_REVIEWS_SQL, REVIEW_COLUMNS, REVIEWS_SQL, doc_reviews, reviews

# bounds matching the test data's years (defaults lie outside them)
TEST_DATE_BOUNDS = ("1996-01-01 00:00:00", "2001-01-01 00:00:00")
DOC_COLUMNS = ["id", "category", "lang", "content", "vote_count", "rating", "toxic"]


def _sql_hash(cols, seed=42):
    parts = ", ".join([f"'{seed}'"] + [f"coalesce(cast({c} AS VARCHAR), '')" for c in cols])
    return f"md5(concat_ws('|', {parts}))"


def noisy_reviews(spark, sf):
    """reviews plus a 10 % hash re-sample appended (full-row repeats).  The
    joined rows are stored, since an assessment reads them several times."""
    r = shared_table(reviews(spark, sf), "reviews")
    return r.unionByName(sample_by_hash(r, 0.1, 42))


NOISY_REVIEWS_SQL = (f"SELECT * FROM r UNION ALL SELECT * FROM r WHERE substr({_sql_hash(['id'])}, 1, 8) "
                     f"< '{hex_threshold(0.1)}'")


def _rn_flag(keys, order, name):
    # _rid: one arbitrary physical order shared by every flag, so all
    # flags treat the same copy of identical rows as the first one
    o = ", ".join([f"{c} NULLS FIRST" for c in order] + ["_rid"])
    return f"(row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {o}) > 1) AS {name}"


# SQL forms of the row checks
def _special(c, thr=K.SPECIAL_CHAR_THRESHOLD):
    return (f"coalesce(CASE WHEN length({c}) > 0 THEN "
            f"len(regexp_extract_all({c}, '{T.SPECIAL_CHAR_CLASS}')) / length({c}) > {thr} END, false)")


def _rx(c, pat):
    return f"coalesce(regexp_matches({c}, '{pat}'), false)"


def _date_flag(c, lo, hi):
    return f"coalesce({c} < TIMESTAMP '{lo}' OR {c} > TIMESTAMP '{hi}', false)"


def _rating_flag(c, lo=K.RATING_LOWER, hi=K.RATING_UPPER):
    return f"coalesce({c} < {lo} OR {c} > {hi}, false)"


def _null_flag(cols):
    return "(" + " OR ".join(f"{c} IS NULL" for c in cols) + ")"


def _outlier_cte(src, c):
    return (f"SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
            f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src})")


# ------------------------------------------------------------------ Q1 / Q2
@register("flag_duplicate_rows", sql=with_views(
    f"SELECT * EXCLUDE (_rid), {_rn_flag(REVIEW_COLUMNS, [], 'dqa_is_duplicate')} "
    "FROM (SELECT *, row_number() OVER () AS _rid FROM s)",
    r=REVIEWS_SQL, s=NOISY_REVIEWS_SQL))
def flag_duplicate_rows(spark, sf):
    return Q.flag_duplicates(noisy_reviews(spark, sf), {"dqa_is_duplicate": None})


@register("flag_duplicate_ids", sql=with_views(
    f"SELECT * EXCLUDE (_rid), {_rn_flag(['id'], [c for c in REVIEW_COLUMNS if c != 'id'], 'dqa_is_duplicate_review_id')} "
    "FROM (SELECT *, row_number() OVER () AS _rid FROM r)",
    r=REVIEWS_SQL))
def flag_duplicate_ids(spark, sf):
    return Q.flag_duplicates(shared_table(reviews(spark, sf), "reviews"), {"dqa_is_duplicate_review_id": ["id"]})


# ------------------------------------------------------------------ Q3 - Q11 (stateless)
@register("flag_nulls", sql=with_views(
    f"SELECT id, {_null_flag(DOC_COLUMNS)} AS dqa_has_null_values FROM d", d=DOC_REVIEWS_SQL))
def flag_nulls(spark, sf):
    d = doc_reviews(spark, sf)
    return d.select("id", Q.has_nulls(d).alias("dqa_has_null_values"))


@register("flag_emoji", sql=with_views(
    f"SELECT id, {_rx('content', T.EMOJI_CLASS)} AS dqa_has_emojis FROM d", d=DOC_REVIEWS_SQL))
def flag_emoji(spark, sf):
    return doc_reviews(spark, sf).select("id", Q.has_emoji(F.col("content")).alias("dqa_has_emojis"))


@register("flag_special_chars", sql=with_views(
    f"SELECT id, {_special('content')} AS dqa_has_excessive_special_chars FROM d", d=DOC_REVIEWS_SQL))
def flag_special_chars(spark, sf):
    return doc_reviews(spark, sf).select(
        "id", Q.has_excessive_special_chars(F.col("content")).alias("dqa_has_excessive_special_chars"))


@register("flag_invalid_dates", sql=with_views(
    f"SELECT id, date, {_date_flag('date', *TEST_DATE_BOUNDS)} AS dqa_has_invalid_date FROM r",
    r=REVIEWS_SQL))
def flag_invalid_dates(spark, sf):
    return reviews(spark, sf).select(
        "id", "date", Q.has_invalid_date(F.col("date"), *TEST_DATE_BOUNDS).alias("dqa_has_invalid_date"))


@register("flag_invalid_ratings", sql=with_views(
    f"SELECT id, rating, {_rating_flag('rating')} AS dqa_has_invalid_rating FROM r", r=REVIEWS_SQL))
def flag_invalid_ratings(spark, sf):
    return reviews(spark, sf).select("id", "rating", Q.has_invalid_rating(F.col("rating")).alias("dqa_has_invalid_rating"))


@register("flag_email", sql=with_views(
    f"SELECT id, {_rx('content', K.EMAIL_PATTERN)} AS dqa_contains_email FROM d", d=DOC_REVIEWS_SQL))
def flag_email(spark, sf):
    return doc_reviews(spark, sf).select("id", Q.contains_email(F.col("content")).alias("dqa_contains_email"))


@register("flag_url", sql=with_views(
    f"SELECT id, {_rx('content', K.URL_PATTERN)} AS dqa_contains_url FROM d", d=DOC_REVIEWS_SQL))
def flag_url(spark, sf):
    return doc_reviews(spark, sf).select("id", Q.contains_url(F.col("content")).alias("dqa_contains_url"))


@register("flag_phone", sql=with_views(
    f"SELECT id, {_rx('content', K.PHONE_PATTERN)} AS dqa_contains_phone_number FROM d", d=DOC_REVIEWS_SQL))
def flag_phone(spark, sf):
    return doc_reviews(spark, sf).select("id", Q.contains_phone(F.col("content")).alias("dqa_contains_phone_number"))


# ------------------------------------------------------------------ Q4
@register("flag_outliers", sql=with_views(
    "SELECT id, vote_count, coalesce(vote_count < b.lo OR vote_count > b.hi, false) AS dqa_vote_count_outlier "
    "FROM d CROSS JOIN b", d=DOC_REVIEWS_SQL, b=_outlier_cte("d", "vote_count")))
def flag_outliers(spark, sf):
    d = doc_reviews(spark, sf).select("id", "vote_count")
    return Q.flag_outliers(d, {"dqa_vote_count_outlier": "vote_count"})


@register("boxplot_stats", sql=with_views(
    "SELECT 'vote_count' AS measure, min(vote_count)::DOUBLE AS min, quantile_cont(vote_count, 0.25) AS q1, "
    "quantile_cont(vote_count, 0.5) AS median, quantile_cont(vote_count, 0.75) AS q3, "
    "max(vote_count)::DOUBLE AS max, "
    "quantile_cont(vote_count, 0.25) - 1.5 * (quantile_cont(vote_count, 0.75) - quantile_cont(vote_count, 0.25)) AS lower_fence, "
    "quantile_cont(vote_count, 0.75) + 1.5 * (quantile_cont(vote_count, 0.75) - quantile_cont(vote_count, 0.25)) AS upper_fence "
    "FROM d", d=DOC_REVIEWS_SQL), dbl=["q1", "median", "q3", "lower_fence", "upper_fence", "min", "max"])
def boxplot_stats(spark, sf):
    from revlens.operators.explore import boxplot_stats as bp
    return bp(doc_reviews(spark, sf), "vote_count")


# ------------------------------------------------------------------ Q15: the full assessment
_DOC_FLAGS_SQL = f"""
SELECT f.*, {_null_flag(DOC_COLUMNS)} AS dqa_has_null_values,
       {_rx('content', T.EMOJI_CLASS)} AS dqa_has_emojis,
       {_special('content')} AS dqa_has_excessive_special_chars,
       {_rating_flag('rating')} AS dqa_has_invalid_rating,
       {_rx('content', K.EMAIL_PATTERN)} AS dqa_contains_email,
       {_rx('content', K.URL_PATTERN)} AS dqa_contains_url,
       {_rx('content', K.PHONE_PATTERN)} AS dqa_contains_phone_number,
       coalesce(vote_count < b.lo OR vote_count > b.hi, false) AS dqa_vote_count_outlier
FROM (SELECT * EXCLUDE (_rid), {_rn_flag(DOC_COLUMNS, [], 'dqa_is_duplicate')},
             {_rn_flag(['id'], [c for c in DOC_COLUMNS if c != 'id'], 'dqa_is_duplicate_review_id')}
      FROM (SELECT *, row_number() OVER () AS _rid FROM d)) f
CROSS JOIN b
"""


def doc_flags(spark, sf):
    return Q.assess_quality(doc_reviews(spark, sf), text_column="content", date_column=None,
                            outlier_columns=("vote_count",))


@register("dqa_flags", sql=with_views(_DOC_FLAGS_SQL, d=DOC_REVIEWS_SQL, b=_outlier_cte("d", "vote_count")))
def dqa_flags(spark, sf):
    return doc_flags(spark, sf)


def rev_flags_sql(date_bounds):
    return f"""
SELECT f.*, {_null_flag(REVIEW_COLUMNS)} AS dqa_has_null_values,
       {_date_flag('date', *date_bounds)} AS dqa_has_invalid_date,
       {_rating_flag('rating')} AS dqa_has_invalid_rating,
       coalesce(vote_sum < bs.lo OR vote_sum > bs.hi, false) AS dqa_vote_sum_outlier,
       coalesce(vote_count < bc.lo OR vote_count > bc.hi, false) AS dqa_vote_count_outlier
FROM (SELECT * EXCLUDE (_rid), {_rn_flag(REVIEW_COLUMNS, [], 'dqa_is_duplicate')},
             {_rn_flag(['id'], [c for c in REVIEW_COLUMNS if c != 'id'], 'dqa_is_duplicate_review_id')}
      FROM (SELECT *, row_number() OVER () AS _rid FROM s)) f
CROSS JOIN bs CROSS JOIN bc
"""


_REV_FLAGS_SQL = rev_flags_sql(TEST_DATE_BOUNDS)


def review_flags(spark, sf):
    return Q.assess_quality(noisy_reviews(spark, sf), text_column=None, date_bounds=TEST_DATE_BOUNDS)


@register("dqa_flags_reviews", sql=with_views(_REV_FLAGS_SQL, r=REVIEWS_SQL, s=NOISY_REVIEWS_SQL,
                                              bs=_outlier_cte("s", "vote_sum"), bc=_outlier_cte("s", "vote_count")))
def dqa_flags_reviews(spark, sf):
    return review_flags(spark, sf)


# ------------------------------------------------------------------ A5 / A6
def _overview_sql(flags_sql, flags, **views):
    n = "(SELECT count(*) FROM f)"
    parts = [f"SELECT '{c}' AS flag, count_if({c})::BIGINT AS count, count_if({c}) * 100.0 / {n} AS percent FROM f"
             for c in flags]
    return with_views("\nUNION ALL\n".join(parts), **views, f=flags_sql)


DOC_FLAG_NAMES = ["dqa_is_duplicate", "dqa_is_duplicate_review_id", "dqa_has_null_values", "dqa_has_emojis",
                  "dqa_has_excessive_special_chars", "dqa_has_invalid_rating", "dqa_contains_email",
                  "dqa_contains_url", "dqa_contains_phone_number", "dqa_vote_count_outlier"]
REV_FLAG_NAMES = ["dqa_is_duplicate", "dqa_is_duplicate_review_id", "dqa_has_null_values",
                  "dqa_has_invalid_date", "dqa_has_invalid_rating", "dqa_vote_sum_outlier", "dqa_vote_count_outlier"]


@register("dqa_overview", sql=_overview_sql(_DOC_FLAGS_SQL, DOC_FLAG_NAMES, d=DOC_REVIEWS_SQL,
                                            b=_outlier_cte("d", "vote_count")), dbl=["percent"])
def dqa_overview(spark, sf):
    return R.dqa_overview(doc_flags(spark, sf))


_CFG_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{c}', '{m}')" for i, c, m in K.IMPACT_CONFIG) + \
           ") AS t(issue, characteristic, impact)"


@register("dqa_report", sql=with_views(
    "SELECT cfg.characteristic, cfg.impact, o.count, round_even(o.percent, 2) AS percent "
    "FROM o LEFT JOIN cfg ON o.flag = cfg.issue",
    o=_overview_sql(_REV_FLAGS_SQL, REV_FLAG_NAMES, r=REVIEWS_SQL, s=NOISY_REVIEWS_SQL,
                    bs=_outlier_cte("s", "vote_sum"), bc=_outlier_cte("s", "vote_count")),
    cfg=_CFG_SQL), dbl=["percent"])
def dqa_report(spark, sf):
    return R.dqa_report(review_flags(spark, sf))


# ------------------------------------------------------------------ P8
_CLEAN_REV = [i for i in C.issues_to_remove() if i in REV_FLAG_NAMES]


@register("clean_reviews", sql=with_views(
    f"SELECT {', '.join(REVIEW_COLUMNS)} FROM f WHERE NOT ({' OR '.join(_CLEAN_REV)})",
    r=REVIEWS_SQL, s=NOISY_REVIEWS_SQL,
    bs=_outlier_cte("s", "vote_sum"), bc=_outlier_cte("s", "vote_count"), f=_REV_FLAGS_SQL))
def clean_reviews(spark, sf):
    return C.clean_reviews(review_flags(spark, sf), _CLEAN_REV)


@register("clean_summary", sql=with_views(
    f"SELECT count(*) AS original, count_if(NOT ({' OR '.join(_CLEAN_REV)}))::BIGINT AS cleaned, "
    f"count_if({' OR '.join(_CLEAN_REV)})::BIGINT AS removed FROM f",
    r=REVIEWS_SQL, s=NOISY_REVIEWS_SQL,
    bs=_outlier_cte("s", "vote_sum"), bc=_outlier_cte("s", "vote_count"), f=_REV_FLAGS_SQL))
def clean_summary(spark, sf):
    return C.clean_summary(review_flags(spark, sf), _CLEAN_REV)
