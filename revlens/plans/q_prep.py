"""Normalisation, sampling, splits, unions."""

from pyspark.sql import functions as F

from revlens.operators import normalize as N
from revlens.operators import sampling as S
from revlens.plans.registry import register
from revlens.plans.sqlgen import with_views
from revlens.sources.tables import DOC_REVIEWS_SQL, REVIEWS_SQL, doc_reviews, reviews

NOISY_TEXT = "@@## damn ok (*)&^ see https://www.example.org now!! call (555) 555-1212 or mail someone@example.com #$%^&* :-)"
TEST_EXCLUDED = "src0"  # a category present in the test documents


def h(cols, seed=42):
    parts = ", ".join([f"'{seed}'"] + [f"coalesce(cast({c} AS VARCHAR), '')" for c in cols])
    return f"md5(concat_ws('|', {parts}))"


@register("normalize", sql=with_views(
    f"SELECT id, category, replace(content, chr(10), ' ') AS content, CAST(rating AS SMALLINT) AS rating FROM d "
    f"WHERE category IS DISTINCT FROM '{TEST_EXCLUDED}'", d=DOC_REVIEWS_SQL))
def normalize(spark, sf):
    d = doc_reviews(spark, sf).select("id", "category", "content", "rating")
    return N.normalize(d, {"rating": "smallint"}, "content", TEST_EXCLUDED)


@register("valid_utf8", sql=with_views("SELECT id, content, true AS valid FROM d", d=DOC_REVIEWS_SQL))
def valid_utf8(spark, sf):
    d = doc_reviews(spark, sf)
    # a broken sequence in every text: the repair must give the text back
    broken = F.concat(F.col("content").cast("binary"), F.unhex(F.lit("C328FF"))).cast("string")
    back = N.repair_utf8(broken)
    return d.select("id", F.substring(back, F.lit(1), F.length(back) - 1).alias("content"), F.is_valid_utf8(back).alias("valid"))


@register("cast_schema", sql=with_views(
    "SELECT id, app_id, app_name, category, author, CAST(rating AS SMALLINT) AS rating, "
    "CAST(review_length AS BIGINT) AS review_length, vote_count, vote_sum, date FROM r", r=REVIEWS_SQL))
def cast_schema(spark, sf):
    return N.cast_schema(reviews(spark, sf), {"rating": "smallint", "review_length": "bigint"})


@register("cast_project", sql=with_views(
    "SELECT id, CAST(rating AS DOUBLE) AS rating, CAST(vote_sum AS DOUBLE) AS vote_sum FROM r", r=REVIEWS_SQL),
    dbl=["rating", "vote_sum"])
def cast_project(spark, sf):
    return N.cast_project(reviews(spark, sf), {"id": "string", "rating": "double", "vote_sum": "double"})


@register("drop_incomplete", sql=with_views(
    "SELECT * FROM d WHERE id IS NOT NULL AND category IS NOT NULL AND lang IS NOT NULL AND content IS NOT NULL "
    "AND vote_count IS NOT NULL AND rating IS NOT NULL AND toxic IS NOT NULL", d=DOC_REVIEWS_SQL))
def drop_incomplete(spark, sf):
    return N.drop_incomplete(doc_reviews(spark, sf))


@register("drop_duplicates", sql=with_views("SELECT DISTINCT category, lang, content FROM d", d=DOC_REVIEWS_SQL))
def drop_duplicates(spark, sf):
    return N.drop_duplicates(doc_reviews(spark, sf).select("category", "lang", "content"))


@register("counts_with_total", sql=with_views(
    "SELECT CASE WHEN grouping(category) = 1 THEN 'Total' ELSE category END AS category, count(*) AS count "
    "FROM r GROUP BY ROLLUP (category)", r=REVIEWS_SQL))
def counts_with_total(spark, sf):
    return N.counts_with_total(reviews(spark, sf))


@register("union_sources", sql=with_views(
    "SELECT id, category, 'doc' AS kind FROM d UNION ALL SELECT id, category, 'review' AS kind FROM r",
    d=DOC_REVIEWS_SQL, r=REVIEWS_SQL))
def union_sources(spark, sf):
    d = doc_reviews(spark, sf).select("id", "category", F.lit("doc").alias("kind"))
    r = reviews(spark, sf).select("id", "category", F.lit("review").alias("kind"))
    return N.union_all([d, r])


# ------------------------------------------------------------------ L4 - L8
@register("sample_fraction", sql=with_views(
    f"SELECT id, category FROM d WHERE substr({h(['id'])}, 1, 8) < '{S.hex_threshold(0.1)}'", d=DOC_REVIEWS_SQL))
def sample_fraction(spark, sf):
    return S.sample_by_hash(doc_reviews(spark, sf).select("id", "category"), 0.1, 42)


@register("sample_exact", sql=with_views(
    f"SELECT id, category FROM d QUALIFY row_number() OVER (ORDER BY {h(['id'])}, id) "
    f"<= (SELECT round_even(count(*) * 0.1, 0) FROM d)", d=DOC_REVIEWS_SQL))
def sample_exact(spark, sf):
    return S.sample_exact(doc_reviews(spark, sf).select("id", "category"), 0.1, 42)


@register("stratified_sample", sql=with_views(
    f"SELECT id, category FROM d QUALIFY row_number() OVER (PARTITION BY category ORDER BY {h(['id'])}, id) "
    f"<= round_even(count(*) OVER (PARTITION BY category) * 0.25, 0)", d=DOC_REVIEWS_SQL))
def stratified_sample(spark, sf):
    return S.stratified_sample(doc_reviews(spark, sf).select("id", "category"), 0.25, ["category"], 42)


@register("stratified_sample_two", sql=with_views(
    f"SELECT id, category, lang FROM d QUALIFY row_number() OVER (PARTITION BY category, lang ORDER BY {h(['id'])}, id) "
    f"<= round_even(count(*) OVER (PARTITION BY category, lang) * 0.25, 0)", d=DOC_REVIEWS_SQL))
def stratified_sample_two(spark, sf):
    return S.stratified_sample(doc_reviews(spark, sf).select("id", "category", "lang"), 0.25, ["category", "lang"], 42)


@register("split_80_10_10", sql=with_views(
    f"SELECT id, CASE WHEN substr({h(['id'])}, 1, 8) < '{S.hex_threshold(0.8)}' THEN 'train' "
    f"WHEN substr({h(['id'])}, 1, 8) < '{S.hex_threshold(0.9)}' THEN 'validation' ELSE 'test' END AS split FROM d",
    d=DOC_REVIEWS_SQL))
def split_80_10_10(spark, sf):
    return S.split_80_10_10(doc_reviews(spark, sf).select("id"), 42)


@register("inject_noise", sql=with_views(
    f"SELECT id, CASE WHEN substr({h(['id'])}, 1, 8) >= '{S.hex_threshold(0.1)}' THEN rating END AS rating, "
    f"CASE WHEN substr({h(['id'])}, 1, 8) >= '{S.hex_threshold(0.1)}' AND substr({h(['id'])}, 1, 8) < "
    f"'{S.hex_threshold(0.2)}' THEN '' ELSE category END AS category FROM d", d=DOC_REVIEWS_SQL))
def inject_noise(spark, sf):
    d = doc_reviews(spark, sf).select("id", "rating", "category")
    return S.inject_noise(d, 42, 0.1, "rating", "category")


@register("inject_test_rows", sql=with_views(
    f"""SELECT id, category, content, author FROM s
        UNION ALL SELECT id, category, '{NOISY_TEXT}' AS content, NULL AS author FROM (SELECT * FROM s ORDER BY {h(['id'])} LIMIT 1),
                  range(5)""",
    d="SELECT id, category, content, lang AS author FROM (" + DOC_REVIEWS_SQL + ")",
    s=f"SELECT * FROM d WHERE substr({h(['id'])}, 1, 8) < '{S.hex_threshold(0.1)}'"))
def inject_test_rows(spark, sf):
    d = doc_reviews(spark, sf).select("id", "category", "content", F.col("lang").alias("author"))
    return S.inject_test_rows(d, 0.1, 42, 5, "content", "author", NOISY_TEXT)
