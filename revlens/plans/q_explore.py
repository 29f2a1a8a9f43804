"""Exploratory statistics and term tables."""

from statistics import NormalDist

from pyspark.sql import functions as F

from revlens.operators import explore as X
from revlens.operators import latent as LT
from revlens.operators import textprep as P
from revlens.plans.q_features import NSVIEW, TOKVIEW, _ngram_sql
from revlens.plans.registry import register
from revlens.plans.sqlgen import with_views
from revlens.sources.tables import DOC_REVIEWS_SQL, REVIEWS_SQL, doc_reviews, reviews, table

_DESC = ["mean", "std", "min", "p25", "p50", "p75", "max"]


def _ns_docs(spark, sf):
    d = doc_reviews(spark, sf)
    return d.select("id", "category", P.remove_stopwords(P.normalize_tokens(P.tokenize(F.col("content")))).alias("ns"))


@register("author_counts_by_category", sql=with_views(
    """SELECT c.category, count(*) AS count, avg(coalesce(p.n, 0)) AS mean, stddev_samp(coalesce(p.n, 0)) AS std,
              min(coalesce(p.n, 0))::DOUBLE AS min, quantile_cont(coalesce(p.n, 0), 0.25) AS p25,
              quantile_cont(coalesce(p.n, 0), 0.5) AS p50, quantile_cont(coalesce(p.n, 0), 0.75) AS p75,
              max(coalesce(p.n, 0))::DOUBLE AS max
       FROM (SELECT DISTINCT category FROM r) c CROSS JOIN (SELECT DISTINCT author FROM r) a
       LEFT JOIN (SELECT category, author, count(*) AS n FROM r GROUP BY category, author) p
         ON p.category = c.category AND p.author = a.author
       GROUP BY c.category""", r=REVIEWS_SQL), dbl=_DESC)
def author_counts_by_category(spark, sf):
    return X.author_counts_by_category(reviews(spark, sf))


@register("reviews_by_period", sql=with_views(
    """SELECT 'year' AS period_type, strftime(date, '%Y') AS period, count(*) AS count FROM r GROUP BY 2
       UNION ALL SELECT 'month', strftime(date, '%B'), count(*) FROM r GROUP BY 2
       UNION ALL SELECT 'weekday', strftime(date, '%A'), count(*) FROM r GROUP BY 2
       UNION ALL SELECT 'year_month', strftime(date, '%Y-%m'), count(*) FROM r GROUP BY 2
       UNION ALL SELECT 'day', strftime(date, '%Y-%m-%d'), count(*) FROM r GROUP BY 2""", r=REVIEWS_SQL))
def reviews_by_period(spark, sf):
    return X.reviews_by_period(reviews(spark, sf))


@register("rating_trend", sql=with_views(
    """SELECT period, reviews, avg_rating, reviews - lag(reviews) OVER (ORDER BY period) AS reviews_change,
              avg_rating - lag(avg_rating) OVER (ORDER BY period) AS avg_rating_change
       FROM (SELECT date_trunc('month', date) AS period, count(*) AS reviews, avg(rating) AS avg_rating
             FROM r GROUP BY 1)""", r=REVIEWS_SQL), dbl=["avg_rating", "avg_rating_change"])
def rating_trend(spark, sf):
    return X.rating_trend(reviews(spark, sf))


@register("histogram", sql=with_views(
    """SELECT bin, lo + bin * (hi - lo) / 10 AS lower, lo + (bin + 1) * (hi - lo) / 10 AS upper,
              lo + (bin + 0.5) * (hi - lo) / 10 AS midpoint, count,
              (sum(count) OVER (ORDER BY bin))::BIGINT AS cumulative, sum(count) OVER (ORDER BY bin) / n AS cumulative_share
       FROM (SELECT least(floor(CASE WHEN (hi - lo) / 10 > 0 THEN (vote_count - lo) / ((hi - lo) / 10) ELSE 0 END), 9)::INT AS bin,
                    lo, hi, n, count(*) AS count
             FROM d, (SELECT min(vote_count)::DOUBLE AS lo, max(vote_count)::DOUBLE AS hi, count(vote_count) AS n FROM d) m
             WHERE vote_count IS NOT NULL GROUP BY 1, 2, 3, 4)""", d=DOC_REVIEWS_SQL),
    dbl=["lower", "upper", "midpoint", "cumulative_share"])
def histogram(spark, sf):
    return X.histogram(doc_reviews(spark, sf), "vote_count", 10)


@register("diversity_index", sql=with_views(
    """SELECT 1 - sum(p * p) AS simpson, -sum(p * ln(p)) AS shannon, count(*) AS "values"
       FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM r WHERE category IS NOT NULL GROUP BY category)""",
    r=REVIEWS_SQL), dbl=["simpson", "shannon"])
def diversity_index(spark, sf):
    return X.diversity_index(reviews(spark, sf), "category")


@register("lorenz_gini", sql=with_views(
    """SELECT n AS reviews_per_key, m AS keys, cum_keys / k AS cum_key_share, cum_reviews / s AS cum_review_share,
              g.gini
       FROM (SELECT n, count(*) AS m, sum(count(*)) OVER (ORDER BY n) AS cum_keys,
                    sum(n * count(*)) OVER (ORDER BY n) AS cum_reviews
             FROM (SELECT author, count(*) AS n FROM r GROUP BY author) GROUP BY n) lv,
            (SELECT count(*) AS k, sum(n) AS s,
                    2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) AS gini
             FROM (SELECT n, row_number() OVER (ORDER BY n) AS i
                   FROM (SELECT author, count(*) AS n FROM r GROUP BY author))) g""", r=REVIEWS_SQL),
    dbl=["cum_key_share", "cum_review_share", "gini"])
def lorenz_gini(spark, sf):
    return X.lorenz_gini(reviews(spark, sf), "author")


@register("frequency_spread", sql=with_views(
    """SELECT count(*) AS "values", avg(c) AS mean_freq, var_samp(c) AS var_freq, stddev_samp(c) AS std_freq
       FROM (SELECT app_name, count(*) AS c FROM r WHERE app_name IS NOT NULL GROUP BY app_name)""", r=REVIEWS_SQL),
    dbl=["mean_freq", "var_freq", "std_freq"])
def frequency_spread(spark, sf):
    return X.frequency_spread(reviews(spark, sf), "app_name")


@register("all_modes", sql=with_views(
    """SELECT rating, count FROM (SELECT rating, count(*) AS count, max(count(*)) OVER () AS m FROM r
       WHERE rating IS NOT NULL GROUP BY rating) WHERE count = m""", r=REVIEWS_SQL))
def all_modes(spark, sf):
    return X.all_modes(reviews(spark, sf), "rating")


@register("pareto", sql=with_views(
    """SELECT app_name, c AS count, (sum(c) OVER w)::BIGINT AS cumulative, sum(c) OVER w * 100.0 / sum(c) OVER () AS cumulative_percent
       FROM (SELECT app_name, count(*) AS c FROM r WHERE app_name IS NOT NULL GROUP BY app_name)
       WINDOW w AS (ORDER BY c DESC, app_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", r=REVIEWS_SQL),
    dbl=["cumulative_percent"])
def pareto(spark, sf):
    return X.pareto(reviews(spark, sf), "app_name")


@register("correlation", sql=with_views(
    """SELECT 'rating' AS x, 'review_length' AS y, corr(rating, review_length) AS r FROM r
       UNION ALL SELECT 'rating', 'vote_count', corr(rating, vote_count) FROM r
       UNION ALL SELECT 'rating', 'vote_sum', corr(rating, vote_sum) FROM r
       UNION ALL SELECT 'review_length', 'vote_count', corr(review_length, vote_count) FROM r
       UNION ALL SELECT 'review_length', 'vote_sum', corr(review_length, vote_sum) FROM r
       UNION ALL SELECT 'vote_count', 'vote_sum', corr(vote_count, vote_sum) FROM r""", r=REVIEWS_SQL), dbl=["r"])
def correlation(spark, sf):
    return X.correlation(reviews(spark, sf), ["rating", "review_length", "vote_count", "vote_sum"])


@register("rating_vs_measures", sql=with_views(
    "SELECT rating, count(*) AS reviews, avg(review_length) AS avg_review_length, avg(vote_count) AS avg_vote_count, "
    "avg(vote_sum) AS avg_vote_sum FROM r GROUP BY rating", r=REVIEWS_SQL),
    dbl=["avg_review_length", "avg_vote_count", "avg_vote_sum"])
def rating_vs_measures(spark, sf):
    return X.rating_vs_measures(reviews(spark, sf))


@register("rating_distribution", sql=with_views(
    "SELECT category, rating, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY category) AS share "
    "FROM r GROUP BY category, rating", r=REVIEWS_SQL), dbl=["share"])
def rating_distribution(spark, sf):
    return X.rating_distribution(reviews(spark, sf))


@register("top_apps_per_category", sql=with_views(
    "SELECT category, app_name, reviews, rank::INTEGER AS rank FROM (SELECT category, app_name, count(*) AS reviews, "
    "row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, app_name NULLS FIRST) AS rank "
    "FROM r GROUP BY category, app_name) WHERE rank <= 3", r=REVIEWS_SQL))
def top_apps_per_category(spark, sf):
    return X.top_apps_per_category(reviews(spark, sf), 3)


@register("active_users", sql="SELECT date_trunc('day', ts) AS period, count(DISTINCT user_id) AS active_users, "
                              "count(*) AS events FROM events GROUP BY 1")
def active_users(spark, sf):
    return X.active_users(table(spark, sf, "events"))


@register("extreme_raters", sql=with_views(
    "SELECT author, min(rating) AS rating, count(*) AS reviews FROM r GROUP BY author "
    "HAVING min(rating) = max(rating) AND min(rating) IN (1, 5)", r=REVIEWS_SQL))
def extreme_raters(spark, sf):
    return X.extreme_raters(reviews(spark, sf))


@register("extreme_orders", sql=with_views(
    "SELECT split_part(id, '-', 1) AS order_no, min(rating) AS rating, count(*) AS reviews FROM r GROUP BY 1 "
    "HAVING min(rating) = max(rating) AND min(rating) IN (1, 5)", r=REVIEWS_SQL))
def extreme_orders(spark, sf):
    """Groups whose ratings all agree: orders of one line."""
    return X.extreme_raters(reviews(spark, sf).withColumn("order_no", F.substring_index("id", "-", 1)), "order_no")


@register("multi_review_authors", sql=with_views(
    "SELECT author, count(*) AS reviews FROM r GROUP BY author HAVING count(*) >= 2", r=REVIEWS_SQL))
def multi_review_authors(spark, sf):
    return X.multi_review_authors(reviews(spark, sf))


_GRID = [(i, i / 100, NormalDist().inv_cdf(i / 100)) for i in range(1, 100)]


@register("qq_points", sql=with_views(
    "SELECT g.i, g.p::DOUBLE AS p, g.theoretical::DOUBLE AS theoretical, q.qs[g.i] AS sample FROM g, "
    "(SELECT quantile_cont(vote_count, [" + ", ".join(repr(p) for _, p, _ in _GRID) + "]::DOUBLE[]) AS qs FROM d) q",
    d=DOC_REVIEWS_SQL,
    g="SELECT * FROM (VALUES " + ", ".join(f"({i}, {p!r}, {t!r})" for i, p, t in _GRID) + ") t(i, p, theoretical)"),
    dbl=["p", "theoretical", "sample"])
def qq_points(spark, sf):
    return X.qq_points(doc_reviews(spark, sf), "vote_count", 99)


# ------------------------------------------------------------------ A33 / A34
@register("word_frequency", sql=with_views("SELECT unnest(ns) AS term, count(*) AS count FROM n GROUP BY 1",
                                           d=DOC_REVIEWS_SQL, t=TOKVIEW, n=NSVIEW))
def word_frequency(spark, sf):
    return X.term_frequency(_ns_docs(spark, sf), "ns")


@register("ngram_frequency", sql=with_views(
    f"SELECT category, unnest({_ngram_sql('ns', 2)}) AS term, count(*) AS count FROM n GROUP BY 1, 2",
    d=DOC_REVIEWS_SQL, t=TOKVIEW, n=f"SELECT t.id, d.category, ns FROM ({NSVIEW}) t JOIN d ON t.id = d.id"))
def ngram_frequency(spark, sf):
    d = _ns_docs(spark, sf)
    return X.term_frequency(d.select("category", P.bigrams(F.col("ns")).alias("bg")), "bg", "category")


@register("tfidf_top_terms", sql=with_views(
    """SELECT category, term, tf, df, tfidf, rank::INTEGER AS rank FROM (
         SELECT tf.category, tf.term, tf.tf, dfr.df, tf.tf * ln(nd.n / dfr.df) AS tfidf,
                row_number() OVER (PARTITION BY tf.category ORDER BY tf.tf * ln(nd.n / dfr.df) DESC, tf.term) AS rank
         FROM (SELECT category, term, count(*) AS tf FROM e GROUP BY 1, 2) tf
         JOIN (SELECT term, count(DISTINCT id) AS df FROM e GROUP BY 1) dfr ON tf.term = dfr.term
         CROSS JOIN (SELECT count(*) AS n FROM d) nd) WHERE rank <= 5""",
    d=DOC_REVIEWS_SQL, t=TOKVIEW, n=NSVIEW,
    e="SELECT n.id, d.category, unnest(n.ns) AS term FROM n JOIN d ON n.id = d.id"), dbl=["tfidf"])
def tfidf_top_terms(spark, sf):
    return X.tfidf_top_terms(_ns_docs(spark, sf), "ns", "category", "id", 5)


@register("collocations", sql=with_views(
    """SELECT b.w1, b.w2, b.count,
              ln((b.count / nb.t) / ((u1.count / nu.t) * (u2.count / nu.t))) AS pmi
       FROM (SELECT w1, w2, count(*) AS count FROM p GROUP BY 1, 2) b
       JOIN u u1 ON u1.term = b.w1 JOIN u u2 ON u2.term = b.w2,
            (SELECT count(*) AS t FROM p) nb, (SELECT sum(count) AS t FROM u) nu
""",
    d=DOC_REVIEWS_SQL, t=TOKVIEW, n=NSVIEW,
    p="SELECT unnest(list_transform(range(1, len(ns)), lambda i: {'w1': ns[i], 'w2': ns[i + 1]}), recursive := true) FROM n",
    u="SELECT unnest(ns) AS term, count(*) AS count FROM n GROUP BY 1"), dbl=["pmi"])
def collocations(spark, sf):
    return X.collocations(_ns_docs(spark, sf), "ns")


@register("cluster_texts")
def cluster_texts(spark, sf):
    """TF-IDF + K-means cluster per document with PCA coordinates (rows check)."""
    return LT.cluster_texts(_ns_docs(spark, sf).select("id", "ns"), "ns", k=8)


@register("topics")
def topics(spark, sf):
    """Topics over the stop-word-free tokens (rows check)."""
    return LT.topics(_ns_docs(spark, sf), "ns", k=5)


@register("first_reviews", sql=with_views(
    "SELECT * FROM r ORDER BY date, id LIMIT 5", r="SELECT id, author, date FROM (" + REVIEWS_SQL + ")"))
def first_reviews(spark, sf):
    return X.first_reviews(reviews(spark, sf).select("id", "author", "date"), 5)


@register("last_reviews", sql=with_views(
    "SELECT * FROM r ORDER BY date DESC, id LIMIT 5", r="SELECT id, author, date FROM (" + REVIEWS_SQL + ")"))
def last_reviews(spark, sf):
    return X.first_reviews(reviews(spark, sf).select("id", "author", "date"), 5, newest=True)


@register("describe_numeric_by_category", sql=with_views(
    "SELECT category, count(vote_count) AS count, avg(vote_count) AS mean, stddev_samp(vote_count) AS std, "
    "min(vote_count)::DOUBLE AS min, quantile_cont(vote_count, 0.25) AS p25, quantile_cont(vote_count, 0.5) AS p50, "
    "quantile_cont(vote_count, 0.75) AS p75, max(vote_count)::DOUBLE AS max FROM r GROUP BY category",
    r=REVIEWS_SQL), dbl=_DESC)
def describe_numeric_by_category(spark, sf):
    return X.describe_by(reviews(spark, sf), "vote_count", "category")
