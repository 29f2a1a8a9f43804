"""Exploratory statistics over review tables (distributions, diversity,
inequality, correlation, bivariate summaries, text term tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.ordered import running
from revlens.functions.quantiles import exact_quantiles
from revlens.functions.stats import null_safe_join
from revlens.session import shared_table


def boxplot_stats(df: DataFrame, x: str) -> DataFrame:
    """Five-number summary (linear quartiles) and 1.5 IQR whisker fences."""
    ends = df.agg(F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"))
    s = ends.crossJoin(exact_quantiles(df, x, [0.25, 0.5, 0.75]))  # two one-row tables
    q1, q3 = F.col("q")[0], F.col("q")[2]
    iqr = q3 - q1
    return s.select(F.lit(x).alias("measure"), "min", q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"), "max",
                    (q1 - 1.5 * iqr).alias("lower_fence"), (q3 + 1.5 * iqr).alias("upper_fence"))


def _hist(df: DataFrame, x: str) -> DataFrame:
    return df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


# --------------------------------------------------------------------------- A19
def author_counts_by_category(df: DataFrame, key: str = "category", who: str = "author") -> DataFrame:
    """Per category: describe() of reviews per author over ALL authors,
    authors without a review in the category counted as 0.  The zeros are
    added arithmetically (one weighted histogram entry), never as a dense
    author x category table."""
    per = df.groupBy(key, who).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count_distinct(who).alias("N"))
    h = per.groupBy(key, "n").agg(F.count(F.lit(1)).alias("m"))
    present = h.groupBy(key).agg(F.sum("m").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"),
                                 F.sum(F.col("n") * F.col("n") * F.col("m")).alias("ss"), F.max("n").alias("mx"))
    present = present.crossJoin(total)
    zeros = present.select(key, F.lit(0).cast("bigint").alias("n"), (F.col("N") - F.col("k")).alias("m"))
    hz = h.unionByName(zeros).where(F.col("m") > 0)
    q = null_safe_join(exact_quantiles(hz, "n", [0.25, 0.5, 0.75], by=[key], weight="m").withColumnRenamed("q", "_q"),
                       hz.groupBy(key).agg(F.min("n").cast("double").alias("min")), [key])
    N = F.col("N").cast("double")
    mean = F.col("s") / N
    var = (F.col("ss") - F.col("s") * F.col("s") / N) / (N - 1)
    out = null_safe_join(present, q, [key])
    return out.select(key, F.col("N").alias("count"), mean.alias("mean"),
                      F.when(N > 1, F.sqrt(var)).alias("std"), "min",
                      F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"),
                      F.col("mx").cast("double").alias("max"))


# --------------------------------------------------------------------------- A20 / A21
def reviews_by_period(df: DataFrame, date_column: str = "date") -> DataFrame:
    """Row counts by year, month name, weekday name and year-month."""
    d = F.col(date_column)
    kinds = {"year": F.date_format(d, "yyyy"), "month": F.date_format(d, "MMMM"),
             "weekday": F.date_format(d, "EEEE"), "year_month": F.date_format(d, "yyyy-MM"),
             "day": F.date_format(d, "yyyy-MM-dd")}
    e = F.explode(F.array(*[F.struct(F.lit(k).alias("period_type"), v.alias("period")) for k, v in kinds.items()]))
    return (df.select(e.alias("_e")).select("_e.*")
              .groupBy("period_type", "period").agg(F.count(F.lit(1)).alias("count")))


def rating_trend(df: DataFrame, unit: str = "month", date_column: str = "date", rating: str = "rating") -> DataFrame:
    """Reviews and mean rating per period, with change from the previous
    period (window over the aggregated periods only)."""
    # date_trunc yields a zoned timestamp; back to wall-clock (NTZ) values
    g = (df.groupBy(F.date_trunc(unit, F.col(date_column)).cast("timestamp_ntz").alias("period"))
           .agg(F.count(F.lit(1)).alias("reviews"), F.avg(rating).alias("avg_rating")))
    w = Window.orderBy("period")  # one row per period
    return g.select("period", "reviews", "avg_rating",
                    (F.col("reviews") - F.lag("reviews").over(w)).alias("reviews_change"),
                    (F.col("avg_rating") - F.lag("avg_rating").over(w)).alias("avg_rating_change"))


# --------------------------------------------------------------------------- A22
def histogram(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max]: bin, bounds, midpoint, count,
    running count and running share (frequency polygon / ogive points)."""
    mm = df.agg(F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"),
                F.count(F.col(x)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(mm)).select(
        F.least(F.floor(F.when(width > 0, (F.col(x) - F.col("_lo")) / width).otherwise(0)), F.lit(bins - 1))
        .cast("int").alias("bin"), "_lo", "_hi", "_n")
    g = b.groupBy("bin", "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("count"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # <= bins rows
    wd = (F.col("_hi") - F.col("_lo")) / bins
    return g.select("bin", (F.col("_lo") + F.col("bin") * wd).alias("lower"),
                    (F.col("_lo") + (F.col("bin") + 1) * wd).alias("upper"),
                    (F.col("_lo") + (F.col("bin") + 0.5) * wd).alias("midpoint"), "count",
                    F.sum("count").over(w).alias("cumulative"),
                    (F.sum("count").over(w) / F.col("_n")).alias("cumulative_share"))


# --------------------------------------------------------------------------- A24 - A27
def diversity_index(df: DataFrame, x: str) -> DataFrame:
    """Simpson (1 - sum p^2) and Shannon (-sum p ln p) over value shares."""
    h = _hist(df, x)
    t = h.agg(F.sum("_c").alias("_t"))
    p = h.crossJoin(F.broadcast(t)).select((F.col("_c") / F.col("_t")).alias("p"))
    return p.agg((1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"),
                 (-F.sum(F.col("p") * F.ln("p"))).alias("shannon"),
                 F.count(F.lit(1)).alias("values"))


def lorenz_gini(df: DataFrame, who: str = "author") -> DataFrame:
    """Lorenz curve of reviews per ``who`` and the Gini coefficient.

    Keys are grouped by their review count first; the running sums over the
    distinct counts go by range partitions.  With counts sorted ascending, the
    m keys of count c occupy ranks P+1..P+m, so their share of sum(i * n_i) is
    c * (m * P + m (m + 1) / 2).
    """
    per = df.groupBy(who).agg(F.count(F.lit(1)).alias("n"))
    lv = per.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    lv = running(lv, ["n"], {"P": F.col("m"), "before": F.col("n") * F.col("m")})
    tot = lv.agg(F.sum("m").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"),
                 F.sum(F.col("n").cast("double") * (F.col("m").cast("double") * F.col("P") + F.col("m").cast("double") * (F.col("m") + 1) / 2)).alias("si"))
    gini = tot.select("k", "s", (2 * F.col("si") / (F.col("k").cast("double") * F.col("s")) - (F.col("k") + 1) / F.col("k")).alias("gini"))
    return lv.crossJoin(gini).select(
        F.col("n").alias("reviews_per_key"), F.col("m").alias("keys"),
        ((F.col("P") + F.col("m")) / F.col("k")).alias("cum_key_share"),
        ((F.col("before") + F.col("n") * F.col("m")) / F.col("s")).alias("cum_review_share"), "gini")


def frequency_spread(df: DataFrame, x: str) -> DataFrame:
    """Mean, variance and std of the value frequencies of ``x``."""
    h = _hist(df, x)
    return h.agg(F.count(F.lit(1)).alias("values"), F.avg("_c").alias("mean_freq"),
                 F.var_samp("_c").alias("var_freq"), F.stddev_samp("_c").alias("std_freq"))


def all_modes(df: DataFrame, x: str) -> DataFrame:
    """Every value tied at the highest frequency."""
    h = _hist(df, x)
    top = h.agg(F.max("_c").alias("_m"))
    return h.join(F.broadcast(top), h._c == top._m).select(F.col("_v").alias(x), F.col("_c").alias("count"))


def pareto(df: DataFrame, x: str) -> DataFrame:
    """All values by descending count (ties by value) with running count and
    running percent.  The running count goes by ranges of (count, value), so
    values that share one count are spread over tasks too."""
    h = running(_hist(df, x), [F.col("_c").desc(), "_v"], {"before": F.col("_c")})
    total = h.agg(F.sum("_c").alias("_t"))
    j = h.crossJoin(F.broadcast(total)).withColumn("cumulative", F.col("before") + F.col("_c"))  # one row
    return j.select(F.col("_v").alias(x), F.col("_c").alias("count"), "cumulative",
                    (F.col("cumulative") * 100.0 / F.col("_t")).alias("cumulative_percent"))


# --------------------------------------------------------------------------- A28 - A31
def correlation(df: DataFrame, columns) -> DataFrame:
    """Pearson correlation of every column pair, one aggregation."""
    cols = list(columns)
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}"))
            pairs.append((a, b))
    one = df.agg(*aggs)
    e = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}__{b}").alias("r"))
                            for a, b in pairs]))
    return one.select(e.alias("_e")).select("_e.*")


def rating_vs_measures(df: DataFrame, rating: str = "rating",
                       measures=("review_length", "vote_count", "vote_sum")) -> DataFrame:
    return df.groupBy(rating).agg(F.count(F.lit(1)).alias("reviews"),
                                  *[F.avg(m).alias(f"avg_{m}") for m in measures])


def rating_distribution(df: DataFrame, key: str = "category", rating: str = "rating") -> DataFrame:
    g = df.groupBy(key, rating).agg(F.count(F.lit(1)).alias("count"))
    whole = F.sum("count").over(Window.partitionBy(key))  # over a group's ratings, not its rows
    return g.select(key, rating, "count", (F.col("count") / whole).alias("share"))


def top_apps_per_category(df: DataFrame, n: int = 3, key: str = "category", app: str = "app_name") -> DataFrame:
    """The n most-reviewed apps per category (ties by name): rank over the
    aggregated (category, app) table, not over review rows."""
    g = df.groupBy(key, app).agg(F.count(F.lit(1)).alias("reviews"))
    w = Window.partitionBy(key).orderBy(F.col("reviews").desc(), F.col(app).asc_nulls_first())
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def active_users(df: DataFrame, unit: str = "day", date_column: str = "ts", who: str = "user_id") -> DataFrame:
    return (df.groupBy(F.date_trunc(unit, F.col(date_column)).cast("timestamp_ntz").alias("period"))
              .agg(F.count_distinct(who).alias("active_users"), F.count(F.lit(1)).alias("events")))


def extreme_raters(df: DataFrame, who: str = "author", rating: str = "rating", low: int = 1, high: int = 5) -> DataFrame:
    """Authors whose every rating is ``low`` or every rating is ``high``."""
    g = df.groupBy(who).agg(F.min(rating).alias("_mn"), F.max(rating).alias("_mx"), F.count(F.lit(1)).alias("reviews"))
    return g.where((F.col("_mn") == F.col("_mx")) & F.col("_mn").isin(low, high)).select(
        who, F.col("_mn").alias("rating"), "reviews")


def multi_review_authors(df: DataFrame, who: str = "author", min_reviews: int = 2) -> DataFrame:
    return (df.groupBy(who).agg(F.count(F.lit(1)).alias("reviews"))
              .where(F.col("reviews") >= min_reviews))


# --------------------------------------------------------------------------- A32
def qq_points(df: DataFrame, x: str, points: int = 99) -> DataFrame:
    """Sample quantiles (linear) against standard-normal quantiles at
    p = i / (points + 1).  The grid of theoretical values is a fixed
    ``points``-row table; all sample quantiles come from one selection."""
    from statistics import NormalDist
    grid = [(i, i / (points + 1), NormalDist().inv_cdf(i / (points + 1))) for i in range(1, points + 1)]
    g = df.sparkSession.createDataFrame(grid, "i int, p double, theoretical double")
    q = exact_quantiles(df, x, [p for _, p, _ in grid])
    return g.crossJoin(q).select("i", "p", "theoretical", F.element_at("q", F.col("i")).alias("sample"))


# --------------------------------------------------------------------------- A33 / A34
def term_frequency(df: DataFrame, tokens_column: str, key: str | None = None) -> DataFrame:
    """Term counts overall (or per ``key``) from an array column."""
    cols = [key] if key else []
    e = df.select(*cols, F.explode(F.col(tokens_column)).alias("term"))
    return e.groupBy(*cols, "term").agg(F.count(F.lit(1)).alias("count"))


def tfidf_top_terms(df: DataFrame, tokens_column: str, key: str, doc_key: str = "id", n: int = 5) -> DataFrame:
    """Per group: the n terms with the highest tf * idf, where tf = term
    count in the group and idf = ln(documents / documents containing the
    term).  A document that is one row gives its terms where it is, each with
    its first place marked, so that both figures are sums with map-side combine;
    only the terms of documents of several rows are counted by document."""
    twice = shared_table(df.select(doc_key).groupBy(doc_key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-documents")
    rows, again = df.select(key, doc_key, tokens_column), None
    if not twice.isEmpty():
        marks = twice.select(F.col(doc_key).alias("_id"))
        same = rows[doc_key].eqNullSafe(marks["_id"])
        rows, again = rows.join(marks, same, "left_anti"), rows.join(marks, same, "left_semi")
    one = lambda c, tf, first: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(tf).alias("tf"), F.lit(first).alias("df")))
    tokens = F.col(tokens_column)
    e = rows.select(key, F.explode(F.concat(one(tokens, 1, 0), one(F.array_distinct(tokens), 0, 1))).alias("_t")).select(key, "_t.*")
    c = e.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    if again is not None:
        d = again.select(key, doc_key, F.explode(tokens).alias("term")).groupBy("term", doc_key, key).agg(F.count(F.lit(1)).alias("tf"))
        # a document counts once for a term, in one of its groups
        once = d.groupBy("term", doc_key).agg(F.min(F.struct(key)).alias("_g")).select(F.col(f"_g.{key}").alias(key), "term")
        more = d.select(key, "term", "tf", F.lit(0).cast("long").alias("df")).unionByName(once.select(key, "term", F.lit(0).cast("long").alias("tf"), F.lit(1).cast("long").alias("df")))
        c = c.unionByName(more).groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    c = shared_table(c, "term-counts")
    tf = c.select(key, "term", "tf")
    dfreq = c.groupBy("term").agg(F.sum("df").alias("df"))
    ndocs = df.agg(F.count(F.lit(1)).alias("_N"))
    s = (tf.join(dfreq, "term").crossJoin(F.broadcast(ndocs))
           .withColumn("tfidf", F.col("tf") * F.ln(F.col("_N") / F.col("df"))))
    w = Window.partitionBy(key).orderBy(F.col("tfidf").desc(), F.col("term"))
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
             .select(key, "term", "tf", "df", "tfidf", "rank"))


def collocations(df: DataFrame, tokens_column: str, min_count: int = 1) -> DataFrame:
    """Adjacent word pairs seen at least ``min_count`` times with their
    pointwise mutual information ln(p(xy) / (p(x) p(y)))."""
    from revlens.functions.text import let
    pairs = let(F.col(tokens_column), lambda t: F.zip_with(
        t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("w1"), b.alias("w2"))))
    e = df.select(F.explode(pairs).alias("_p"))
    # counted once and stored; the last word of a text stands with a null, so the pairs' first words are all words
    both = shared_table(e.select("_p.w1", "_p.w2").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("count")), "word-pairs")
    big = both.where(F.col("w2").isNotNull())
    uni = shared_table(both.groupBy(F.col("w1").alias("term")).agg(F.sum("count").alias("count")), "words")
    nu = uni.agg(F.sum("count").alias("_nu"))
    nb = big.agg(F.sum("count").alias("_nb"))
    keep = big.where(F.col("count") >= min_count)
    u1 = uni.select(F.col("term").alias("w1"), F.col("count").alias("c1"))
    u2 = uni.select(F.col("term").alias("w2"), F.col("count").alias("c2"))
    j = keep.join(u1, "w1").join(u2, "w2").crossJoin(F.broadcast(nu)).crossJoin(F.broadcast(nb))
    pmi = F.ln((F.col("count") / F.col("_nb")) / ((F.col("c1") / F.col("_nu")) * (F.col("c2") / F.col("_nu"))))
    return j.select("w1", "w2", "count", pmi.alias("pmi"))


# --------------------------------------------------------------------------- L3
def first_reviews(df: DataFrame, n: int = 5, date_column: str = "date", key: str = "id",
                  newest: bool = False) -> DataFrame:
    """The n earliest (or newest) reviews, ties by id: a top-n (each task
    keeps n rows, the driver merges n x tasks rows), not a global sort."""
    o = [F.col(date_column).desc() if newest else F.col(date_column).asc(), F.col(key).asc()]
    return df.orderBy(*o).limit(n)


def describe_by(df: DataFrame, x: str, by: str) -> DataFrame:
    """describe() of ``x`` per group of ``by`` (quartiles by distributed
    selection, so a hot group is spread over tasks)."""
    base = df.groupBy(by).agg(F.count(F.col(x)).alias("count"), F.avg(x).alias("mean"),
                              F.stddev_samp(x).alias("std"), F.min(x).cast("double").alias("min"),
                              F.max(x).cast("double").alias("max"))
    q = exact_quantiles(df, x, [0.25, 0.5, 0.75], by=[by]).withColumnRenamed("q", "_q")
    j = null_safe_join(base, q, [by], "left")
    return j.select(by, "count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
                    F.col("_q")[2].alias("p75"), "max")
