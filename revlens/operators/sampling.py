"""Sampling, splitting, and test-noise injection.

All selection is by a seeded MD5 of the row key, so a sample is a pure
function of the data: recomputing a lost partition selects the same rows,
and DuckDB reproduces the choice exactly (``md5`` agrees across engines).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.ordered import running
from revlens.functions.stats import null_safe_join


def key_hash(cols: Sequence[str], seed: int) -> Column:
    """Seeded MD5 hex of the key columns."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hex_threshold(frac: float) -> str:
    """8-hex-digit bound: a uniform hash prefix is below it with probability ``frac``."""
    v = min(int(round(frac * 16 ** 8)), 16 ** 8 - 1)
    return f"{v:08x}"


def in_fraction(cols: Sequence[str], frac: float, seed: int) -> Column:
    return F.substring(key_hash(cols, seed), 1, 8) < F.lit(hex_threshold(frac))


def sample_by_hash(df: DataFrame, frac: float, seed: int = 42, key: Sequence[str] = ("id",)) -> DataFrame:
    """Deterministic Bernoulli sample: each key is kept with probability ``frac``."""
    return df.where(in_fraction(key, frac, seed)) if frac < 1 else df


def sample_exact(df: DataFrame, frac: float, seed: int = 42, key: Sequence[str] = ("id",)) -> DataFrame:
    """Exactly ``round_half_even(frac * n)`` rows: those with the smallest
    seeded hash (ties by key).

    No global sort: rows are counted per 5-hex-digit hash bucket (at most
    2^20 buckets) and running totals find the boundary bucket, one row that
    every task gets: rows below it are kept, and only the boundary bucket's
    rows (about n / 2^20) are ranked.
    """
    h = df.withColumn("_h", key_hash(key, seed)).withColumn("_b", F.substring("_h", 1, 5))
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    cum = running(counts, ["_b"], {"_before": F.col("_c")})
    total = cum.agg(F.bround(F.sum("_c") * frac, 0).cast("bigint").alias("_k"))  # one row
    inside = (F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_c"))
    edge = cum.crossJoin(F.broadcast(total)).where(inside).agg(F.max("_b").alias("_edge"), F.max(F.col("_k") - F.col("_before")).alias("_need"))
    j = h.crossJoin(F.broadcast(edge))  # one row; without an edge all rows are taken
    full = j.where("_edge is null or _b < _edge")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *key))
    part = j.where("_b = _edge").withColumn("_r", rank).where(F.col("_r") <= F.col("_need"))
    return full.unionByName(part.drop("_r")).drop("_h", "_b", "_edge", "_need")


def inject_test_rows(df: DataFrame, frac: float = 0.1, seed: int = 42, copies: int = 5,
                     text_column: str = "content", author_column: str = "author",
                     noisy_text: str | None = None, key: Sequence[str] = ("id",)) -> DataFrame:
    """A sample of ``frac`` of the rows; the one with the
    smallest hash gets noisy text and a null author and is appended
    ``copies`` times (duplicates to be caught by the quality flags)."""
    s = sample_by_hash(df, frac, seed, key)
    out = s
    if noisy_text is not None and text_column in df.columns:
        one = (s.withColumn("_h", key_hash(key, seed))
                .orderBy("_h").limit(1).drop("_h")           # one row: a top-1, not a cap
                .withColumn(text_column, F.lit(noisy_text)))
        if author_column in df.columns:
            one = one.withColumn(author_column, F.lit(None).cast(df.schema[author_column].dataType))
        rep = one.crossJoin(df.sparkSession.range(copies).select(F.col("id").alias("_copy"))).drop("_copy")
        out = out.unionByName(rep.select(*df.columns))
    return out


def inject_noise(df: DataFrame, seed: int = 42, frac: float = 0.1, null_column: str = "rating",
                 blank_column: str = "author", key: Sequence[str] = ("id",)) -> DataFrame:
    """Set ``null_column`` to NULL for one hash slice of rows and
    ``blank_column`` to "" for a disjoint slice."""
    h = F.substring(key_hash(key, seed), 1, 8)
    lo, hi = hex_threshold(frac), hex_threshold(2 * frac)
    out = df.withColumn(null_column, F.when(h >= F.lit(lo), F.col(null_column)))
    return out.withColumn(blank_column, F.when((h >= F.lit(lo)) & (h < F.lit(hi)), F.lit(""))
                                       .otherwise(F.col(blank_column)))


def stratified_sample(df: DataFrame, frac: float, strata: Sequence[str], seed: int = 42,
                      key: Sequence[str] = ("id",)) -> DataFrame:
    """Exactly ``round_half_even(frac * n_s)`` rows per stratum, smallest
    seeded hash first.  Ranking runs per (stratum, hash bucket): a stratum
    holding a third of all rows is spread over 4096 buckets, and bucket
    counts (bounded) give each bucket's starting rank."""
    h = df.withColumn("_h", key_hash(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    cnt = h.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    ws = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*strata)
    cnt = (cnt.withColumn("_off", F.coalesce(F.sum("_c").over(ws), F.lit(0)))
              .withColumn("_k", F.bround(F.sum("_c").over(wt) * frac, 0))
              .where(F.col("_off") < F.col("_k")))
    j = null_safe_join(h, cnt, [*strata, "_b"])
    w = Window.partitionBy(*strata, "_b").orderBy("_h", *key)
    return (j.withColumn("_r", F.row_number().over(w) + F.col("_off"))
             .where(F.col("_r") <= F.col("_k"))
             .drop("_h", "_b", "_c", "_off", "_k", "_r"))


def split_80_10_10(df: DataFrame, seed: int = 42, key: Sequence[str] = ("id",),
                   weights: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """Label each row train / validation / test by seeded hash: stable,
    disjoint and complete, with no shuffle."""
    h = F.substring(key_hash(key, seed), 1, 8)
    a = hex_threshold(weights[0])
    b = hex_threshold(weights[0] + weights[1])
    return df.withColumn("split", F.when(h < F.lit(a), "train").when(h < F.lit(b), "validation")
                         .otherwise("test"))
