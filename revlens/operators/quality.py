"""Row-level data-quality flags (``dqa_*`` boolean columns).

Stateless checks (nulls, emoji, special characters, dates, ratings, e-mail,
URL, phone) are single column expressions, so a whole assessment is one
projection over the scan.  Two checks need data-wide state:

* duplicates: 128-bit digests of the row and of each key are counted with
  map-side combine (a hot key holding a third of the rows is reduced
  locally); only keys with more than one row are joined back, and the
  multiplicities of equal rows are re-expanded with ``explode(sequence(1, n))``;
* outliers: quartiles by distributed selection over a (value, count)
  histogram, then one scalar row cross-joined to every row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from revlens.functions import constants as K
from revlens.functions import text as T
from revlens.functions.quantiles import exact_quantiles
from revlens.session import shared_table


# --------------------------------------------------------------------------- duplicates
def row_digest(cols: Sequence[str]) -> Column:
    """128-bit digest of the columns, nulls told apart from values."""
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


#: Repeated keys up to which they are sent to every executor as a table.
FEW_KEYS = 1 << 20
#: Bits of the largest map of repeated keys (64 MB), and the most keys it serves.
MAP_BITS, MAP_KEYS = 1 << 29, 1 << 27


#: Rows of the largest key that one task sorts.
HOT = 100_000


def split_repeated(df: DataFrame, keys: Sequence[str], hot: int = HOT) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rows whose key no other row has, other rows, rows of keys with more than
    ``hot`` rows): hashes of 8 bytes are counted, and those seen twice come back.
    The second part holds every row of a repeated key, and a few others whose
    hash meets one.  A part without rows is None.  Up to ``MAP_KEYS`` hashes no
    row is shuffled whole.
    """
    parts = [x for c in keys for x in (F.col(c).isNull(), F.col(c))]
    h = F.xxhash64(F.lit(3), *parts)
    twice = shared_table(df.select(h.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "repeated-keys")
    n, large = twice.agg(F.count(F.lit(1)), F.count_if(F.col("_n") > hot)).first()
    if n == 0:
        return df, None, None
    if FEW_KEYS < n <= MAP_KEYS:
        met = _bit_map(twice, n)(h)
        single, other = df.where(~met), df.where(met).withColumn("_h", h)
    else:
        small, wide = F.broadcast(twice.select("_h")) if n <= FEW_KEYS else twice.select("_h"), df.withColumn("_h", h)
        single, other = wide.join(small, "_h", "left_anti").drop("_h"), wide.join(small, "_h", "left_semi")
    if large == 0:
        return single, other.drop("_h"), None
    big = F.broadcast(twice.where(F.col("_n") > hot).select("_h"))  # one in ``hot`` rows at most
    return single, other.join(big, "_h", "left_anti").drop("_h"), other.join(big, "_h", "left_semi").drop("_h")


def _bit_map(hashes: DataFrame, n: int):
    """Function from a hash to whether its bit is set in a map of all
    ``hashes``, which tasks pack in pieces of 8 KB."""
    piece = 1 << 16
    bits = min(max(1 << (16 * n - 1).bit_length(), piece), MAP_BITS)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(piece, bool)
        flags[rows["_at"].to_numpy() % piece] = True
        return pd.DataFrame({"_piece": rows["_piece"].iloc[:1], "_bits": [np.packbits(flags, bitorder="little").tobytes()]})

    at = F.col("_h").bitwiseAND(F.lit(bits - 1))
    pieces = hashes.select(at.alias("_at"), F.shiftright(at, 16).alias("_piece")).groupBy("_piece").applyInPandas(pack, "_piece long, _bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    for r in pieces.collect():  # at most 64 MB
        whole[r["_piece"] * (piece // 8):(r["_piece"] + 1) * (piece // 8)] = np.frombuffer(r["_bits"], np.uint8)
    sent = hashes.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def met(h: pd.Series) -> pd.Series:
        place = h.to_numpy() & (bits - 1)
        return pd.Series((sent.value[place >> 3] >> (place & 7)) & 1 > 0)

    return met


def flag_duplicates(df: DataFrame, flags: dict[str, Sequence[str] | None],
                    business: Sequence[str] | None = None, hot: int = HOT, wide: Sequence[str] = ()) -> DataFrame:
    """Add one boolean per entry of ``flags``: name -> key columns (None =
    all ``business`` columns).  The first row of each key group is not a
    duplicate; "first" is the smallest row by all business columns (nulls
    first), so the choice is deterministic.  Nulls compare equal.

    Rows whose keys no other row has are told by hashes of 8 bytes and pass as
    they are; rows of one key share every key within it, so the least keys
    tell for all.  Rows of repeated keys are numbered key by key, those of keys
    with more than ``hot`` rows are stored and flagged by digests.  ``wide``
    names columns of long texts: those of repeated keys then move only where
    no later filter drops their row.
    """
    business = list(business or df.columns)
    sets = [list(k if k is not None else business) for k in flags.values()]
    least = [k for i, k in enumerate(sets) if not any(set(j) < set(k) or (set(j) == set(k) and at < i) for at, j in enumerate(sets))]
    if len(least) != 1:  # keys that are not within each other
        return _flag_repeated(df, flags, business)
    single, other, large = split_repeated(df, least[0], hot)
    out = single.select("*", *[F.lit(False).alias(name) for name in flags])
    if other is not None and set(wide) & set(business) and set(business) == set(df.columns) and all(set(k) in (set(least[0]), set(business)) for k in sets):
        out = out.unionByName(_flag_wide(other, dict(zip(flags, sets, strict=True)), least[0], business, wide))
    elif other is not None:
        # one order for all flags, so that they take the same one of equal rows as the first
        order = [F.col(c).asc_nulls_first() for c in business if c not in least[0]]
        place = F.row_number().over(Window.partitionBy(*least[0]).orderBy(*order, row_digest(df.columns)))
        other = other.withColumn("_place", place)
        numbers = [F.col("_place") if set(k) == set(least[0]) else F.row_number().over(Window.partitionBy(*least[0], *[c for c in k if c not in least[0]]).orderBy("_place")) for k in sets]
        out = out.unionByName(other.select(*df.columns, *[(x > 1).alias(name) for name, x in zip(flags, numbers, strict=True)]))
    return out if large is None else out.unionByName(_flag_repeated(shared_table(large, "repeated"), flags, business))


#: Characters of a text that tell which row of a key comes first, unless they are the same.
HEAD = 64


def _flag_wide(df: DataFrame, flags: dict[str, Sequence[str]], key: Sequence[str], business: Sequence[str], wide: Sequence[str]) -> DataFrame:
    """The flags of ``flag_duplicates`` by ``key`` and by whole rows, for rows
    with long texts.

    The first row of a key is found on digests, the columns before the text
    and its head; whole texts are compared only where these agree and the
    digests do not.  The digests of first rows are joined back, and equal rows
    are numbered within all their columns, so that filters on columns (of
    ``clean_reviews``, say) are pushed below both and drop rows before they move.
    """
    order = [c for c in business if c not in key]
    at = next((i for i, c in enumerate(order) if c in wide), len(order))
    head = [F.col(c) for c in order[:at]] + [F.substring(F.col(c).cast("string"), 1, HEAD).alias(c) for c in order[at:at + 1]]
    narrow = df.select(*key, row_digest(df.columns).alias("_d"), F.struct(*head or [F.lit(0)]).alias("_k"))
    first = narrow.withColumn("_r", F.rank().over(Window.partitionBy(*key).orderBy("_k"))).where("_r = 1")
    first = shared_table(first.groupBy(*key).agg(F.min("_d").alias("_d"), F.max("_d").alias("_e")), "first-rows")
    leads, tied = first.where("_d = _e").select("_d"), first.where("_d != _e").select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(key)])
    if not tied.isEmpty():
        same = [df[c].eqNullSafe(tied[f"_t{i}"]) for i, c in enumerate(key)]
        place = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_first() for c in order], "_d"))
        whole = df.join(tied, same, "left_semi").withColumn("_d", row_digest(df.columns)).withColumn("_place", place)
        leads = leads.unionByName(shared_table(whole.where("_place = 1").select("_d"), "first-rows"))
    # by the digest's parts: a struct would be cast for the join, and its rows shuffled again for the window
    digest = row_digest(df.columns)
    rows = df.withColumns({"_a": digest["a"], "_b": digest["b"]}).join(leads.select(F.col("_d.a").alias("_a"), F.col("_d.b").alias("_b"), F.lit(True).alias("_lead")), ["_a", "_b"], "left")
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_a", "_b", "_lead", *df.columns).orderBy("_a")))
    again = F.col("_copy") > 1
    return rows.select(*df.columns, *[(again | F.col("_lead").isNull() if set(k) == set(key) else again).alias(name) for name, k in flags.items()])


def _flag_repeated(df: DataFrame, flags: dict[str, Sequence[str] | None], business: Sequence[str]) -> DataFrame:
    """The flags of ``flag_duplicates`` by digests of all rows.

    Only digests are grouped.  Keys with more than one row come back as a
    small table; all other rows pass without a shuffle (as long as that table
    can be broadcast).  The full columns move only for rows that have an equal
    copy, and are compared only where rows of one key differ.
    """
    allc = df.columns
    keys = {f"_first{i}": list(k if k is not None else business) for i, k in enumerate(flags.values())}
    whole = [f for f, k in keys.items() if set(k) == set(allc)]
    wide = df.withColumn("_d", row_digest(allc))
    narrow = df.select(row_digest(allc).alias("_d"), *[row_digest(k).alias(f"_k{f}") for f, k in keys.items() if f not in whole])
    rows = shared_table(narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("_n")), "row-digests")
    kind = rows.schema["_d"].dataType
    marks = rows.where("_n > 1").select("_d", "_n", *[(F.col("_d") if f in whole else F.lit(None).cast(kind)).alias(f) for f in keys])
    for f, k in keys.items():
        if f in whole:
            continue
        first = rows.groupBy(f"_k{f}").agg(F.sum("_n").alias("_c"), F.count(F.lit(1)).alias("_differ"), F.min("_d").alias("_m")).where("_c > 1")
        first = shared_table(first.select(f"_k{f}", "_differ", "_m"), "duplicate-keys")
        differ = first.where("_differ > 1").select(f"_k{f}")
        if not differ.isEmpty():
            order = F.struct(*[c for c in business if c not in k] or [F.lit(0)])
            least = (wide.withColumn(f"_k{f}", row_digest(k)).join(differ, f"_k{f}").groupBy(f"_k{f}")
                     .agg(F.min_by("_d", F.struct(order, "_d")).alias("_least")))
            first = first.join(least, f"_k{f}", "left").withColumn("_m", F.coalesce("_least", "_m"))
        marks = marks.unionByName(rows.join(first, f"_k{f}").select(
            "_d", "_n", *[(F.col("_m") if g == f else F.lit(None).cast(kind)).alias(g) for g in keys]))
    marks = shared_table(marks.groupBy("_d").agg(F.max("_n").alias("_n"), *[F.max(f).alias(f) for f in keys]), "duplicate-rows")

    def flagged(part: DataFrame, copy: Column) -> DataFrame:
        return part.select(*[F.col(c) for c in allc], *[(F.col(f).isNotNull() & ~(F.col("_d").eqNullSafe(F.col(f)) & (copy == 1))).alias(name)
                                                       for f, name in zip(keys, flags, strict=True)])

    single = wide.join(marks, "_d", "left").where("_n is null or _n = 1")
    copied = (wide.join(marks.where("_n > 1"), "_d").groupBy("_d", "_n", *keys).agg(F.first(F.struct(*allc)).alias("_r")).select("_d", "_n", *keys, "_r.*"))
    # copies in two steps, so no array is longer than 2^16 or n / 2^16
    step = 1 << 16
    copied = copied.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / step).cast("long"))).alias("_m"))
    copied = copied.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step).cast("long"), F.col("_n") - F.col("_m") * step))).alias("_j"))
    return flagged(single, F.lit(1)).unionByName(flagged(copied, F.col("_m") * step + F.col("_j")))


def number_texts(texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(numbered (_text, text), places (key, _text)) of a table (key, text): a
    number for each different text, in the order of the texts (null for null), so
    that numbers compare as the texts do and can stand for them.  A text moves
    only to its place in the order; its number comes back by a 128-bit digest."""
    order = texts.select(text).where(F.col(text).isNotNull()).distinct().repartitionByRange(text).sortWithinPartitions(text)
    # the upper bits are the number of the range, the lower ones count its rows
    numbered = shared_table(order.withColumn("_text", F.monotonically_increasing_id()), "numbered-texts")
    digest = row_digest([text])
    marks = numbered.select("_text", digest["a"].alias("_a"), digest["b"].alias("_b"))
    places = texts.select(key, F.when(F.col(text).isNotNull(), digest["a"]).alias("_a"), digest["b"].alias("_b")).join(marks, ["_a", "_b"], "left")
    return numbered, shared_table(places.select(key, "_text"), "text-places")  # stored, for then Spark knows how small it is


# --------------------------------------------------------------------------- stateless checks
def has_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    cols = list(columns or df.columns)
    cond = F.lit(False)
    for c in cols:
        t = df.schema[c].dataType
        one = F.col(c).isNull()
        if isinstance(t, (DoubleType, FloatType)):
            one = one | F.isnan(F.col(c))
        cond = cond | one
    return cond


def _nn(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def has_emoji(c: Column) -> Column:
    # one range first: the class has some 150, and few texts have a character above it
    return _nn(c.rlike(T.EMOJI_GUARD) & c.rlike(T.EMOJI_CLASS))


def has_excessive_special_chars(c: Column, threshold: float = K.SPECIAL_CHAR_THRESHOLD) -> Column:
    return _nn(T.special_char_share(c) > F.lit(threshold))


def has_invalid_date(c: Column, lower: str = K.DATE_LOWER, upper: str = K.DATE_UPPER) -> Column:
    lo = F.lit(lower).cast("timestamp_ntz")
    hi = F.lit(upper).cast("timestamp_ntz")
    d = c.cast("timestamp_ntz")
    return _nn((d < lo) | (d > hi))


def has_invalid_rating(c: Column, lower: float = K.RATING_LOWER, upper: float = K.RATING_UPPER) -> Column:
    return _nn((c < F.lit(lower)) | (c > F.lit(upper)))


def contains_email(c: Column) -> Column:
    return _nn(c.contains("@") & c.rlike(K.EMAIL_PATTERN))


def contains_url(c: Column) -> Column:
    # what every match holds first: a search for plain text costs a tenth of the pattern's
    return _nn((c.contains("://") | c.contains("www.")) & c.rlike(K.URL_PATTERN))


def contains_phone(c: Column) -> Column:
    # without the word boundary, which costs most, the pattern is found where it starts with a digit
    return _nn(c.rlike(r"[0-9]{3}[-.]?[0-9]{4}") & c.rlike(K.PHONE_PATTERN))


# --------------------------------------------------------------------------- outliers
def quartile_bounds(df: DataFrame, column: str, method: str = "exact") -> DataFrame:
    """One row: q1, q3, lower, upper fences (1.5 IQR) of ``column``.

    exact: linear-interpolated quartiles (pandas / DuckDB ``quantile_cont``)
    by distributed selection.  approx: ``percentile_approx`` with a bounded,
    mergeable sketch.
    """
    v = F.col(column)
    if method == "approx":
        q = df.agg(F.percentile_approx(v.cast("double"), [0.25, 0.75], 100000).alias("_q"))
    else:
        q = exact_quantiles(df, column, [0.25, 0.75]).select(F.col("q").alias("_q"))
    q = q.select(F.col("_q")[0].cast("double").alias("q1"), F.col("_q")[1].cast("double").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - 1.5 * iqr).alias("lower"),
                    (F.col("q3") + 1.5 * iqr).alias("upper"))


def fences(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row with ``_lo_<name>``/``_hi_<name>`` for every column, from a
    single (column, value) histogram pass over ``df``."""
    names = list(columns)
    entries = [F.struct(F.lit(n).alias("_k"), F.col(c).cast("double").alias("_v")) for n, c in columns.items()]
    values = df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
    q = exact_quantiles(values, "_v", [0.25, 0.75], by=["_k"]).withColumnRenamed("q", "_q")
    iqr = F.col("_q")[1] - F.col("_q")[0]
    q = q.select("_k", (F.col("_q")[0] - 1.5 * iqr).alias("_lo"), (F.col("_q")[1] + 1.5 * iqr).alias("_hi"))
    aggs = []
    for n in names:
        aggs += [F.max(F.when(F.col("_k") == n, F.col("_lo"))).alias(f"_lo_{n}"),
                 F.max(F.when(F.col("_k") == n, F.col("_hi"))).alias(f"_hi_{n}")]
    return q.agg(*aggs)  # one row per flagged column -> one row


def flag_outliers(df: DataFrame, columns: dict[str, str], method: str = "exact",
                  source: DataFrame | None = None) -> DataFrame:
    """Add name -> strict IQR-fence outlier flag for each column.  Fences
    are computed on ``source`` (default ``df``) -- pass the un-flagged input
    to avoid recomputing upstream work."""
    src = source if source is not None else df
    if method == "approx":
        out = df
        for name, c in columns.items():
            b = quartile_bounds(src, c, "approx").select(F.col("lower").alias(f"_lo_{name}"),
                                                          F.col("upper").alias(f"_hi_{name}"))
            out = out.crossJoin(F.broadcast(b))
    else:
        out = df.crossJoin(F.broadcast(fences(src, columns)))  # one scalar row
    for name, c in columns.items():
        out = out.withColumn(name, _nn((F.col(c) < F.col(f"_lo_{name}")) | (F.col(c) > F.col(f"_hi_{name}"))))
    return out.drop(*[f"_{s}_{n}" for n in columns for s in ("lo", "hi")])


# --------------------------------------------------------------------------- the assessment
def assess_quality(df: DataFrame, text_column: str | None = "content",
                   id_column: str = "id", business: Sequence[str] | None = None,
                   outlier_columns: Sequence[str] = ("vote_sum", "vote_count"),
                   date_column: str | None = "date", rating_column: str | None = "rating",
                   date_bounds: tuple[str, str] = (K.DATE_LOWER, K.DATE_UPPER),
                   rating_bounds: tuple[float, float] = (K.RATING_LOWER, K.RATING_UPPER),
                   special_threshold: float = K.SPECIAL_CHAR_THRESHOLD,
                   language=None, profanity=None, outlier_method: str = "exact",
                   texts: DataFrame | None = None, text_key: str | None = None) -> DataFrame:
    """All applicable flags, in the reference's column order.

    Checks whose input column is absent are skipped.  ``language`` and
    ``profanity`` are optional callables ``DataFrame -> DataFrame`` adding
    their own flag columns (see ``operators.language``).

    ``texts`` (text_key, text_column) has the texts of a ``df`` that holds only
    their key (rows without one get null).  Duplicates are then told on rows
    with numbers in place of texts, which are joined for the checks that read
    them: no text moves with its row.
    """
    if texts is not None:
        business = list(business or [*[c for c in df.columns if c != text_key], text_column])
        numbered, places = number_texts(texts, text_key, text_column)
        df = shared_table(df.join(places, text_key, "left").drop(text_key), "rows")
    business = list(business or df.columns)
    cols = {*df.columns, *business}
    keys = ["_text" if texts is not None and c == text_column else c for c in business]
    out = flag_duplicates(df, {"dqa_is_duplicate": keys, "dqa_is_duplicate_review_id": [id_column]}, keys,
                          wide=[text_column] if text_column in df.columns else [])
    # what needs no text comes first: filters on it drop rows before their texts come
    if date_column in cols:
        out = out.withColumn("dqa_has_invalid_date", has_invalid_date(F.col(date_column), *date_bounds))
    if rating_column in cols:
        out = out.withColumn("dqa_has_invalid_rating", has_invalid_rating(F.col(rating_column), *rating_bounds))
    present = {f"dqa_{c}_outlier": c for c in outlier_columns if c in cols}
    if present:
        out = flag_outliers(out, present, outlier_method, source=df)
    if texts is not None:
        out = out.join(numbered, "_text", "left").drop("_text")
    out = out.withColumn("dqa_has_null_values", has_nulls(out, business))
    before = out.columns
    if language is not None:
        out = language(out)
    spoken = [c for c in out.columns if c not in before]
    if text_column in cols:
        out = out.withColumn("dqa_has_emojis", has_emoji(F.col(text_column)))
        out = out.withColumn("dqa_has_excessive_special_chars",
                             has_excessive_special_chars(F.col(text_column), special_threshold))
    before = out.columns
    if profanity is not None:
        out = profanity(out)
    sworn = [c for c in out.columns if c not in before]
    if text_column in cols:
        out = (out.withColumn("dqa_contains_email", contains_email(F.col(text_column)))
                  .withColumn("dqa_contains_url", contains_url(F.col(text_column)))
                  .withColumn("dqa_contains_phone_number", contains_phone(F.col(text_column))))
    flags = ["dqa_is_duplicate", "dqa_is_duplicate_review_id", "dqa_has_null_values", *spoken, "dqa_has_emojis", "dqa_has_excessive_special_chars",
             "dqa_has_invalid_date", "dqa_has_invalid_rating", *sworn, "dqa_contains_email", "dqa_contains_url", "dqa_contains_phone_number", *present]
    return out.select(*[c for c in out.columns if c not in flags], *[c for c in flags if c in out.columns])


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("dqa_")]
