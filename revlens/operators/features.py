"""Date, text, lexical and readability features; author anonymisation.

All features are per-row expressions over one token array and one
sentence array computed once per row (the reference tokenised each text
six times).  The only data-wide value is the newest review date, a
one-row aggregate cross-joined to the rows.
"""


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.functions.stats import safe_div


# --------------------------------------------------------------------------- F1 / F2 / F3
def parse_dates(df: DataFrame, date_column: str = "date") -> DataFrame:
    """dt_review_age (whole elapsed days to the newest date), dt_year,
    dt_month (name), dt_day (weekday name), dt_year_month, dt_ymd."""
    d = F.col(date_column)
    newest = df.agg(F.max(date_column).alias("_max_date"))
    out = df.crossJoin(F.broadcast(newest))  # one scalar row
    return (out.withColumn("dt_review_age", F.expr(f"timestampdiff(DAY, `{date_column}`, _max_date)").cast("bigint"))
               .withColumn("dt_year", F.date_format(d, "yyyy"))
               .withColumn("dt_month", F.date_format(d, "MMMM"))
               .withColumn("dt_day", F.date_format(d, "EEEE"))
               .withColumn("dt_year_month", F.date_format(d, "yyyy-MM"))
               .withColumn("dt_ymd", F.date_format(d, "yyyy-MM-dd"))
               .drop("_max_date"))


def epoch_nanos_to_timestamp(c: Column) -> Column:
    """Raw files stored dates as epoch nanoseconds (long)."""
    return F.timestamp_micros(F.floor(c / 1000).cast("bigint"))


# --------------------------------------------------------------------------- X1 - X9, X11
def _with_tokens(df: DataFrame, text_column: str) -> DataFrame:
    if "_tok" in df.columns:
        return df
    return df.withColumn("_tok", T.tokens(F.col(text_column)))


def text_features(df: DataFrame, text_column: str = "content", keep_tokens: bool = False) -> DataFrame:
    """Sentence, word, character, punctuation and stop-word counts, word and
    sentence density (NULL when the divisor is 0), and ``review_length``."""
    t = F.col("_tok")
    out = _with_tokens(df, text_column)
    stop = T.english_stop_words()
    out = (out.withColumn("text_sentence_count", F.size(T.sentences(F.col(text_column))).cast("bigint"))
              .withColumn("text_word_count", F.size(t).cast("bigint"))
              .withColumn("text_char_count", F.length(F.replace(F.col(text_column), F.lit(" "), F.lit(""))).cast("bigint"))
              .withColumn("text_punctuation_count", F.regexp_count(F.col(text_column), F.lit(T.PUNCTUATION_CLASS)).cast("bigint"))
              .withColumn("text_stopwords_count",
                          F.size(F.filter(t, lambda x: F.lower(x).isin(stop))).cast("bigint"))
              .withColumn("text_word_density", safe_div(F.col("text_char_count"), F.col("text_word_count")))
              .withColumn("text_sentence_density", safe_div(F.col("text_word_count"), F.col("text_sentence_count")))
              .withColumn("review_length", F.col("text_word_count")))
    return out if keep_tokens else out.drop("_tok")


def lexical_features(df: DataFrame, text_column: str = "content", keep_tokens: bool = False) -> DataFrame:
    """Unique tokens (case-sensitive), type-token ratio, lexical density and
    mean token length.

    Lexical density is re-aimed (no POS tagger): the share of tokens that
    are alphabetic words outside the closed-class (stop-word) list.
    """
    t = F.col("_tok")
    stop = T.english_stop_words()
    out = _with_tokens(df, text_column)
    n = F.size(t)
    content_words = F.size(F.filter(t, lambda x: x.rlike(r"^\p{L}") & ~F.lower(x).isin(stop)))
    out = (out.withColumn("lexical_unique_word_count", F.size(F.array_distinct(t)).cast("bigint"))
              .withColumn("lexical_type_token_ratio", safe_div(F.col("lexical_unique_word_count"), n))
              .withColumn("lexical_density", safe_div(content_words, n))
              .withColumn("lexical_avg_word_length",
                          safe_div(F.aggregate(t, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)), n)))
    return out if keep_tokens else out.drop("_tok")


# --------------------------------------------------------------------------- X12 - X15
def readability(df: DataFrame, text_column: str = "content", keep_tokens: bool = False) -> DataFrame:
    """Flesch reading ease, Flesch-Kincaid grade, Gunning fog, SMOG.

    W = word tokens (punctuation excluded), S = sentences, Y = syllables
    (vowel groups), C = words of three or more syllables.  NULL when W or S
    is 0.
    """
    out = _with_tokens(df, text_column)
    words = F.filter(F.col("_tok"), T.is_word)
    syl = F.transform(words, T.syllables)
    W = F.size(words).cast("double")
    S = F.size(T.sentences(F.col(text_column))).cast("double")
    Y = F.aggregate(syl, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double")
    C = F.size(F.filter(syl, lambda x: x >= 3)).cast("double")
    ok = (W > 0) & (S > 0)
    out = (out.withColumn("_W", W).withColumn("_S", S).withColumn("_Y", Y).withColumn("_C", C)
              .withColumn("readability_flesch_reading_ease",
                          F.when(ok, 206.835 - 1.015 * (F.col("_W") / F.col("_S")) - 84.6 * (F.col("_Y") / F.col("_W"))))
              .withColumn("readability_flesch_kincaid_grade",
                          F.when(ok, 0.39 * (F.col("_W") / F.col("_S")) + 11.8 * (F.col("_Y") / F.col("_W")) - 15.59))
              .withColumn("readability_gunning_fog",
                          F.when(ok, 0.4 * (F.col("_W") / F.col("_S") + 100 * (F.col("_C") / F.col("_W")))))
              .withColumn("readability_smog_index",
                          F.when(ok, 1.043 * F.sqrt(30 * F.col("_C") / F.col("_S")) + 3.1291))
              .drop("_W", "_S", "_Y", "_C"))
    return out if keep_tokens else out.drop("_tok")


def engineer_features(df: DataFrame, text_column: str = "content") -> DataFrame:
    """Dates (if present), then text, lexical and readability features over
    one shared token array."""
    out = parse_dates(df) if "date" in df.columns else df
    out = _with_tokens(out, text_column)
    out = text_features(out, text_column, keep_tokens=True)
    out = lexical_features(out, text_column, keep_tokens=True)
    return readability(out, text_column, keep_tokens=False)


# --------------------------------------------------------------------------- H1
def anonymize(c: Column, hex_chars: int = 20) -> Column:
    """First ``hex_chars`` hex digits of SHA-256 (JVM-native)."""
    return F.substring(F.sha2(c, 256), 1, hex_chars)


def anonymize_blake2b(c: Column, digest_size: int = 10) -> Column:
    """Exact BLAKE2b with a ``digest_size``-byte digest (Arrow pandas UDF,
    one vectorised batch at a time).  NULL input raises, as in the source
    pipeline, so missing authors are caught rather than hashed."""
    import hashlib

    import pandas as pd

    @F.pandas_udf("string")
    def _b2(s: pd.Series) -> pd.Series:
        if s.isna().any():
            raise ValueError("author is null; anonymisation needs a value")
        return s.map(lambda v: hashlib.blake2b(v.encode("utf-8"), digest_size=digest_size).hexdigest())

    return _b2(c)


def anonymize_authors(df: DataFrame, column: str = "author", method: str = "sha256") -> DataFrame:
    f = anonymize_blake2b if method == "blake2b" else anonymize
    return df.withColumn(column, f(F.col(column)))
