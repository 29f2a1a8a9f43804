"""Row-level quality flags on a stream of reviews.

The reference is batch-only; its stateless checks (nulls, emoji, special
characters, dates, ratings, e-mail, URL, phone, profanity lexicon) are
plain column expressions, so they run unchanged on a streaming
DataFrame.  Data-wide checks (duplicates, IQR outliers, language model
fitting) need the whole table and stay batch stages.

``run_available`` processes everything currently in the source with
``trigger(availableNow=True)`` into a parquet sink whose checkpoint lives
under the shared ``spark.checkpoint.dir``: a restarted or failed query
resumes from its offsets and never writes a batch twice.
"""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators import language as L
from revlens.operators import quality as Q


def stream_source(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def stateless_flags(df: DataFrame, text_column: str = "content", key: str = "id") -> DataFrame:
    c = F.col(text_column)
    out = [F.col(key), Q.has_nulls(df, [x for x in df.columns]).alias("dqa_has_null_values"),
           Q.has_emoji(c).alias("dqa_has_emojis"),
           Q.has_excessive_special_chars(c).alias("dqa_has_excessive_special_chars"),
           L.has_profanity(c).alias("dqa_has_profanity"),
           Q.contains_email(c).alias("dqa_contains_email"),
           Q.contains_url(c).alias("dqa_contains_url"),
           Q.contains_phone(c).alias("dqa_contains_phone_number")]
    if "rating" in df.columns:
        out.append(Q.has_invalid_rating(F.col("rating")).alias("dqa_has_invalid_rating"))
    if "date" in df.columns:
        out.append(Q.has_invalid_date(F.col("date")).alias("dqa_has_invalid_date"))
    return df.select(*out)


def run_available(df: DataFrame, sink: str, checkpoint: str) -> None:
    q = (df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
           .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def stream_flags_to_table(spark: SparkSession, source: str, schema, base: str,
                          text_column: str = "content", key: str = "id") -> DataFrame:
    """Run the stream over all available input; return the sink as a table."""
    src = stream_source(spark, source, schema)
    sink, ckpt = os.path.join(base, "sink"), os.path.join(base, "checkpoint")
    run_available(stateless_flags(src, text_column, key), sink, ckpt)
    return spark.read.parquet(sink)
