"""Training-corpus pipeline over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of their input.

Nulls, empty texts, repeated rows, empty tables and extra columns are
handled as each operator states; in short: documents without a letter go in
the first stage, repeated rows count as copies in the second (one stays),
and a document without words takes no part in the final mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontam, langid, mixing, ngram_join, secrets
from llm.common import fresh, read, stored

#: Least score of a predicted language; documents below it are rejected.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier can name.  It learns from the
    rows with a language whose id is not held out; with nothing to learn
    from, every document with a letter stays."""
    flag, lab, score = fresh(docs, "held_out", "lang_pred", "lang_score")
    model = langid.train(docs.withColumn(flag, langid.held_out()).where(f"not {flag}"))
    if not model[0]:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    kept = langid.predict(docs, model, label_out=lab, score_out=score)
    return kept.where((F.col(lab) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of five-word shingles."""
    return ngram_join.deduplicate(docs, k=5, percent=80).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, ``n_chars`` brought up to date."""
    (spans,) = fresh(docs, "secret_spans")
    found = secrets.scan(docs, out=spans).withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        size = F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with their copies, in order of their first training position."""
    return mixing.mix(docs).where("copies > 0").drop("place", "ramp").orderBy("position", "doc_id")


STAGES = [("language_id", language_id), ("ngram_jaccard", near_duplicates), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("mixing", mixture)]

#: Similarity components, trained models and shingle sets are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
