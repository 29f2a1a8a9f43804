"""Input tables and the review-shaped views built from them.

``reviews`` maps the order/line-item star schema onto the review model
(one review per line item).  ``doc_reviews`` maps documents (+ labels) onto
a text review.  Both are lazy joins; Catalyst prunes unused columns and
pushes filters into each parquet scan, and picks broadcast or sort-merge
joins from the scan statistics (``spark.sql.autoBroadcastJoinThreshold``
is the size check; nothing is broadcast by hint here because ``part`` and
``orders`` grow with the data).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.ordered import running

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

REVIEW_COLUMNS = ["id", "app_id", "app_name", "category", "author", "rating",
                  "review_length", "vote_count", "vote_sum", "date"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per line item: lineitem ⋈ orders ⋈ part."""
    # whole numbers before the joins: they take less room in a shuffle than doubles
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.floor("l_quantity").cast("bigint").alias("_count"),
                                                 F.floor("l_extendedprice").cast("bigint").alias("_sum"), "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey))
    return j.select(
        F.concat(li.l_orderkey.cast("string"), F.lit("-"),
                 li.l_linenumber.cast("string")).alias("id"),
        li.l_partkey.cast("string").alias("app_id"),
        p.p_name.alias("app_name"),
        p.p_type.alias("category"),
        o.o_custkey.cast("string").alias("author"),
        li.l_linenumber.alias("rating"),
        p.p_size.alias("review_length"),
        li["_count"].alias("vote_count"),
        li["_sum"].alias("vote_sum"),
        li.l_shipdate.alias("date"),
    )


def doc_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text reviews; labels left-joined (nulls where unlabelled)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("category"),
        F.col("lang"),
        F.col("text").alias("content"),
        F.col("n_chars").alias("vote_count"),
        F.col("quality").alias("rating"),
        F.col("toxic"),
    )


FULL_COLUMNS = [*REVIEW_COLUMNS, "content"]


def full_reviews_by_key(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All reviews with the number ``_doc`` of their text, and the texts (_doc,
    content).  The text of a review is that of the document whose rank by id
    (from 0) equals the review's order number modulo the number of documents, so
    every review has one (null without documents)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    ids = running(d.select("doc_id"), ["doc_id"], {"_doc": F.lit(1)})
    n = ids.agg(F.count(F.lit(1)).alias("_docs"))  # one row
    place = F.when(F.col("_docs") > 0, F.substring_index("id", "-", 1).cast("bigint") % F.col("_docs"))
    return reviews(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("_doc", place).drop("_docs"), d.join(ids, "doc_id").select("_doc", "content")


def full_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews with all columns, each with its text."""
    rows, texts = full_reviews_by_key(spark, sf_dir)
    return rows.join(texts, "_doc", "left").select(*FULL_COLUMNS)


# SQL text of the same views, for DuckDB oracles (valid in Spark SQL too;
# FULL_REVIEWS_SQL reads a view ``r`` of REVIEWS_SQL).
FULL_REVIEWS_SQL = """
SELECT r.*, t.text AS content
FROM r CROSS JOIN (SELECT count(*) AS n FROM documents) c
LEFT JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rank, text FROM documents) t
  ON cast(split_part(r.id, '-', 1) AS BIGINT) % c.n = t.rank
"""

REVIEWS_SQL = """
SELECT concat(cast(l_orderkey AS VARCHAR), '-', cast(l_linenumber AS VARCHAR)) AS id,
       cast(l_partkey AS VARCHAR) AS app_id, p_name AS app_name, p_type AS category,
       cast(o_custkey AS VARCHAR) AS author, l_linenumber AS rating, p_size AS review_length,
       cast(floor(l_quantity) AS BIGINT) AS vote_count,
       cast(floor(l_extendedprice) AS BIGINT) AS vote_sum, l_shipdate AS date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""

DOC_REVIEWS_SQL = """
SELECT cast(d.doc_id AS VARCHAR) AS id, d.source AS category, d.lang AS lang,
       d.text AS content, d.n_chars AS vote_count, l.quality AS rating, l.toxic AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
