"""Connected components of an edge table, by alternating large-star and
small-star rounds.  Every round is aggregations and equi-joins whose rows
are at most the edges; nothing is collected but two numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stored


def _mark(e: DataFrame):
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node reachable, for every node
    of an edge but the smallest ones themselves.  Null ends are ignored."""
    e = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
               .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a != b").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low2, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low2.select("a", F.col("m").alias("b"))).distinct())
        e = stored(small, "edges")
        new = _mark(e)
        if new == mark:
            break
        mark = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
