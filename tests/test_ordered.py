"""Running totals over a global order against a plain loop."""

import random

from pyspark.sql import functions as F

from revlens.functions.ordered import running


def test_running_totals_with_groups_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 40), i, rng.choice([None, 1, 2, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, i int, w long").repartition(7)
    got = {r["i"]: (r["n"], r["s"]) for r in running(df, ["x", F.col("i").desc()], {"n": F.lit(1), "s": F.col("w")}, by=["g"]).collect()}
    want = {}
    for g in ("a", "b", None):
        n = s = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], -r[2])):
            want[r[2]] = (n, s)
            n, s = n + 1, s + (r[3] or 0)
    assert got == want


def test_running_group_info_hot_group_and_empty(spark):
    df = spark.range(2000).withColumn("g", (F.col("id") % 10 > 8).cast("int"))
    info = df.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    out = running(df, ["id"], {"pos": F.lit(1)}, by=["g"], group_info=info)
    assert {(r["g"], r["size"], r["hi"], r["n"]) for r in out.groupBy("g", "size").agg(F.max("pos").alias("hi"), F.count_distinct("pos").alias("n")).collect()} \
        == {(0, 1800, 1799, 1800), (1, 200, 199, 200)}
    assert running(df.limit(0), ["id"], {"pos": F.lit(1)}).count() == 0
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
