"""Classifiers: properties of predictions, of the training loop's figures and
of what it stores."""

import hashlib
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from revlens.operators import features as X
from revlens.operators import language as L
from revlens.operators import sentiment as M

WORDS = {0.0: "awful broken refund worst crash".split(), 1.0: "okay fine average plain usual".split(), 2.0: "great love perfect best happy".split()}


def rows(rng, n):
    return [(str(i), " ".join(rng.choices(WORDS[float(i % 3)], k=6) + rng.choices(["the", "app", "is"], k=3)), float(i % 3)) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    return spark.createDataFrame(rows(rng, 90), "id string, content string, label double")


def test_predictions_are_labels_with_probabilities(spark, data):
    model = M.build_pipeline().fit(data)
    out = M.predict(model, data.withColumn("extra", F.lit(1)).unionByName(
        spark.createDataFrame([("e", "", 0.0, 1)], "id string, content string, label double, extra int")))
    assert out.columns == ["id", "content", "label", "extra", "prediction", "score"]
    got = out.collect()
    assert len(got) == 91 and all(r["prediction"] in WORDS and 1 / 3 - 1e-9 <= r["score"] <= 1 for r in got)
    assert all(r["prediction"] == r["label"] for r in got if r["id"] != "e")


def test_loop_figures_follow_from_its_tables(spark, data):
    rng = random.Random(2)
    labelled = data.withColumn("split", F.when(F.col("id").cast("int") < 60, "train").when(F.col("id").cast("int") < 75, "validation").otherwise("test"))
    unl = spark.createDataFrame([(r[0], r[1], i % 3) for i, r in enumerate(rows(rng, 45))], "id string, content string, batch long")
    got = M.self_train(spark, labelled, unl, batches=3, patience=3)
    stats = got.stats.orderBy("round").collect()
    assert [r["pseudo_added"] for r in stats] == [15, 15, 15] and [r["labelled"] for r in stats] == [75, 90, 105]
    assert all(r["test_accuracy"] == 1 and r["overfit"] == r["train_accuracy"] / r["test_accuracy"] for r in stats)
    again = PipelineModel.load(got.path)
    one = {r["id"]: r["prediction"] for r in M.predict(again, data).collect()}
    assert one == {r["id"]: r["prediction"] for r in M.predict(got.model, data).collect()}
    strict = M.self_train(spark, labelled, unl, batches=1, threshold=1.1).stats.first()
    assert strict["pseudo_added"] == 0 and strict["labelled"] == 60  # nothing is that sure


def test_toxic_model_separates_its_classes(spark):
    rng = random.Random(3)
    train = [(str(i), " ".join(rng.choices(["nasty", "vile", "hate"] if i % 2 else ["calm", "kind", "warm"], k=5)), i % 2) for i in range(60)]
    df = spark.createDataFrame(train, "id string, text string, toxic int")
    out = L.flag_toxic(df, L.fit_toxic_model(df, "text", "toxic"))
    assert out.columns == ["id", "text", "toxic", "dqa_has_profanity"]
    assert all(r["dqa_has_profanity"] == bool(r["toxic"]) for r in out.collect())


def test_blake2b_form(spark):
    names = ["a", "é", "x" * 1000]
    got = X.anonymize_authors(spark.createDataFrame([(n,) for n in names], "author string"), method="blake2b").collect()
    assert [r["author"] for r in got] == [hashlib.blake2b(n.encode(), digest_size=10).hexdigest() for n in names]


def test_loop_reads_its_source_once(spark, data):
    """No fit or evaluation goes back to the texts (a join, say) of the labelled set."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(c):
        seen.add(1)
        return c

    part = F.when(F.col("id").cast("int") < 60, "train").when(F.col("id").cast("int") < 75, "validation").otherwise("test")
    labelled = data.withColumn("split", part).withColumn("content", text("content"))
    unl = data.select("content", (F.col("id").cast("int") % 2).alias("batch"))
    got = M.self_train(spark, labelled, unl, batches=2, patience=3)
    assert [r["labelled"] for r in got.stats.orderBy("round").collect()] == [105, 150]
    assert seen.value == 90


def test_fit_on_term_counts_is_the_pipelines(spark, data):
    stages = M.build_pipeline().getStages()
    whole, counted = M.build_pipeline().fit(data), M.fit_counts(stages, M.term_counts(data, stages).select("label", "_tf"))
    a, b = ({r["id"]: (r["prediction"], round(r["score"], 6)) for r in M.predict(m, data).collect()} for m in (whole, counted))
    assert a == b and len(a) == 90
    assert {r["id"]: r["prediction"] for r in M.predict_counts(counted, M.term_counts(data, stages)).collect()} == {k: v[0] for k, v in a.items()}


def test_sentiment_sets_keep_repeated_and_null_keys(spark):
    from revlens.plans.q_models import _sentiment_sets
    from revlens.sources.files import shared_scratch
    base = shared_scratch(spark, "sets")
    spark.createDataFrame([(1, "a", "en"), (1, "b", "en"), (2, "c", "de"), (3, "d", None), (None, "e", "en")],
                          "doc_id long, text string, lang string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, None), (None, 1, 1), (9, 1, 1)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    labelled, unl = _sentiment_sets(spark, base)
    assert sorted((r["id"], r["content"], r["label"]) for r in labelled.collect()) == [
        ("1", "a", 0), ("1", "a", 2), ("1", "b", 0), ("1", "b", 2), ("3", "d", 1)]
    assert sorted((r["id"] or "", r["content"]) for r in unl.collect()) == [("", "e"), ("2", "c")]
    assert all(r["split"] in ("train", "validation", "test") for r in labelled.collect()) and all(0 <= r["batch"] < 3 for r in unl.collect())
