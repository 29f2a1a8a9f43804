"""Properties of whole operators on hand-made and driver tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from revlens.operators import clean as C
from revlens.operators import quality as Q
from revlens.operators import sampling as S
from revlens.operators.metrics import category_metrics
from revlens.sources.tables import doc_reviews, reviews

from .conftest import SF_SMALL


def test_duplicates_first_kept(spark):
    rows = [("1", "a"), ("1", "a"), ("1", "b"), ("2", "c"), (None, "d"), (None, "d")]
    df = spark.createDataFrame(rows, "id string, v string")
    out = Q.flag_duplicates(df, {"dup": None, "dup_id": ["id"]}).collect()
    assert sum(r.dup for r in out) == 2          # one extra (1,a), one extra (None,d)
    assert sum(r.dup_id for r in out) == 3       # id 1 keeps one of three, None keeps one of two
    firsts = [r for r in out if r.id == "1" and not r.dup_id]
    assert len(firsts) == 1 and firsts[0].v == "a" and not firsts[0].dup


def test_outlier_fences_match_pandas(spark):
    import pandas as pd
    vals = [1, 2, 2, 3, 3, 3, 4, 50, 60]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    out = Q.flag_outliers(df, {"o": "x"}).collect()
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    exp = [(v < q1 - 1.5 * (q3 - q1)) or (v > q3 + 1.5 * (q3 - q1)) for v in vals]
    assert sorted((r.x, r.o) for r in out) == sorted(zip(vals, exp))


def test_clean_has_no_selected_flags_and_missing_flag_raises(spark):
    df = reviews(spark, SF_SMALL)
    flagged = Q.assess_quality(df, text_column=None, date_bounds=("1996-01-01 00:00:00", "2001-01-01 00:00:00"))
    issues = [i for i in C.issues_to_remove() if i in flagged.columns]
    cleaned = C.clean_reviews(flagged, issues)
    assert not [c for c in cleaned.columns if "dqa" in c]
    s = C.clean_summary(flagged, issues).first()
    assert s.original == s.cleaned + s.removed and cleaned.count() == s.cleaned
    with pytest.raises(KeyError):
        C.clean_reviews(flagged.drop("dqa_has_null_values"), issues)


def test_category_metrics_sum_to_rows(spark):
    df = reviews(spark, SF_SMALL)
    m = category_metrics(df)
    assert m.agg(F.sum("review_count")).first()[0] == df.count()


def test_split_disjoint_and_complete(spark):
    d = doc_reviews(spark, SF_SMALL).select("id")
    s = S.split_80_10_10(d, 42)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == d.count() and set(counts) <= {"train", "validation", "test"}
    assert s.select("id").distinct().count() == d.count()


def test_sample_exact_size(spark):
    d = doc_reviews(spark, SF_SMALL).select("id")
    n = d.count()
    assert S.sample_exact(d, 0.1, 42).count() == round(n * 0.1)


def test_stage_runner_skips_existing(spark):
    import os

    from revlens.plans import stages as E
    from revlens.sources.files import shared_scratch
    base = shared_scratch(spark, "t")
    src, dst, m = (os.path.join(base, x) for x in ("src", "dst", "metrics"))
    spark.range(10).write.parquet(src)
    E.run_stage(spark, lambda d: d.where("id < 5"), src, dst, "DataCleaningTask", m)
    out = E.run_stage(spark, lambda d: d, src, dst, "DataCleaningTask", m)  # not recomputed
    assert out.count() == 5
    rows = E.read_metrics(spark, m).collect()
    assert len(rows) == 1 and rows[0].stage == "clean" and rows[0].input_records == 10


def test_early_stop():
    from revlens.operators.sentiment import EarlyStop
    e = EarlyStop(patience=2)
    assert [e.update(v) for v in (0.5, 0.6, 0.6, 0.55)] == [False, False, False, True]


def test_no_python_udf_in_flags(spark):
    """Row checks stay JVM-side (no BatchEvalPython / ArrowEvalPython)."""
    d = Q.assess_quality(doc_reviews(spark, SF_SMALL), date_column=None, outlier_columns=("vote_count",))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_format_dispatch_rejects_unknown(spark):
    from revlens.sources.files import load
    with pytest.raises(ValueError):
        load(spark, "/tmp/x.xlsx")


def test_epoch_nanos(spark):
    from revlens.operators.features import epoch_nanos_to_timestamp
    ns = int(dt.datetime(2020, 5, 17, 12, 0, tzinfo=dt.timezone.utc).timestamp() * 1e9)
    df = spark.createDataFrame([(ns,)], "d long")
    got = df.select(epoch_nanos_to_timestamp(F.col("d")).cast("timestamp_ntz").alias("t")).first().t
    assert got == dt.datetime(2020, 5, 17, 12, 0)


def test_drop_features_checks_names(spark):
    from revlens.operators.normalize import drop_features
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert drop_features(df, ["a"]).columns == ["b"]
    with pytest.raises(ValueError):
        drop_features(df, ["zz"])


@pytest.mark.parametrize("ext", [".csv", ".tsv", ".json", ".parquet"])
def test_file_roundtrip(spark, ext):
    import os

    from revlens.sources.files import load, save, shared_scratch
    df = spark.createDataFrame([("1", 'a,b "q"', 3), ("2", None, 4)], "id string, t string, n int")
    path = os.path.join(shared_scratch(spark, "io"), "x" + ext)
    save(df, path)
    back = load(spark, path, schema="id string, t string, n int" if ext in (".csv", ".tsv") else None)
    got = sorted((r.id, r.t, int(r.n)) for r in back.collect())
    assert got == [("1", 'a,b "q"', 3), ("2", None, 4)]


def test_streaming_flags_match_batch(spark):
    from revlens.plans.q_quality import flag_email
    from revlens.plans.q_stream import stream_flags
    s = {r.id: r.dqa_contains_email for r in stream_flags(spark, SF_SMALL).collect()}
    b = {r.id: r.dqa_contains_email for r in flag_email(spark, SF_SMALL).collect()}
    assert s == b


def test_text_prep_columns(spark):
    from revlens.operators.textprep import OUTPUT_COLUMNS, text_prep
    d = doc_reviews(spark, SF_SMALL).select("id", "content")
    out = text_prep(d)
    assert all(c in out.columns for c in OUTPUT_COLUMNS) and out.count() == d.count()


def test_self_training_grows_and_stores_the_model(spark):
    from pyspark.ml import PipelineModel

    from revlens.operators.sentiment import self_train
    texts = [(f"good nice fine {i}", 2.0) for i in range(8)] + [(f"bad awful poor {i}", 0.0) for i in range(8)]
    labelled = spark.createDataFrame([(t, y, s) for t, y in texts for s in ("train", "validation", "test")],
                                     "content string, label double, split string").coalesce(1)
    more = spark.createDataFrame([("nice good thing", 0), ("awful thing", 0), ("poor bad", 1)], "content string, batch int").coalesce(1)
    r = self_train(spark, labelled, more, batches=2)
    rows = r.stats.collect()
    assert [(x.labelled, x.pseudo_added) for x in rows] == [(18, 2), (19, 1)] and rows[-1].test_accuracy == 1.0
    assert PipelineModel.load(r.path).stages[-1].numClasses == 3
