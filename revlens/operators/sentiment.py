"""Text classification with self-training (pseudo-labelling), in Spark ML.

The transformer fine-tuning loop of the source is re-aimed to a Spark ML
pipeline (tokens -> hashed TF -> IDF -> multinomial logistic regression).
Each round: predict the next unlabelled batch, keep predictions with
confidence >= ``threshold`` (0.0 keeps all), write them to a table beside
the labelled set (in the shared folder), fit on all, evaluate accuracy on
train / validation / test, record the round's statistics, and stop early
when the monitored accuracy has not improved by ``min_delta`` for
``patience`` rounds.
"""

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.sources.files import shared_scratch


def encode_labels(c, codes=K.LABEL_CODES):
    """NEG/NEU/POS -> 0/1/2 (unknown -> NULL)."""
    m = F.create_map(*[x for k, v in codes for x in (F.lit(k), F.lit(v))])
    return m[c]


def classification_accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Confusion counts per (label, prediction) and the overall accuracy."""
    g = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("count"))
    t = df.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == F.col(prediction)).alias("_ok"))
    return g.crossJoin(F.broadcast(t)).select(label, prediction, "count",
                                              (F.col("_ok") / F.col("_n")).alias("accuracy"))


def build_pipeline(text_column: str = "content", label_column: str = "label", num_features: int = 1 << 18):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_column, outputCol="_words", pattern=r"[^\p{L}\p{N}_']+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label_column, maxIter=30, regParam=0.01,
                           family="multinomial"),
    ])


def predict(model, df: DataFrame) -> DataFrame:
    """label + score per text (score = probability of the predicted class)."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    return (out.withColumn("score", F.array_max(vector_to_array("probability")))
               .drop("_words", "_tf", "_features", "rawPrediction", "probability"))


def term_counts(df: DataFrame, stages) -> DataFrame:
    """``df`` with the hashed term counts ``_tf``, by a pipeline's first two stages."""
    words, tf = stages[:2]
    return tf.transform(words.transform(df)).drop("_words")


def fit_counts(stages, counts: DataFrame):
    """The pipeline's model, fitted on rows that carry ``_tf``.

    Each task of an iteration sends one dense gradient and the slowest is
    waited for, so rows are dealt evenly, once a fit, to one partition a core or
    to one for four scan splits where that is more.
    """
    from pyspark.ml import PipelineModel
    words, tf, idf, classifier = stages
    n = max(counts.sparkSession.sparkContext.defaultParallelism, counts._jdf.rdd().getNumPartitions() // 4)
    even = counts.repartition(n).persist(StorageLevel.DISK_ONLY)  # memory is for the classifier's blocks
    try:
        scale = idf.fit(even)
        return PipelineModel([words, tf, scale, classifier.fit(scale.transform(even))])
    finally:
        even.unpersist()


def predict_counts(model, counts: DataFrame) -> DataFrame:
    """``predict`` for rows that carry ``_tf``, which stays."""
    from pyspark.ml import PipelineModel
    return predict(PipelineModel(model.stages[2:]), counts.withColumn("_counts", F.col("_tf"))).withColumnRenamed("_counts", "_tf")


@dataclass
class EarlyStop:
    """Stop when ``monitor`` has not improved by ``min_delta`` for
    ``patience`` consecutive rounds (mode "max" or "min")."""
    patience: int = 3
    min_delta: float = 0.0
    mode: str = "max"
    best: float | None = None
    wait: int = 0
    stopped: bool = False

    def update(self, value: float) -> bool:
        better = (self.best is None or
                  (value > self.best + self.min_delta if self.mode == "max" else value < self.best - self.min_delta))
        if better:
            self.best, self.wait = value, 0
        else:
            self.wait += 1
            self.stopped = self.wait >= self.patience
        return self.stopped


@dataclass
class SessionStats:
    rows: list = field(default_factory=list)

    def add(self, **kw):
        self.rows.append(kw)

    def to_df(self, spark: SparkSession) -> DataFrame:
        schema = ("round int, labelled long, pseudo_added long, runtime double, train_accuracy double, "
                  "validation_accuracy double, test_accuracy double, overfit double")
        return spark.createDataFrame([tuple(r[k] for k in ("round", "labelled", "pseudo_added", "runtime",
                                                           "train_accuracy", "validation_accuracy", "test_accuracy",
                                                           "overfit")) for r in self.rows], schema)


@dataclass
class SelfTraining:
    """The last model, the per-round statistics and the stored model's path."""
    model: object
    stats: DataFrame
    path: str


def _accuracies(model, counts: DataFrame, label: str, parts: dict) -> dict[str, float]:
    """The accuracy on each part (name -> condition) in one pass; NaN without rows."""
    hit = (F.col("prediction") == F.col(label)).cast("double")
    r = predict_counts(model, counts).agg(*[F.avg(F.when(c, hit)).alias(k) for k, c in parts.items()]).first()
    return {k: float("nan") if r[k] is None else float(r[k]) for k in parts}


def self_train(spark: SparkSession, labelled: DataFrame, unlabelled: DataFrame, text_column: str = "content",
               label_column: str = "label", batches: int = 3, threshold: float = 0.0, batch_column: str = "batch",
               patience: int = 2, min_delta: float = 0.0, path: str | None = None) -> SelfTraining:
    """Run the loop: predict a batch, add its labels, train on all, evaluate.

    ``labelled`` carries ``split`` (train / validation / test);
    ``unlabelled`` carries ``batch_column`` in 0..batches-1.  A batch's
    labels are written once, to a table of its own under ``path`` (default: a
    new shared folder) with the texts and their term counts, so no round
    recomputes earlier ones; the labelled texts' term counts and the last
    model are stored there, too.  Only scalar accuracies and counts reach the
    driver.
    """
    path = path or shared_scratch(spark, "self-training")
    stages = build_pipeline(text_column, label_column).getStages()
    known = (term_counts(labelled.where(F.col("split").isin("train", "validation", "test")), stages)
             .select(F.col(label_column).cast("double"), "split", "_tf"))
    known.write.mode("overwrite").parquet(f"{path}/labelled")
    tables = [f"{path}/labelled"]
    stats, stop = SessionStats(), EarlyStop(patience=patience, min_delta=min_delta)

    def stored() -> DataFrame:
        return spark.read.schema(known.schema).parquet(*tables)

    train = F.col("split").isNull() | (F.col("split") == "train")  # a batch's rows have no split
    parts = {"train": train, "validation": F.col("split") == "validation", "test": F.col("split") == "test"}
    n = stored().where(train).count()
    model = fit_counts(stages, stored().where(train))
    for b in range(batches):
        t0 = time.perf_counter()
        batch = term_counts(unlabelled.where(F.col(batch_column) == b).select(text_column), stages)
        pseudo = (predict_counts(model, batch).where(F.col("score") >= threshold)
                  .select(text_column, F.col("prediction").alias(label_column), "_tf"))
        tables.append(f"{path}/batch-{b:05d}")
        pseudo.write.mode("overwrite").parquet(tables[-1])
        added = spark.read.schema(pseudo.schema).parquet(tables[-1]).count()
        n += added
        model = fit_counts(stages, stored().where(train))
        acc = _accuracies(model, stored(), label_column, parts)
        tr, va, te = acc["train"], acc["validation"], acc["test"]
        stats.add(round=b, labelled=n, pseudo_added=added, runtime=time.perf_counter() - t0,
                  train_accuracy=tr, validation_accuracy=va, test_accuracy=te,
                  overfit=(tr / te) if te else None)
        if stop.update(va):
            break
    model.write().overwrite().save(f"{path}/model")
    return SelfTraining(model, stats.to_df(spark), f"{path}/model")
