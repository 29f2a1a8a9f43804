"""Stage runner, run metrics and dataset registry.

A stage is ``fn: DataFrame -> DataFrame`` from a source table to a target
parquet table.  If the target exists (its ``_SUCCESS`` marker is present)
and ``force`` is false, the stored table is read instead of recomputed --
this is also how a long pipeline survives lost executors: every stage
boundary is a durable table in shared storage.  Rows in and out are observed
while the stage runs (``Observation``), so no table is read again to count
them; with start, stop and runtime they are appended to a ``run_metrics``
parquet table.  Datasets are recorded in an append-only ``dataset_registry``
table.
"""

import os
import time
from collections.abc import Callable
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revlens.functions import constants as K

METRICS_SCHEMA = ("task string, stage string, phase string, runtime double, input_records long, "
                  "output_records long, input_records_per_second double, output_records_per_second double, "
                  "start timestamp, stop timestamp")
REGISTRY_SCHEMA = ("name string, phase string, stage string, path string, nrows long, ncols int, "
                   "creator string, created timestamp")
STAGES = {p[1] for p in K.TASK_CONFIG} | {"raw", "norm", "dqa", "features", "nlp"}
PHASES = {p[0] for p in K.TASK_CONFIG}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    return p.getFileSystem(conf).exists(p)


def task_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.TASK_CONFIG, "phase string, stage string, task string")


def run_stage(spark: SparkSession, fn: Callable[[DataFrame], DataFrame], src: str, dst: str,
              task: str, metrics_path: str | None = None, force: bool = False) -> DataFrame:
    """Run ``fn`` on the parquet table ``src`` into ``dst`` unless ``dst``
    already exists; return the stored result."""
    if _exists(spark, dst) and not force:
        return spark.read.parquet(dst)
    rows_in, rows_out = Observation(), Observation()
    inp = spark.read.parquet(src)
    start, t0 = datetime.now(), time.perf_counter()
    out = fn(_counted(inp, rows_in) if metrics_path else inp)
    (_counted(out, rows_out) if metrics_path else out).write.mode("overwrite").parquet(dst)
    runtime = time.perf_counter() - t0
    if metrics_path:
        stop = datetime.now()
        record_metrics(spark, metrics_path, task, runtime, _rows(spark, rows_in, src), _rows(spark, rows_out, dst), start, stop)
    return spark.read.parquet(dst)


def _counted(df: DataFrame, rows: Observation) -> DataFrame:
    return df.observe(rows, F.count(F.lit(1)).alias("rows"))


def _rows(spark: SparkSession, seen: Observation, path: str) -> int:
    """The observed count.  The optimizer drops an observed step when it learns
    at run time that nothing comes after it; then the footers have the count."""
    try:
        return seen.get["rows"]
    except (Py4JJavaError, KeyError):
        return spark.read.parquet(path).count()


def record_metrics(spark: SparkSession, metrics_path: str, task: str, runtime: float,
                   n_in: int, n_out: int, start: datetime, stop: datetime) -> None:
    """Append one row, with stage and phase from the task lookup (a join
    against the 32-row lookup table)."""
    row = spark.createDataFrame(
        [(task, float(runtime), int(n_in), int(n_out),
          n_in / runtime if runtime > 0 else None, n_out / runtime if runtime > 0 else None, start, stop)],
        "task string, runtime double, input_records long, output_records long, "
        "input_records_per_second double, output_records_per_second double, start timestamp, stop timestamp")
    j = row.join(F.broadcast(task_lookup(spark)), "task", "left")
    j.select("task", "stage", "phase", "runtime", "input_records", "output_records",
             "input_records_per_second", "output_records_per_second", "start", "stop"
             ).write.mode("append").parquet(metrics_path)


def read_metrics(spark: SparkSession, metrics_path: str, stage: str | None = None,
                 task: str | None = None) -> DataFrame:
    m = spark.read.schema(METRICS_SCHEMA).parquet(metrics_path)
    if stage:
        m = m.where(F.col("stage") == stage)
    if task:
        m = m.where(F.col("task") == task)
    return m


def register_dataset(spark: SparkSession, registry_path: str, df: DataFrame, name: str, phase: str,
                     stage: str, path: str, creator: str) -> DataFrame:
    """Validate (non-empty, known phase and stage, creator given), write the
    content, append a metadata row; return the stored content."""
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase}")
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    if not creator:
        raise ValueError("creator is required")
    if df.isEmpty():
        raise ValueError("dataset is empty")
    rows = Observation()
    _counted(df, rows).write.mode("overwrite").parquet(path)
    n = _rows(spark, rows, path)
    meta = spark.createDataFrame([(name, phase, stage, path, int(n), len(df.columns), creator, datetime.now())],
                                 REGISTRY_SCHEMA)
    meta.write.mode("append").parquet(registry_path)
    return spark.read.parquet(path)


def read_registry(spark: SparkSession, registry_path: str, name: str | None = None) -> DataFrame:
    r = spark.read.schema(REGISTRY_SCHEMA).parquet(registry_path)
    return r.where(F.col("name") == name) if name else r
