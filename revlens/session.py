"""Session helpers.

Library code never creates its own session: callers pass one in.  The
builder here is for tests, the bench and command-line use.  The only
session setting the library reads is ``spark.checkpoint.dir``; it is set
here only when the caller left it unset (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library is designed around: AQE re-plans shuffles at run
# time (coalescing small partitions, splitting skewed join partitions),
# session time zone is pinned so date functions agree with DuckDB.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "revlens", extra: dict | None = None) -> SparkSession:
    """Create (or get) a session for tests and local runs."""
    master = master or os.environ.get("REVLENS_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("REVLENS_DRIVER_MEMORY", "16g")))
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    It is used as it is.  Where it is unset, a local session (tests, bench)
    gets a scratch folder; any other master is an error, because executors
    would not see a folder of the driver's.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="revlens-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "revlens-work", f"{name}-{uuid.uuid4().hex[:12]}")


#: Spark's setting that drops the files of a query's shuffles when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and
    outlives executors.  The shuffles that made it are read by nobody else, so
    their files go as soon as it is written."""
    spark = df.sparkSession
    path = shared_scratch(spark, name)
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a ``shared_table`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
