"""File sources and sinks: CSV/TSV/JSON-lines/parquet by extension,
partitioned parquet with dynamic overwrite, per-category TSV staging, the
review file-set acquisition, and file-set summaries.

Scratch output of registered queries goes under the session's shared
``spark.checkpoint.dir`` (a cluster-wide folder), never a machine-local
temporary folder.
"""

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revlens.functions import constants as K
from revlens.session import shared_scratch, shared_table

FORMATS = {".csv": "csv", ".dat": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "json",
           ".parquet": "parquet", "": "parquet"}

# FIXED VALUES: raw review file schema (one TSV per category, header row)
RAW_REVIEW_SCHEMA = ("id string, app_id string, app_name string, category_id string, category string, "
                     "author string, rating double, title string, content string, vote_count long, "
                     "vote_sum long, date timestamp")


def _fmt(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported file type: {ext}")
    return FORMATS[ext]


def load(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True) -> DataFrame:
    """Read by extension: csv/dat, tsv, json lines, parquet (file or dir)."""
    f = _fmt(path)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if f in ("csv", "tsv"):
        return r.option("header", header).option("sep", "\t" if f == "tsv" else ",").option("escape", "\\").csv(path)
    if f == "json":
        return r.json(path)
    return r.parquet(path)


def save(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] | None = None,
         header: bool = True) -> None:
    f = _fmt(path)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if f in ("csv", "tsv"):
        w.option("header", header).option("sep", "\t" if f == "tsv" else ",").option("escape", "\\").csv(path)
    elif f == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str] | None = None,
                      block_size: int = 128 * 1024 * 1024) -> None:
    """Parquet, Hive-style partition folders; overwrites only the partitions
    present in ``df`` (dynamic partition overwrite).  The data is first
    rebalanced on the partition columns: few files each, and the
    optimizer splits a partition value that is too large for one task."""
    w = df
    if partition_cols:
        w = df.hint("rebalance", *partition_cols)
    wr = (w.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .option("parquet.block.size", block_size))
    if partition_cols:
        wr = wr.partitionBy(*partition_cols)
    wr.parquet(path)


STAGED = "_staged"  # marker table beside the categories; readers skip the name
STAGED_SCHEMA = "key string, rows long, digest string, staged timestamp"


def staged_markers(spark: SparkSession, directory: str, key: str) -> DataFrame:
    """The last commit marker of each category: (key, rows, digest)."""
    path = os.path.join(directory, STAGED)
    try:
        marks = spark.read.schema(STAGED_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        marks = spark.createDataFrame([], STAGED_SCHEMA)
    last = marks.groupBy("key").agg(F.max_by(F.struct("rows", "digest"), "staged").alias("m"))
    return last.select(F.col("key").alias(key), "m.rows", "m.digest")


def stage_files(df: DataFrame, directory: str, key: str = "category", force: bool = False) -> DataFrame:
    """One TSV folder per category (``key=value``); returns (key, rows,
    digest) of the categories that were written.

    Each category's rows are digested whatever their order; a category whose
    marker says the same rows are there already is skipped unless ``force``.
    Markers are committed after the files, so a run that dies in between
    writes its categories again.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c != key]
    hashed = F.xxhash64(*[x for c in rest for x in (F.col(c).isNull(), F.col(c))])
    now = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum(hashed.cast("decimal(38,0)")).cast("string").alias("digest"))
    now = shared_table(now.withColumn(key, F.col(key).cast("string")), "staging")
    have = staged_markers(spark, directory, key).toDF("_k", "_rows", "_digest")
    todo = now if force else shared_table(now.join(
        have, F.col(key).eqNullSafe(F.col("_k")) & (F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest")), "left_anti"), "staging")
    if todo.isEmpty():
        return todo
    names = todo.select(F.col(key).alias("_k"))
    rows = df.join(names, df[key].cast("string").eqNullSafe(names["_k"]), "left_semi")
    (rows.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key)
         .option("header", True).option("sep", "\t").option("escape", "\\").csv(directory))
    todo.select(F.col(key).alias("key"), "rows", "digest", F.current_timestamp().alias("staged")).write.mode("append").parquet(
        os.path.join(directory, STAGED))
    return todo


def acquire_reviews(spark: SparkSession, pattern: str, schema: str = RAW_REVIEW_SCHEMA,
                    exclude: str = K.EXCLUDED_CATEGORY, anonymize: bool = True) -> DataFrame:
    """Read every TSV matching ``pattern``; skip files whose path contains
    ``exclude``; drop ``title``; drop incomplete rows and repeats per file
    (file name is part of the key); hash the author; union all files."""
    from revlens.operators.features import anonymize as anon
    from revlens.operators.quality import split_repeated
    try:
        spark.read.format("binaryFile").load(pattern)
    except AnalysisException as e:
        raise FileNotFoundError(f"no .tsv files match {pattern}") from e
    raw = (spark.read.schema(schema).option("header", True).option("sep", "\t").option("escape", "\\")
           .csv(pattern).withColumn("_file", F.col("_metadata.file_path")))
    raw = raw.where(~F.col("_file").contains(exclude)).drop("title")
    raw = raw.na.drop("any")
    # rows that no other row may equal pass where they are: only 8 bytes of each are counted
    single, *again = split_repeated(raw, raw.columns)
    for part in again:
        single = single if part is None else single.unionByName(part.dropDuplicates())
    out = single.drop("_file")
    return out.withColumn("author", anon(F.col("author"))) if anonymize else out


def fileset_overview(spark: SparkSession, pattern: str, sep: str = "\t", key: str | None = None) -> DataFrame:
    """Per file: category (of its ``key=value`` folder, if ``key`` is given),
    name, rows, columns, size on disk (MB), bytes of its values, and a Total
    row.

    Every file has its own header, so files may differ in their columns: a
    file's first line (the least line number of the block at offset 0) is its
    header, the others are rows.  Lines are read once, in blocks, and summed by
    file; the value bytes are those of the fields without separators and
    surrounding quotes.
    """
    line = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                                           F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"))
    fields = F.split("value", sep if len(sep) > 1 else f"[{sep}]", -1)
    taken = F.aggregate(F.transform(fields, lambda f: F.octet_length(F.regexp_replace(f, '^"|"$', "")).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    head = F.struct(F.col("block"), F.col("no"), F.size(fields).alias("columns"), taken.alias("bytes"))
    per = line.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(taken).alias("bytes"), F.max("size").alias("size"), F.min(head).alias("h"))
    name = F.regexp_extract("file", rf"(?:^|/){key}=([^/]*)/", 1) if key else F.lit(None).cast("string")
    per = per.select(F.url_decode(F.url_decode(name)).alias("category") if key else name.alias("category"), "file", (F.col("lines") - 1).alias("rows"),
                     F.col("h.columns").cast("long").alias("columns"), "size", (F.col("bytes") - F.col("h.bytes")).alias("value_bytes"))
    total = per.agg(F.lit("Total").alias("category"), F.lit("Total").alias("file"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                    F.max("columns").alias("columns"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
                    F.coalesce(F.sum("value_bytes"), F.lit(0)).alias("value_bytes"))
    return per.unionByName(total).select("category", "file", "rows", "columns", F.bround(F.col("size") / (1024 * 1024), 2).alias("size_mb"), "value_bytes")


def staged_completeness(df: DataFrame, key: str = "category") -> DataFrame:
    """Per group: rows, columns, fully non-null rows, percent complete (2 dp),
    and a Total row whose percent is recomputed from the totals."""
    full = F.lit(True)
    for c in df.columns:
        full = full & F.col(c).isNotNull()
    g = df.rollup(key).agg(F.count(F.lit(1)).alias("rows"), F.count_if(full).alias("complete"),
                           F.grouping(key).alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col(key)).alias(key), "rows",
                    F.lit(len(df.columns)).alias("columns"), "complete",
                    F.bround(F.col("complete") * 100.0 / F.col("rows"), 2).alias("percent"))
