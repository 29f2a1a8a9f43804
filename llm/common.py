"""Shared helpers: scratch tables, table reading, Arrow batch sizes, shingles."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is space and the five ASCII controls 9-13.
SPACES = r" \x09-\x0D"
WORD = rf"[^{SPACES}]+"


def scratch_dir(spark: SparkSession) -> str:
    """Folder under ``spark.checkpoint.dir``, which all executors share.

    Only a local session (tests) may leave the setting unset; it then gets a
    temporary folder.  On a cluster a missing setting is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc = spark.sparkContext
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            d = jdir.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            d = tempfile.mkdtemp(prefix="llm-scratch-")
            spark.conf.set("spark.checkpoint.dir", d)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return d.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage,
    survives lost executors, and gives the planner real sizes."""
    path = new_folder(df.sparkSession, name)
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that ``stored`` has made and nobody has removed.
_made: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stored`` made."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def releasing(fn):
    """A function whose result is stored, whereupon the tables that it stored
    on the way are deleted: only for narrow results."""
    @functools.wraps(fn)
    def run(*args, **kw) -> DataFrame:
        had = set(_made)
        out = fn(*args, **kw)
        old = [p for p in _made if p not in had]
        result = stored(out, fn.__name__)
        for p in old:
            remove(out.sparkSession, p)
        return result

    return run


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches of Python stages: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def spread(df: DataFrame, n: int | None = None) -> DataFrame:
    """Round-robin over ``n`` tasks (default: the cluster's parallelism)."""
    return df.repartition(n or df.sparkSession.sparkContext.defaultParallelism)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


# -- bitmap filter ----------------------------------------------------------

BITMAP_BITS = 1 << 24


def _slot(*cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BITMAP_BITS))


def bitmap(keys: DataFrame, *cols: str) -> DataFrame:
    """One row with the array ``_bits`` of BITMAP_BITS bits (2 MB whatever the
    input) in which the hashes of the keys are set."""
    words = (keys.select(F.floor(_slot(*cols) / 64).alias("id"), (_slot(*cols) % 64).cast("int").alias("b"))
             .groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("w")))
    dense = keys.sparkSession.range(BITMAP_BITS // 64).join(words, "id", "left")
    both = F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w"))))
    return stored(dense.agg(F.transform(both, lambda x: x["w"]).alias("_bits")), "bitmap")


def split_by(df: DataFrame, bits: DataFrame, *cols: F.Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among the bitmap's keys, rows that are not): lets a
    join shuffle only the former, however wide the table is."""
    (name,) = fresh(df, "_bits")
    with_bits = df.crossJoin(F.broadcast(bits.withColumnRenamed("_bits", name)))
    hit = F.getbit(F.get(F.col(name), F.floor(_slot(*cols) / 64).cast("int")), _slot(*cols) % 64) == 1
    return with_bits.where(hit).drop(name), with_bits.where(~hit).drop(name)


# -- shingles ---------------------------------------------------------------

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_R, -1, 1 << 64)
_BYTE = np.array([(int.from_bytes(bytes([b]) * 8, "big") * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & _MASK
                  for b in range(256)], dtype=np.uint64)
_POW = {}
CHUNK_WORDS = 1 << 15


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        k = 1
        while k < size:  # doubling: out[k:2k] = out[:k] * base^k
            out[k:2 * k] = out[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        _POW[base] = have = out
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """Final avalanche step over uint64 (wraps)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text (UTF-8), A-Z lower-cased; bytes.split() splits at
    exactly the six white-space characters of ``WORD``."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _hash_run(words: list[bytes], k: int) -> np.ndarray:
    joined = b" ".join(words)
    a = np.frombuffer(joined, np.uint8)
    sp = np.flatnonzero(a == 32)
    starts = np.concatenate(([0], sp + 1))
    ends = np.concatenate((sp, [len(a)]))
    h = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * _powers(_R, len(a))[:len(a)], dtype=np.uint64, out=h[1:])
    m = max(1, len(words) - k + 1)
    s, e = starts[:m], ends[len(words) - m:]
    return mix64((h[e] - h[s]) * _powers(_INV, len(a) + 1)[s] + (e - s).astype(np.uint64))


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of all k-word shingles in order (the whole sequence as
    one when there are fewer words); worked in chunks, so memory beyond the
    result is bounded for texts of any length."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= CHUNK_WORDS:
        return _hash_run(words, k)
    step = CHUNK_WORDS - k + 1
    return np.concatenate([_hash_run(words[i:i + CHUNK_WORDS], k) for i in range(0, len(words) - k + 1, step)])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hash_of(*cols) -> F.Column:
    return F.xxhash64(*cols)
