"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Training counts hashed n-grams per label over all training rows (one sparse
partial matrix per task, summed by Spark).  The log-probability matrix has
``labels x buckets`` cells.  With many labels neighbouring buckets are added
up, so that it stays within ``CELLS`` (256 buckets are kept in any case); it
is broadcast, and a batch is scored as sparse rows against it in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches, stored

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Cells of the matrix, and labels that a training task counts before it hands its sums on.
CELLS, HELD = 1 << 26, 64
CHUNK = 1 << 16
SHARPNESS = 40.0


def _buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased text, letters only (other runs become
    one space), chunk by chunk so that long texts take bounded memory."""
    for i in range(0, len(text), CHUNK):
        part = text[max(0, i - 2):i + CHUNK].lower()
        a = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = a < 128
        letter = ~plain | ((a >= 97) & (a <= 122))
        a = np.where(letter, a, np.uint32(32))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space after each run of letters
        a = a[keep].astype(np.uint64)
        h = np.zeros(len(a), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(a) < n:
                break
            h = h[:len(a) - n + 1] * np.uint64(0x100000001B3) + a[n - 1:] + np.uint64(n)
            if n in ORDERS:
                x = h * np.uint64(0x9E3779B97F4A7C15)
                yield ((x ^ (x >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(labels by code point, log-probability matrix float32 [labels, buckets + 1];
    the last column is the log prior).  Rows with null label or text without
    letters teach nothing."""
    spark = labelled.sparkSession
    small_batches(spark)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def handed():
            for lab, m in sums.items():
                at = np.flatnonzero(m)
                yield pd.DataFrame({"label": lab, "bucket": np.append(at, BUCKETS), "n": np.append(m[at], docs[lab])})
            sums.clear()
            docs.clear()

        for df in batches:
            for t, lab in zip(df["text"], df["label"], strict=True):
                if not has_letter(t):
                    continue
                m = sums.get(lab)
                if m is None:
                    if len(sums) >= HELD:
                        yield from handed()
                    m = sums[lab] = np.zeros(BUCKETS, np.int64)
                docs[lab] = docs.get(lab, 0) + 1
                for b in _buckets(t):
                    m += np.bincount(b, minlength=BUCKETS)
        yield from handed()

    src = labelled.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("label is not null")
    rows = (src.mapInPandas(count, "label string, bucket long, n long")
            .groupBy("label", "bucket").agg(F.sum("n").alias("n")))
    rows = stored(rows, "langid")
    buckets = buckets_for(rows.select("label").distinct().count())
    # a power of two divides a greater one, so sums of buckets are the counts of fewer buckets
    fewer = F.when(F.col("bucket") == BUCKETS, F.lit(buckets).cast("long")).otherwise(F.col("bucket") % buckets)
    got = rows.groupBy("label", fewer.alias("bucket")).agg(F.sum("n").alias("n")).toPandas()  # at most CELLS and a prior per label
    labels = sorted(got["label"].unique())
    m = np.zeros((len(labels), buckets + 1))
    m[got["label"].map({x: i for i, x in enumerate(labels)}).to_numpy(int), got["bucket"].to_numpy(int)] = got["n"].to_numpy()
    grams = m[:, :buckets] + 0.5
    out = np.empty((len(labels), buckets + 1), np.float32)
    out[:, :buckets] = np.log(grams / grams.sum(1, keepdims=True))
    out[:, buckets] = np.log((m[:, buckets] + 1) / (m[:, buckets].sum() + len(labels))) if labels else 0
    return labels, out


def buckets_for(labels: int) -> int:
    """Buckets of a matrix for so many labels: a power of two, 256 at least."""
    n = BUCKETS
    while n > 256 and labels * n > CELLS:
        n //= 2
    return n


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text",
            label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus prediction and score.

    Label ``und`` and score 0 if the text is null or has no letter, or the
    model knows no label.  The score is the posterior of the mean
    log-likelihood per n-gram times ``SHARPNESS``, so it does not saturate
    with length; ties go to the first label by code point."""
    spark = docs.sparkSession
    small_batches(spark)
    labels, matrix = model
    shared = spark.sparkContext.broadcast((labels, np.ascontiguousarray(matrix.T)))

    def score(texts: pd.Series) -> pd.DataFrame:
        names, m = shared.value
        last = len(m) - 1  # the prior
        lab, sc = [], []
        for t in texts:
            if not names or not has_letter(t):
                lab.append("und")
                sc.append(0.0)
                continue
            ll, n = np.zeros(len(names)), 0
            for b in _buckets(t):
                b = b if last == BUCKETS else b & (last - 1)
                at, k = np.unique(b, return_counts=True) if len(b) > 4096 else (b, None)
                rows = m[at]
                ll += rows.sum(0, dtype=np.float64) if k is None else k @ rows.astype(np.float64)
                n += len(b)
            z = (ll + m[last]) / max(n, 1) * min(SHARPNESS, max(n, 1))
            z = np.exp(z - z.max())
            i = int(z.argmax())
            lab.append(names[i])
            sc.append(float(z[i] / z.sum()))
        return pd.DataFrame({"l": lab, "s": sc})

    udf = F.pandas_udf(score, "l string, s double")
    tmp = "_langid"
    while tmp in docs.columns:
        tmp = "_" + tmp
    keep = [c for c in docs.columns if c not in (label_out, score_out)]
    return (docs.withColumn(tmp, udf(F.col(text_col)))
            .select(*[F.col(f"`{c}`") for c in keep], F.col(f"{tmp}.l").alias(label_out), F.col(f"{tmp}.s").alias(score_out)))


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from the rows
    that are not held out.  Repeated rows are answered each; only ``doc_id``,
    ``text`` and (for training) ``lang`` are read."""
    d = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(d.where("not held_out"))
    return predict(d.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
