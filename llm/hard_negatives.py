"""Hard negatives by spanning-tree bounds between anchors.

Every anchor's scores (inner products) against all rows are bounded before
they are computed.  The anchors of a shard form a spanning tree: each one
hangs below a near anchor.  If a candidate of norm ``r`` scores ``s`` at the
parent and the edge has length ``e``, it scores within ``s - e r`` and
``s + e r`` at the child (Cauchy-Schwarz on the difference of the anchors).
Only candidates whose interval meets the child's window are scored exactly;
the interval of the others goes on to the grandchildren, wider by each edge.

1. positives: the window is all that may still be among the best of the
   anchor's label, so its floor rises as better rows are found;
2. negatives: the windows follow from the positives' scores, and their floor
   rises as well once a window is full.

Anchors (a stated query set) go in shards of bounded size, each broadcast,
searched against all rows in blocks and freed before the next one.  Rows are
never shuffled: a task keeps the best few rows of each anchor, and only these
are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stored

#: Anchors per shard (one spanning tree, one broadcast of SHARD x dimension numbers).
SHARD = 4096
#: Rows of a block of candidates, and the depth of a tree: bounds are kept for
#: one path of the tree, DEPTH x BLOCK x 16 bytes (32 MB).
BLOCK, DEPTH = 16384, 128
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)


def prepared(rows: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             relabel: F.Column | None = None) -> DataFrame:
    """(id, label, q, dim): rows that take part, components as integers.

    Rows with a null id, a null label, a null vector or a null or non-finite
    component take no part; rows equal in all of these count once."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    src = rows.select(rows[id_col].cast("long").alias("id"), rows[label_col].cast("long").alias("own"), rows[vec_col].cast("array<double>").alias("v"),
                      (relabel if relabel is not None else rows[label_col]).cast("long").alias("label"))
    src = src.where("id is not null and own is not null and label is not null and v is not null").where(~bad)
    q = F.transform(v, lambda x: F.floor(x * F.lit(scale)))
    return src.select("id", "label", q.alias("q"), F.size("v").alias("dim")).distinct()


class Shard:
    """Anchors with their spanning tree.  ``parent[i]`` is before ``i`` in
    ``order`` (-1 for the root), ``edge[i]`` the distance to it."""

    def __init__(self, ids, labels, q):
        self.ids, self.labels = np.asarray(ids, np.int64), np.asarray(labels, np.int64)
        self.q = np.asarray(q, np.float64).reshape(len(self.ids), -1)
        self.parent, self.edge = spanning_tree(self.q)
        kids: list[list[int]] = [[] for _ in self.ids]
        for i, p in enumerate(self.parent):
            if p >= 0:
                kids[p].append(i)
        self.kids = kids


def spanning_tree(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point hangs below its nearest one among those before it that are
    not DEPTH - 1 edges down; the first is the root."""
    n = len(q)
    parent, edge, depth = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
    sq = (q * q).sum(1)
    for i in range(1, n):
        d = sq[:i] + sq[i] - 2 * (q[:i] @ q[i])
        d[depth[:i] >= DEPTH - 1] = np.inf
        p = int(d.argmin())
        parent[i], depth[i] = p, depth[p] + 1
        edge[i] = np.sqrt(((q[i] - q[p]) ** 2).sum())
    return parent, edge


class _Best:
    """The ``k`` rows of highest score of one list; ties by smaller id, then label and row hash."""

    __slots__ = ("k", "rows")

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> float:
        return self.rows[-1][0] if len(self.rows) >= self.k else -np.inf

    def add(self, score, ids, labels, digest):
        if len(score) > 4 * self.k:  # keep what may be among the best
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            m = score >= cut
            score, ids, labels, digest = score[m], ids[m], labels[m], digest[m]
        self.rows = sorted([*self.rows, *zip(score.tolist(), ids.tolist(), labels.tolist(), digest.tolist(), strict=True)],
                           key=lambda r: (-r[0], *r[1:]))[:self.k]


def walk(shard: Shard, vecs: np.ndarray, norms: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor, (anchor, rows, exact scores): the rows whose interval
    meets the anchor's window.  ``wanted(anchor)`` gives (allowed rows, floor,
    ceiling), or None for no row."""
    exact = len(vecs) == 0 or np.abs(shard.q).max(initial=0) * np.abs(vecs).max(initial=0) * max(1, vecs.shape[1]) < EXACT
    stack = [(0, None, None)] if len(shard.ids) else []
    while stack:
        a, lo, hi = stack.pop()
        if lo is None:  # the root: no parent, no bound
            lo, hi = np.full(len(vecs), -np.inf), np.full(len(vecs), np.inf)
            rescored = np.arange(len(vecs))
        else:
            slack = shard.edge[a] * norms
            slack += 1e-9 * slack + 1.0
            lo, hi = lo - slack, hi + slack
            want = wanted(a)
            rescored = np.flatnonzero(want[0] & (hi >= want[1]) & (lo <= want[2])) if want else np.empty(0, np.int64)
        score = _scores(vecs[rescored], shard.q[a], exact)
        lo[rescored] = hi[rescored] = score
        want = wanted(a)
        if want is not None and len(rescored):
            fits = want[0][rescored] & (score >= want[1]) & (score <= want[2])
            yield a, rescored[fits], score[fits]
        stack += [(k, lo, hi) for k in shard.kids[a]]


def _scores(rows: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return rows @ anchor
    top = (1 << 63) - 1  # sums beyond doubles' integers: Python integers, held to the range of a long
    got = [sum(int(x) * int(y) for x, y in zip(r, anchor, strict=True)) for r in rows]
    return np.array([max(-top, min(top, g)) for g in got], dtype=object)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int):
    """(ids, labels, digests, vectors, norms) of up to BLOCK rows."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            s = b.slice(at, BLOCK)
            q = s.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(s.num_rows, dim)
            yield (*[s.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "digest")], q, np.sqrt((q * q).sum(1)))


OUT = "anchor_id long, anchor_label long, anchor_digest long, slot int, id long, label long, digest long, score long"


def _search(rows: DataFrame, dim: int, task) -> DataFrame:
    """``task(blocks)`` yields tuples of OUT for one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = list(task(_blocks(batches, dim)))
        names = [c.split()[0] for c in OUT.split(", ")]
        cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
        kind = [pa.int32() if "int" == c.split()[1] else pa.int64() for c in OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], k) for c, k in zip(cols, kind, strict=True)], names=names)

    return rows.where(F.col("dim") == dim).select("id", "label", "digest", "q").mapInArrow(run, OUT)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each (anchor, slot) over all tasks, numbered from 1."""
    w = Window.partitionBy("anchor_id", "anchor_label", "anchor_digest", "slot").orderBy(F.desc("score"), "id", "label", "digest")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def positives(rows: DataFrame, shard, dim: int, k: int) -> DataFrame:
    """The ``k`` best other rows of each anchor's label."""
    def task(blocks):
        s = shard.value
        best = [_Best(k) for _ in s.ids]
        for ids, labels, digest, q, norms in blocks:
            same = {lab: labels == lab for lab in np.unique(s.labels)}

            def wanted(a):
                return same[s.labels[a]], best[a].floor(), np.inf

            for a, at, score in walk(s, q, norms, wanted):
                own = (ids[at] == s.ids[a]) & (digest[at] == s.digest[a])
                at, score = at[~own], score[~own]
                best[a].add(score, ids[at], labels[at], digest[at])
        for a, b in enumerate(best):
            for score, i, lab, dig in b.rows:
                yield s.ids[a], s.labels[a], s.digest[a], 0, i, lab, dig, score

    return _merged(_search(rows, dim, task), k)


def negatives(rows: DataFrame, shard, windows, dim: int, k: int, percent: tuple[int, int]) -> DataFrame:
    """For each anchor and window, the ``k`` best rows of other labels in it.
    ``windows`` lists, for each anchor, the scores of its positives."""
    low, high = percent

    def task(blocks):
        s, pos = shard.value, windows.value
        # 100 * score within [low, high] * positive, as whole scores
        span = [[(-(-low * p // 100), high * p // 100) for p in ps] for ps in pos]
        best = [[_Best(k) for _ in ps] for ps in pos]
        for ids, labels, digest, q, norms in blocks:
            other = {lab: labels != lab for lab in np.unique(s.labels)}

            def wanted(a):
                open_ = [(max(lo, b.floor()), hi) for (lo, hi), b in zip(span[a], best[a], strict=True) if lo <= hi]
                return (other[s.labels[a]], min(x[0] for x in open_), max(x[1] for x in open_)) if open_ else None

            for a, at, score in walk(s, q, norms, wanted):
                for (lo, hi), b in zip(span[a], best[a], strict=True):
                    m = (score >= max(lo, b.floor())) & (score <= hi)
                    if m.any():
                        b.add(score[m], ids[at[m]], labels[at[m]], digest[at[m]])
        for a, bs in enumerate(best):
            for j, b in enumerate(bs):
                for score, i, lab, dig in b.rows:
                    yield s.ids[a], s.labels[a], s.digest[a], j, i, lab, dig, score

    return _merged(_search(rows, dim, task), k)


def mine(rows: DataFrame, anchors: F.Column, positives_per_anchor: int = 5, negatives_per_positive: int = 10,
         percent: tuple[int, int] = (30, 90), shard_anchors: int = SHARD, **columns) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each row of ``rows`` where ``anchors`` (a condition on
    ``id``) holds and each of its best other rows of the same label, the best
    rows of other labels whose score lies within ``percent`` of the positive's.

    See ``prepared`` for rows that take no part; text-like columns and extra
    columns of any name are not read.  Ties go to the smaller id, then label,
    then a hash of the vector; rows that share an id but differ are rows of
    their own.  Only vectors of one length are compared with each other.
    Fewer than asked, down to none, are returned where there are no more; a
    negative positive score has no window.  Scores beyond a long are held to
    its range.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    data = stored(prepared(rows, **columns).withColumn("digest", F.xxhash64("label", "q")), "vectors")
    own = data.where(anchors)
    sizes = own.groupBy("dim").agg(F.count(F.lit(1)).alias("c")).orderBy("dim").collect()  # one row per vector length
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK))
    out = None
    for dim, count in ((r["dim"], r["c"]) for r in sizes):
        shards = -(-count // shard_anchors)
        of = F.pmod(F.xxhash64("id", "digest"), F.lit(shards))
        for n in range(shards):
            one = own.where((F.col("dim") == dim) & (of == n)).orderBy("id", "label", "digest").collect()  # about shard_anchors rows
            if not one:
                continue
            shard = Shard([r["id"] for r in one], [r["label"] for r in one], [r["q"] for r in one])
            shard.digest = np.array([r["digest"] for r in one], np.int64)
            sent = spark.sparkContext.broadcast(shard)
            best = stored(positives(data, sent, dim, positives_per_anchor), "positives")
            at = {(r["id"], r["label"], r["digest"]): i for i, r in enumerate(one)}
            found: list[list[int]] = [[] for _ in one]
            for r in best.orderBy("anchor_id", "anchor_label", "anchor_digest", "rank").collect():  # shard_anchors * positives_per_anchor rows
                found[at[r["anchor_id"], r["anchor_label"], r["anchor_digest"]]].append(r["score"])
            windows = spark.sparkContext.broadcast(found)
            neg = negatives(data, sent, windows, dim, negatives_per_positive, percent)
            key = ["anchor_id", "anchor_label", "anchor_digest"]
            pos = best.select(*key, (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            got = neg.join(pos, [*key, "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                                       "positive_score", F.col("score").alias("negative_score"))
            got = stored(got, "hard-negatives")
            sent.destroy()
            windows.destroy()
            out = got if out is None else out.union(got)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


#: DuckDB SQL of ``op13_hard_negatives``.
NEGATIVES_SQL = """
WITH q AS MATERIALIZED (
  SELECT DISTINCT cast(vec_id AS BIGINT) AS id, cast(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, cast(list_inner_product(a.q, b.q) AS BIGINT) AS s
  FROM q a JOIN q b ON len(a.q) = len(b.q) AND a.id <> b.id WHERE a.id % 100 = 0),
p AS MATERIALIZED (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, s.b AS n, p.s AS ps, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, cast(r AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE r <= 10
"""
