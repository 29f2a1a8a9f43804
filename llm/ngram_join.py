"""N-gram Jaccard join by count vectors and R-trees.

Every text is its set of k-word shingles.  Shingles are hashed into
``GROUPS`` groups; the counts per group are the text's point, and for two
points the sum of coordinate minima is at least the intersection of the
sets.  Rows flow as follows:

1. texts with equal sets are one class (a map-side combined aggregation);
2. a class goes to the tiles of its rarest shingles: any two sets that are
   similar enough share one of the first ``n - ceil(t n) + 1`` in a fixed
   order (rare hash groups first, counted over all texts).  Tiles are the
   root fan-out of the index, and equi-join keys for Spark;
3. within a tile, points form a packed R-tree whose boxes prune pairs by the
   summed minima of their upper corners; pairs that survive the bound on
   finer groups, too, are verified on the exact sets.

Groups of near copies are not compared pair by pair: first every class is
verified with its tile's leader only, then rows that pass the bounds with a
row of another component meet in units of bounded size, where links that join
nothing new are skipped.  What is skipped is already connected, so components
are exact.  Candidates never leave a task as pairs: a step emits at most the
rows that go into it, or a forest of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import as_long, bitmap, mix64, releasing, shingles, small_batches, split_by, stored, words_of
from llm.components import components

GROUPS = 64
FREQ_GROUPS = 1 << 18
#: Rows and shingles of a block; a unit is one block or two.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 21
LEAF = 16
SMALL = 48
SIG = "doc_id long, h long, n long, f1 long, f2 long, keys array<long>, vec binary"


def prefix_len(n: int, percent: int) -> int:
    """Shingles to index: similar sets share at least ceil(t n) of n."""
    return n - -(-percent * n // 100) + 1


def _sets(texts, k: int) -> Iterator[np.ndarray]:
    for t in texts:
        yield np.unique(shingles(words_of(t), k))


def _group_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Texts' shingles per frequency group, over all texts (FREQ_GROUPS sums to the driver)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(FREQ_GROUPS, np.int64)
        for df in batches:
            got = [s for s in _sets(df["text"], k) if len(s)]
            if got:
                c += np.bincount((np.concatenate(got) >> np.uint64(46)).astype(np.int64), minlength=FREQ_GROUPS)
        at = np.flatnonzero(c)
        yield pd.DataFrame({"g": at, "c": c[at]})

    got = docs.select("text").mapInPandas(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(FREQ_GROUPS, np.int64)
    out[got["g"].to_numpy()] = got["c"].to_numpy()
    return out


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, h (hash of the text), n, set fingerprint, tile keys and point of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    freq = spark.sparkContext.broadcast(_group_counts(docs, k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = freq.value
        for df in batches:
            n, f1, f2, keys, vecs = [], [], [], [], []
            for s in _sets(df["text"], k):
                order = np.lexsort((s, counts[(s >> np.uint64(46)).astype(np.int64)]))
                n.append(len(s))
                f1.append(mix64(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64))
                f2.append(mix64(s ^ np.uint64(0xABCDEF0123)).sum(dtype=np.uint64))
                keys.append(as_long(s[order[:prefix_len(len(s), percent)]]) if len(s) else np.empty(0, np.int64))
                vecs.append(_point_bytes(s))
            yield pd.DataFrame({"doc_id": df["doc_id"], "h": df["h"], "n": n, "f1": as_long(np.array(f1, np.uint64)),
                                "f2": as_long(np.array(f2, np.uint64)), "keys": keys, "vec": vecs})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return stored(src.mapInPandas(run, SIG), "signatures")


# -- R-tree -----------------------------------------------------------------

class RTree:
    """Packed R-tree over points (rows of counts), ordered by size."""

    def __init__(self, points: np.ndarray):
        self.points, self.n = points, points.sum(1)
        # leaves: neighbours by size, then by the most uneven coordinate
        self.order = np.lexsort((points[:, points.var(0).argmax()], self.n // max(1, int(self.n.mean()) // 16)))
        ids = [self.order[i:i + LEAF] for i in range(0, len(points), LEAF)]
        level = [(i, points[i].max(0), self.n[i].min(), self.n[i].max(), None) for i in ids]
        while len(level) > 1:
            up = []
            for i in range(0, len(level), LEAF):
                c = level[i:i + LEAF]
                up.append((None, np.max([x[1] for x in c], 0), min(x[2] for x in c), max(x[3] for x in c), c))
            level = up
        self.root = level[0]

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs whose summed minima may reach the threshold."""
        out_a, out_b, todo = [], [], [(self.root, self.root)]
        while todo:
            x, y = todo.pop()
            low, high = min(x[2], y[2]), max(x[2], y[2])
            if 100 * min(x[3], y[3]) < percent * high:
                continue  # sizes too far apart
            if (100 + percent) * np.minimum(x[1], y[1]).sum() < percent * (low + high):
                continue
            if x[4] is not None:
                kids = x[4]
                todo += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))] if x is y else \
                    [(i, j) for i in kids for j in y[4]]
                continue
            i, j = np.repeat(x[0], len(y[0])), np.tile(y[0], len(x[0]))
            if x is y:
                keep = np.repeat(np.arange(len(x[0])), len(x[0])) < np.tile(np.arange(len(x[0])), len(x[0]))
                i, j = i[keep], j[keep]
            ok = bound_ok(self.points[i], self.points[j], self.n[i], self.n[j], percent)
            out_a.append(i[ok])
            out_b.append(j[ok])
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, int), np.empty(0, int))


def bound_ok(p, q, n, m, percent: int) -> np.ndarray:
    """Sizes and summed minima allow |A & B| * 100 >= percent * |A | B|."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & \
        ((100 + percent) * np.minimum(p, q).sum(-1, dtype=np.int64) >= percent * (n + m))


def groups_of(n: int) -> int:
    """Groups of a set's point: a power of two, about eight shingles each, so
    that long texts are told apart as well as short ones."""
    return max(GROUPS, 1 << max(0, (n // 8 - 1)).bit_length())


def _point_bytes(s: np.ndarray) -> bytes:
    """Counts of a set's groups in the narrowest of 1, 2 and 4 bytes that holds them, the width first."""
    g = groups_of(len(s))
    counts = np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g)
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _folded(vecs, at: np.ndarray, g: int) -> np.ndarray:
    """Counts of the rows ``at`` in ``g`` groups (finer points are added up)."""
    out = np.empty((len(at), g), np.int64)
    kind = np.array([(vecs[i][0], len(vecs[i])) for i in at]).reshape(-1, 2)
    for w, size in np.unique(kind, axis=0):
        here = np.flatnonzero((kind == (w, size)).all(1))
        raw = b"".join(vecs[at[i]][1:] for i in here)
        out[here] = np.frombuffer(raw, f"<u{w}").reshape(len(here), -1, g).sum(1, dtype=np.int64)
    return out


def _points(vecs) -> np.ndarray:
    """Points in GROUPS dimensions."""
    return _folded(vecs, np.arange(len(vecs)), GROUPS)


def fine_ok(vecs, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the pairs pass the bound on the finer points that both have."""
    g = np.array([(len(v) - 1) // v[0] for v in vecs], np.int64)
    both, ok = np.minimum(g[i], g[j]), np.ones(len(i), bool)
    for size in np.unique(both[both > GROUPS]):
        here = np.flatnonzero(both == size)
        step = max(1, (1 << 22) // int(size))
        for at in range(0, len(here), step):
            part = here[at:at + step]
            rows, place = np.unique(np.concatenate((i[part], j[part])), return_inverse=True)
            points = _folded(vecs, rows, int(size))
            a, b = place[:len(part)], place[len(part):]
            ok[part] = bound_ok(points[a], points[b], n[i[part]], n[j[part]], percent)
    return ok


def _unit_pairs(points: np.ndarray, start: np.ndarray, end: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (i, j, unit) within the units [start, end) of rows:
    units of up to SMALL rows are single leaves, scanned together; larger
    ones get an R-tree each."""
    n = points.sum(1)
    size = end - start
    unit = np.repeat(np.arange(len(size)), size)
    stop = end[unit]
    out = []
    small = size[unit] <= SMALL
    for o in range(1, int(size[size <= SMALL].max(initial=0))):
        i = np.flatnonzero(small & (np.arange(len(unit)) + o < stop))
        i = i[100 * np.minimum(n[i], n[i + o]) >= percent * np.maximum(n[i], n[i + o])]
        i = i[bound_ok(points[i], points[i + o], n[i], n[i + o], percent)]
        out.append((i, i + o, unit[i]))
    for u in np.flatnonzero(size > SMALL):
        i, j = RTree(points[start[u]:end[u]]).pairs(percent)
        out.append((start[u] + i, start[u] + j, np.full(len(i), u)))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in range(3))


def _in_units(batches: Iterator[pd.DataFrame], names: list[str], work) -> Iterator[pd.DataFrame]:
    """Calls ``work(df, cuts)`` on whole units: runs of rows equal in ``names``, one from cut to cut."""
    rest = None
    for df in batches:
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        edge = np.zeros(max(len(df) - 1, 0), bool)
        for c in names:
            v = df[c].to_numpy()
            edge |= v[1:] != v[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(edge) + 1))
        last = int(cuts[-1])
        if last:
            yield work(df.iloc[:last], cuts)
        rest = df.iloc[last:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield work(rest, np.array([0, len(rest)]))


def _active(units: DataFrame, vecs: DataFrame, percent: int) -> DataFrame:
    """(key, cid): the rows that pass the bounds with a row of another
    component in their unit.  A unit has an R-tree and gives at most its own
    rows.  ``units`` has u1 (the tile), u2, u3, side, cid and label."""
    name = ["u1", "u2", "u3"]
    rows = units.join(vecs, "cid").repartition(*name).sortWithinPartitions(*name).select(*name, "side", "cid", "label", "vec")

    def work(df, cuts):
        vecs = list(df["vec"])
        points = _points(vecs)
        i, j, _ = _unit_pairs(points, cuts[:-1], cuts[1:], percent)
        lab, side, cid, key = (df[c].to_numpy() for c in ("label", "side", "cid", "u1"))
        crossed = np.repeat(np.maximum.reduceat(side, cuts[:-1]), np.diff(cuts)) > 0  # the unit has two sides
        ok = (lab[i] != lab[j]) & (~crossed[i] | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        fine = fine_ok(vecs, points.sum(1), i, j, percent)
        hit = np.unique(np.concatenate((i[fine], j[fine])))
        return pd.DataFrame({"key": key[hit], "cid": cid[hit]})

    units.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16384")
    return rows.mapInPandas(lambda b: _in_units(b, name, work), "key long, cid long").distinct()


def _band(percent: int) -> F.Column:
    """Band of the size ``n``: sizes that may be linked lie in one band or in
    neighbours (the bands are a trifle wider, for rounding)."""
    return F.floor(F.log("n") / float(np.log(100 / percent) * (1 + 1e-9)))


def _blocks(rows, shingles_, times: int = 1) -> F.Column:
    return F.greatest(F.ceil(rows / (times * BLOCK_ROWS)), F.ceil(shingles_ / (times * BLOCK_SHINGLES)), F.lit(1)).cast("long")


# -- verification -----------------------------------------------------------

def _verified(units: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) found within units, on the exact sets: for each unit a
    forest that joins all rows of it that are linked, by way of ``label``.

    ``units`` has u1, u2, u3 (the unit), side, cid and label; where a unit has
    rows of side 1, only rows of different sides are compared.  The text of
    one member of each class goes to its units and nowhere else."""
    small_batches(docs.sparkSession, 128)
    name = ["u1", "u2", "u3"]
    units = stored(units.join(classes.select("cid", "rep", "rep_h"), "cid"), "units")
    src = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("rep_h"), "text")
    src, _ = split_by(src, bitmap(units.select("rep", "rep_h").distinct(), "rep", "rep_h"), F.col("rep"), F.col("rep_h"))
    same = src["rep"].eqNullSafe(units["rep"]) & (src["rep_h"] == units["rep_h"])
    rows = src.join(units, same).select(*name, "side", "cid", "label", "text")

    def work(df, cuts):
        out = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = df.iloc[s:e].drop_duplicates("cid")  # rows repeated in the input
            if part["label"].nunique() > 1:
                out += _forest(part, k, percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = rows.repartition(*name).sortWithinPartitions(*name)
    return rows.mapInPandas(lambda b: _in_units(b, name, work), "a long, b long")


def _forest(unit: pd.DataFrame, k: int, percent: int) -> list[tuple[int, int]]:
    """Linked pairs of the unit that join rows not yet joined."""
    sets = list(_sets(unit["text"], k))
    n = np.array([len(s) for s in sets])
    vecs = [_point_bytes(s) for s in sets]
    points = _points(vecs)
    i, j, _ = _unit_pairs(points, np.array([0]), np.array([len(sets)]), percent)
    side, label, cid = (unit[c].to_numpy() for c in ("side", "label", "cid"))
    ok = (label[i] != label[j]) & ((side[i] != side[j]) if side.any() else True)
    i, j = i[ok], j[ok]
    ok = fine_ok(vecs, n, i, j, percent)
    i, j = i[ok], j[ok]
    near = np.minimum(points[i], points[j]).sum(1) / np.maximum(1, n[i] + n[j])
    up = {x: x for x in label.tolist()}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for at in np.argsort(-near, kind="stable").tolist():  # likely links first: more of the rest is joined already
        a, b = int(i[at]), int(j[at])
        x, y = root(int(label[a])), root(int(label[b]))
        if x == y:
            continue
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * both >= percent * (n[a] + n[b] - both):
            up[x] = y
            out.append((int(cid[a]), int(cid[b])))
    return out


# -- the join ---------------------------------------------------------------

def _labelled(links: DataFrame) -> DataFrame:
    """cid -> label of its component so far."""
    c = stored(components(links), "labels")
    return c.select(F.col("node").alias("cid"), F.col("component").alias("label"))


def _classes(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, body).  ``classes``: one narrow row per set (f1, f2, cid, low =
    smallest doc_id, rep, rep_h = one member, c = rows); ``body``: cid, n, keys
    and vec, straight from the rows whose set occurs once; only sets that
    occur again are grouped.

    cid is f1, unless sets that differ share it."""
    per = sig.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "h")).alias("one"), F.count(F.lit(1)).alias("c"))
    per = stored(per.select("f1", "f2", "low", F.col("one.doc_id").alias("rep"), F.col("one.h").alias("rep_h"), "c"), "classes")
    clash = stored(per.groupBy("f1").agg(F.min("f2").alias("lo"), F.max("f2").alias("hi")).where("lo != hi").select("f1"), "clashes")
    again = per.where("c > 1").select("f1", "f2")
    maybe, once = split_by(sig.where("n > 0"), bitmap(again, "f1", "f2"), F.col("f1"), F.col("f2"))
    first = stored(maybe.groupBy("f1", "f2").agg(*[F.any_value(c).alias(c) for c in ("n", "keys", "vec")]), "copied")
    body = once.select("f1", "f2", "n", "keys", "vec").union(first)
    if clash.isEmpty():
        named = lambda d: d.withColumn("cid", F.col("f1"))
    else:
        marks = clash.withColumn("_m", F.lit(True))
        named = lambda d: d.join(marks, "f1", "left").withColumn("cid", F.when(F.col("_m"), F.xxhash64("f1", "f2")).otherwise(F.col("f1"))).drop("_m")
    return named(per), named(body)


def _distinct_tiles(tiles: DataFrame) -> DataFrame:
    """``tiles`` (key, cid, ...) without tiles that hold the same classes as
    another one; ``w`` is how many the kept one stands for, ``c`` its rows."""
    members = tiles.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("cid")).alias("x"),
                                       F.sum(F.xxhash64("cid", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    kept = members.groupBy("c", "x", "s").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("w")).where("c > 1").select("key", "c", "w")
    return tiles.join(kept, "key")


def _maximal_tiles(tiles: DataFrame) -> DataFrame:
    """``tiles`` (key, cid, c, ...) without tiles all of whose classes have one
    and the same other tile as their largest: that one holds every pair."""
    top = tiles.groupBy("cid").agg(F.max(F.struct("c", "key")).alias("top")).select("cid", F.col("top.key").alias("top"))
    inside = tiles.join(top, "cid").groupBy("key").agg(F.min("top").alias("lo"), F.max("top").alias("hi")).where("lo = hi and lo != key")
    return tiles.join(inside.select("key"), "key", "left_anti")


def _tiles(body: DataFrame, percent: int) -> DataFrame:
    """(key, cid, n, c, w): classes that share an indexed shingle."""
    rows = body.select("cid", "n", F.explode("keys").alias("key"))
    # a tile whose classes all lie in bands of size (mod 64) of their own, none
    # beside another, holds no pair that the sizes allow
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(_band(percent), F.lit(64)).cast("int"))
    alone = "bit_count(m) = c and (m & (shiftleft(m, 1) | shiftrightunsigned(m, 63))) = 0"
    shared = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_or(bit).alias("m"))
                    .where(f"c > 1 and not ({alone})").select("key"), "shared")
    # only rows that the bitmap cannot rule out go through the join
    rows, _ = split_by(rows, bitmap(shared, "key"), F.col("key"))
    return stored(_distinct_tiles(stored(rows.join(shared, "key"), "tiles")), "tiles")


def _star_units(tiles: DataFrame, vecs: DataFrame, percent: int) -> DataFrame:
    """Every class with the leader it meets most; a tile's leader is its class
    with most partners over all tiles: among near copies the text that the
    others derive from.  A leader's followers go in blocks."""
    weight = tiles.groupBy("cid").agg(F.sum(F.col("w") * (F.col("c") - 1)).alias("weight"))
    lead = tiles.join(weight, "cid").groupBy("key").agg(F.max(F.struct("weight", "cid", "n")).alias("lead"))
    star = (tiles.join(lead, "key").where("cid != lead.cid")
            .where(f"100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)")
            .groupBy("cid", F.col("lead.cid").alias("a")).agg(F.sum("w").alias("m"), F.any_value("n").alias("n"))
            .groupBy("cid").agg(F.max(F.struct("m", "a")).alias("best"), F.any_value("n").alias("n"))
            .select(F.col("best.a").alias("a"), F.col("cid").alias("b"), "n"))
    star = stored(_bounded(star, vecs, percent), "star")
    blocks = star.groupBy("a").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("nb"))
    follow = star.join(blocks, "a").select(F.col("a").alias("u1"), F.pmod(F.xxhash64("b"), F.col("nb")).alias("u2"), F.lit(0).cast("long").alias("u3"),
                                           F.lit(1).alias("side"), F.col("b").alias("cid"), F.col("b").alias("label"))
    leaders = blocks.select(F.col("a").alias("u1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("u2"),
                            F.lit(0).cast("long").alias("u3"), F.lit(0).alias("side"), F.col("a").alias("cid"), F.col("a").alias("label"))
    return follow.union(leaders)


def _rest_units(rows: DataFrame, times: int = 1) -> DataFrame:
    """Units of the rows (key, cid, n, label) that may still be linked.  A
    tile's largest component is never compared with itself: its blocks meet
    the blocks of the other rows, and those meet each other.  ``times`` makes
    the blocks larger, where units hold points and not texts."""
    part = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    main = part.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top")).select("key", F.col("top.label").alias("main"))
    rows = rows.join(main, "key").withColumn("in_main", F.col("label") == F.col("main"))
    count = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0))
    size = rows.groupBy("key").agg(_blocks(count(F.col("in_main"), 1), count(F.col("in_main"), F.col("n")), times).alias("nm"),
                                   _blocks(count(~F.col("in_main"), 1), count(~F.col("in_main"), F.col("n")), times).alias("no"))
    rows = rows.join(size, "key")
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("in_main"), F.col("nm")).otherwise(F.col("no")))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    # u2 >= 0: block of the others with u3 = block of the main component; u2 < 0: two blocks of the others
    cross = F.when(F.col("in_main"), F.transform(upto("no"), lambda o: F.struct(o.alias("u2"), F.col("own").alias("u3"), F.lit(1).alias("side")))) \
        .otherwise(F.transform(upto("nm"), lambda m: F.struct(F.col("own").alias("u2"), m.alias("u3"), F.lit(0).alias("side"))))
    among = F.when(F.col("in_main"), F.array().cast("array<struct<u2:bigint,u3:bigint,side:int>>")).otherwise(
        F.transform(upto("no"), lambda o: F.struct((-1 - F.least(o, F.col("own"))).alias("u2"), F.greatest(o, F.col("own")).alias("u3"),
                                                   F.when(F.col("own") > o, 1).otherwise(0).alias("side"))))
    out = rows.withColumn("own", own).select(F.col("key").alias("u1"), "cid", "label", F.explode(F.concat(cross, among)).alias("u"))
    return out.select("u1", "u.u2", "u.u3", "u.side", "cid", "label")


def _meeting(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (key, cid, n, label) with a row of another component in their
    tile whose size may allow a link: one in the same band of sizes or beside it."""
    rows = rows.withColumn("band", _band(percent))
    near = Window.partitionBy("key").orderBy("band").rangeBetween(-1, 1)  # over a tile's bands, which are few
    per = rows.groupBy("key", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    ends = per.select("key", "band", F.min("lo").over(near).alias("lo"), F.max("hi").over(near).alias("hi")).where("lo < hi")
    return rows.join(ends.select("key", "band"), ["key", "band"]).drop("band")


def linked_classes(docs: DataFrame, sig: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per class: f1, f2, component (the smallest doc_id of all
    classes reachable by links)."""
    classes, body = _classes(sig)
    tiles, vecs = _tiles(body, percent), body.select("cid", "vec")
    links = stored(_verified(_star_units(tiles, vecs, percent), docs, classes, k, percent), "links")
    label = _labelled(links)
    # rows of tiles with another component near their size, with their points
    mixed = tiles.select("key", "cid", "n").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = stored(_meeting(mixed, percent), "mixed")
    active = mixed.join(_active(_rest_units(mixed, 8), vecs, percent), ["key", "cid"])
    active = stored(_distinct_tiles(stored(active, "active")), "active")
    active = stored(_maximal_tiles(active).select("key", "cid", "n", "label"), "active")
    links = links.union(stored(_verified(_rest_units(active), docs, classes, k, percent), "links"))
    label = _labelled(links)
    out = classes.select("f1", "f2", "cid", "low").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    lows = out.groupBy("label").agg(F.min("low").alias("component"))
    return out.join(lows, "label").select("f1", "f2", "component")


def _bounded(pairs: DataFrame, vecs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n) that pass the size and point bounds."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                vecs = [*df["x"], *df["y"]]
                points, i = _points(vecs), np.arange(len(df))
                p, q, n = points[:len(df)], points[len(df):], points.sum(1)
                df = df.loc[bound_ok(p, q, p.sum(1), q.sum(1), percent) & fine_ok(vecs, n, i, i + len(df), percent)]
            yield df[["a", "b", "n"]]

    j = (pairs.join(vecs.select(F.col("cid").alias("a"), F.col("vec").alias("x")), "a")
         .join(vecs.select(F.col("cid").alias("b"), F.col("vec").alias("y")), "b"))
    return j.select("a", "b", "n", "x", "y").mapInPandas(run, "a long, b long, n long")


@releasing
def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, h, n_shingles and
    component_id.

    Null, empty and blank texts have no shingles and link with nothing: their
    component is their own id.  Repeated rows are one class.  Null ids link
    like others, but a component's id is the smallest that is not null.  An
    empty table gives no rows.  Other columns are not read."""
    sig = signatures(docs, k, percent)
    classes = linked_classes(docs, sig, k, percent)
    narrow = sig.select("doc_id", "h", F.col("n").alias("n_shingles"), "f1", "f2")
    full = narrow.where("n_shingles > 0").join(classes, ["f1", "f2"]).select("doc_id", "h", "n_shingles", F.col("component").alias("component_id"))
    return full.union(narrow.where("n_shingles = 0").select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id")))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (ties: by
    hash of the text; of repeated rows, one)."""
    rows = join(docs, k, percent)
    # a row without shingles or with a null component is a group of its own
    rows = rows.where("n_shingles > 0 and component_id is not null")
    per = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("c"), F.min("component_id").alias("component_id"))
    first = per.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("f"))
    per = per.join(first, "component_id").withColumn("keep", F.struct(F.col("doc_id").isNull(), "doc_id", "h") == F.col("f"))
    gone = stored(per.where("not keep or c > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "keep"), "dropped")
    same = lambda d, g: d["doc_id"].cast("long").eqNullSafe(g["_id"]) & (F.xxhash64(d["text"]) == g["_h"])
    # only rows that the bitmap cannot rule out go through the join
    maybe, clear = split_by(docs, bitmap(gone, "_id", "_h"), F.col("doc_id").cast("long"), F.xxhash64("text"))
    kept = clear.unionByName(maybe.join(gone, same(maybe, gone), "left_anti"))
    again = gone.where("keep")  # repeated rows of which one stays
    if again.isEmpty():
        return kept
    return kept.unionByName(maybe.join(again, same(maybe, again), "left_semi").dropDuplicates(["doc_id", "text"]))
