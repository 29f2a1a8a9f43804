"""Embedding near-dedup by sorted projection passes.

In each pass all vectors are ordered by the concatenated sign bits of random
projections (a range sort) and every vector meets a bounded window of
neighbours.  A pass carries keys and a sketch of SKETCH sign bits, not the
vectors: a pair whose sketches differ in so many bits that six standard
deviations part it from the threshold is dropped, the distinct pairs of all
passes fetch their vectors once, and those of cosine >= ``threshold`` are links.

Equal vectors are one row, with a count, before anything is sorted.  A window
cannot count the links inside a large tight group, so such groups are folded
first.  The first pass gathers runs of close vectors around
leaders; the vectors within half the threshold angle of such a run's
centroid form a ball, whose members are all linked to one another by the
triangle inequality of angles.  In the windows a ball is one entity, known by
its centre: it meets what lies within the threshold angle of its rim.  Two
entities that meet are decided by centre distance and radii where that
suffices and member by member, in blocks, where it does not; so every link
counted is exact whatever the size of a group.

The passes grow with the table, so that a pair at the threshold among spread
vectors meets with probability RECALL.  Where a vector has as many links as a
window holds, more may lie beyond it: the entities of its component are
compared all with all, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import releasing, stored
from llm.components import components

THRESHOLD = 0.95
RECALL = 0.99
PASSES = 12  # at least
WINDOW = 40
BITS = 64
SKETCH, SIGMAS = 256, 6
LEADERS = 32
LEAD_COS = 0.965
MERGE_COS = 0.995
BLOCK = 2048
EPS = 1e-7


def _unit(raw: list[bytes], dtype: str) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(u: np.ndarray, p: int) -> np.ndarray:
    """Sort keys of pass ``p``: sign bits of BITS random projections, as a signed long in bit order."""
    r = np.random.default_rng([p, u.shape[1]]).standard_normal((u.shape[1], BITS))
    bits = np.packbits(u @ r > 0, axis=1)
    return (bits.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _sketch(u: np.ndarray) -> np.ndarray:
    """SKETCH sign bits of each row, as rows of 64-bit words."""
    r = np.random.default_rng([1 << 20, u.shape[1]]).standard_normal((u.shape[1], SKETCH))
    return np.packbits(u @ r > 0, axis=1).view(np.uint64)


def prepare(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(rid, vec_id, dim, raw bytes or null if the vector links with nothing), stored."""
    kind = vectors.schema["embedding"].dataType
    dtype = "<f4" if isinstance(kind.elementType, T.FloatType) else "<f8"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            raw = []
            for e in df["embedding"]:
                x = None if e is None or len(e) == 0 else np.asarray(e, dtype=np.float64)
                good = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
                raw.append(x.astype(dtype).tobytes() if good else None)
            yield pd.DataFrame({"rid": df["rid"], "vec_id": df["vec_id"], "raw": raw,
                                "dim": [0 if b is None else len(b) // int(dtype[2]) for b in raw]})

    src = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return stored(src.mapInPandas(run, "rid long, vec_id long, raw binary, dim int"), "vectors"), dtype


def passes_for(rows: int, threshold: float) -> int:
    """Passes after which two vectors at the threshold have met with
    probability RECALL: in one pass they meet if they agree in the leading
    bits that cut the rows down to a window."""
    if rows <= WINDOW:
        return PASSES
    meet = (1 - math.acos(threshold) / math.pi) ** math.log2(rows / WINDOW)
    return max(PASSES, math.ceil(math.log(1 - RECALL) / math.log1p(-meet)))


def _limits(threshold: float) -> np.ndarray:
    """Least cosine at which entities may hold linked members, by how many of
    the two are balls (of at most half the threshold angle)."""
    limit = math.acos(threshold)
    return np.array([threshold] + [math.cos(min(math.pi, limit + k * limit / 2)) - 1e-5 for k in (1, 2)])


def _bit_limits(threshold: float) -> np.ndarray:
    """Most bits in which the sketches of such entities differ, but for chances
    of SIGMAS standard deviations."""
    p = np.arccos(_limits(threshold)) / math.pi
    return SKETCH * p + SIGMAS * np.sqrt(SKETCH * p * (1 - p))


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _gather(rows: DataFrame, dtype: str, p: int, cos: float) -> DataFrame:
    """Leaders in the order of pass ``p``.  Rows (rid, dim, raw, weight, total):
    ``total`` is the sum vector a row stands for.  Output: kind 0, (rid, its
    leader); kind 1, (leader, weight, sum vector) of each run."""
    def key(batches):
        for df in batches:
            out = np.zeros(len(df), np.int64)
            for d in np.unique(df["dim"]):
                at = np.flatnonzero(df["dim"] == d)
                out[at] = _keys(_unit(df["raw"].iloc[at].tolist(), dtype), p)
            yield df.assign(key=out)

    def run(batches):
        lead, unit, sums, weight, dim = [], None, [], [], None
        for df in batches:
            rid_out, lead_out, done = [], [], []
            for d, rid, raw, w, total in zip(df["dim"], df["rid"], df["raw"], df["weight"], df["total"], strict=True):
                if d != dim:
                    done += zip(lead, weight, sums, [dim] * len(lead), strict=True)
                    lead, sums, weight, dim = [], [], [], d
                    unit = np.empty((0, d))
                u = _unit([raw], dtype)[0]
                v = u * w if total is None else np.frombuffer(total, "<f8")
                near = unit @ u if len(lead) else np.empty(0)
                if len(lead) and near.max() >= cos:
                    i = int(near.argmax())
                    sums[i] = sums[i] + v
                    weight[i] += w
                    # recently used leaders stay
                    lead.append(lead.pop(i)), sums.append(sums.pop(i)), weight.append(weight.pop(i))
                    unit = np.concatenate((unit[:i], unit[i + 1:], unit[i:i + 1]))
                else:
                    if len(lead) == LEADERS:
                        done.append((lead.pop(0), weight.pop(0), sums.pop(0), dim))
                        unit = unit[1:]
                    lead.append(rid), sums.append(v), weight.append(w)
                    unit = np.concatenate((unit, u[None]))
                rid_out.append(rid)
                lead_out.append(lead[-1])
            yield pd.DataFrame({"kind": 0, "rid": rid_out, "lead": lead_out, "weight": 0, "dim": 0, "total": None})
            yield _sums(done)
        yield _sums(list(zip(lead, weight, sums, [dim] * len(lead), strict=True)))

    def _sums(done):
        return pd.DataFrame({"kind": 1, "rid": [x[0] for x in done], "lead": [x[0] for x in done], "weight": [x[1] for x in done],
                             "dim": [x[3] for x in done], "total": [x[2].astype("<f8").tobytes() for x in done]})

    cols = "rid long, dim int, raw binary, weight long, total binary"
    keyed = rows.mapInPandas(key, cols + ", key long")
    out = "kind int, rid long, lead long, weight long, dim int, total binary"
    return stored(_sorted(keyed, "dim", "key").mapInPandas(run, out), "gathered")


def entities(base: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """(rid, dim, raw, ent, centre, cosine): ball members have a negative
    entity and their ball's centre; other vectors are entities of their own."""
    half = math.cos(math.acos(threshold) / 2) + EPS
    none = F.lit(None).cast("binary")
    digest = F.struct(F.xxhash64("dim", "raw").alias("p"), F.xxhash64(F.lit(1), "raw").alias("q"))
    rows = base.where("raw is not null").withColumn("h", digest)
    same = stored(rows.groupBy("h").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("weight"), F.any_value("dim").alias("dim"),
                                        F.any_value("raw").alias("raw")), "distinct-vectors")
    one = _gather(same.select(F.col("first").alias("rid"), "dim", "raw", "weight", none.alias("total")), dtype, 0, LEAD_COS)
    runs = one.where("kind = 1 and weight > 1")
    # runs of one group may lie in several places: gather their centroids once more
    two = _gather(runs.select("rid", "dim", F.col("total").alias("raw"), "weight", "total"), "<f8", 1, MERGE_COS)
    balls = two.where("kind = 1").select(F.col("rid").alias("ball"), F.col("total").alias("centre"))
    to = two.where("kind = 0").select(F.col("rid").alias("lead"), F.col("lead").alias("ball")).join(balls, "ball")
    of = one.where("kind = 0").select(F.col("rid").alias("first"), "lead").join(to, "lead").select("first", "ball", "centre")

    def run(batches):
        for df in batches:
            ent, cosine, centre = df["rid"].to_numpy().copy(), np.ones(len(df)), np.full(len(df), None, object)
            rid, copied = df["rid"].to_numpy(), (df["weight"] > 1).to_numpy()
            for d in np.unique(df["dim"]):
                at = np.flatnonzero(df["dim"] == d)
                u = _unit(df["raw"].iloc[at].tolist(), dtype)
                near, has = np.zeros(len(at)), df["ball"].iloc[at].notna().to_numpy()
                if has.any():
                    near[has] = (u[has] * _unit(df["centre"].iloc[at[has]].tolist(), "<f8")).sum(1)
                tight = has & (near >= half)
                ent[at[tight]] = -2 * df["ball"].iloc[at[tight]].to_numpy(dtype=np.int64) - 1
                cosine[at[tight]] = near[tight]
                centre[at[tight]] = df["centre"].iloc[at[tight]].to_numpy(dtype=object)
                own = copied[at] & ~tight  # copies of a vector that is in no ball are one
                ent[at[own]] = -2 * rid[at[own]] - 2
                centre[at[own]] = [x.tobytes() for x in u[own]]
            yield pd.DataFrame({"rid": df["rid"], "dim": df["dim"], "raw": df["raw"], "ent": ent, "cosine": cosine, "centre": centre})

    # the distinct vectors with their balls; copies take the entity of the first
    folded = same.join(of, "first", "left").select(F.col("first").alias("rid"), "dim", "raw", "ball", "centre", "h", "weight")
    made = stored(folded.select("rid", "dim", "raw", "ball", "centre", "weight").mapInPandas(run, "rid long, dim int, raw binary, ent long, cosine double, centre binary"), "entities")
    copies = rows.select("rid", "h").join(same.where("weight > 1").select("h", "first"), "h").where("rid != first").select("rid", "first")
    more = copies.join(made.withColumnRenamed("rid", "first"), "first").select("rid", "dim", "raw", "ent", "cosine", "centre")
    return stored(made.union(more), "members-of")


def _window_pairs(ent: np.ndarray, sketch: np.ndarray, fresh: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entity pairs that may be linked, by their sketches, among rows at most
    WINDOW apart, the later of them at or after ``fresh``."""
    ball = (ent < 0).astype(int)
    a, b = [], []
    for o in range(1, min(WINDOW, len(ent) - 1) + 1):
        lo = max(0, fresh - o)
        i = np.arange(lo, len(ent) - o)
        if not len(i):
            continue
        differ = np.bitwise_count(sketch[i] ^ sketch[i + o]).sum(1)
        ok = (differ <= limits[ball[i] + ball[i + o]]) & (ent[i] != ent[i + o])
        a.append(ent[i[ok]])
        b.append(ent[i[ok] + o])
    a = np.concatenate(a) if a else np.empty(0, np.int64)
    b = np.concatenate(b) if b else np.empty(0, np.int64)
    return np.minimum(a, b), np.maximum(a, b)


def _thin(ent: np.ndarray, recent: list[int]) -> np.ndarray:
    """Positions to keep: one of each entity within the last WINDOW kept rows."""
    keep = []
    for i, e in enumerate(ent.tolist()):
        if e not in recent:
            keep.append(i)
            recent.append(e)
            if len(recent) > WINDOW:
                recent.pop(0)
    return np.array(keep, int)


def _words(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def window_links(ents: DataFrame, dtype: str, threshold: float, passes: int) -> DataFrame:
    """Distinct entity pairs (a, b) that meet in a window of some pass and, by
    their sketches, may hold linked members."""
    limits = _bit_limits(threshold)

    def key(batches):
        for df in batches:
            for d in np.unique(df["dim"]):
                part = df[df["dim"] == d]
                u = _unit(part["raw"].tolist(), dtype)
                mid, balls = u.copy(), np.flatnonzero(part["ent"] < 0)
                if len(balls):
                    mid[balls] = _unit(part["centre"].iloc[balls].tolist(), "<f8")
                bits = [x.tobytes() for x in _sketch(mid)]
                for p in range(passes):
                    yield (pd.DataFrame({"pass": p, "dim": d, "key": _keys(u, p), "ent": part["ent"].to_numpy(), "raw": bits})
                           .drop_duplicates(["key", "ent"]))

    def frame(kind, a=(), b=(), at=(), group=0, place=0, raw=None):
        n = len(a)
        return pd.DataFrame({"kind": kind, "a": a, "b": b if n else [], "edge": at if len(at) else [0] * n,
                             "place": place if n else [], "grp": [group] * n, "raw": raw if raw is not None else [None] * n})

    def run(batches):
        part, grp, ent, raw, u, recent, head = TaskContext.get().partitionId(), None, None, None, None, [], 0
        for df in batches:
            groups = df["pass"].to_numpy().astype(np.int64) * (1 << 32) + df["dim"].to_numpy()
            for g in dict.fromkeys(groups.tolist()):
                at = np.flatnonzero(groups == g)
                if g != grp:
                    if grp is not None:
                        yield edge(part, grp, ent, raw, 1)
                    grp, ent, raw, u, recent, head = g, np.empty(0, np.int64), [], None, [], 0
                e = df["ent"].to_numpy()[at]
                at = at[_thin(e, recent)]
                if not len(at):
                    continue
                new = df["raw"].iloc[at].tolist()
                e, v = df["ent"].to_numpy()[at], _words(new)
                if head < WINDOW:  # rows that the previous partition's last rows meet
                    k = min(WINDOW - head, len(e))
                    yield edge(part, grp, e[:k], new[:k], 0, head)
                    head += k
                fresh = len(ent)
                ent, raw = np.concatenate((ent, e)), raw + new
                u = v if u is None else np.concatenate((u, v))
                a, b = _window_pairs(ent, u, fresh, limits)
                pairs = pd.DataFrame({"a": a, "b": b}).drop_duplicates()
                yield frame(0, pairs["a"].to_numpy(), pairs["b"].to_numpy(), place=[0] * len(pairs))
                ent, raw, u = ent[-WINDOW:], raw[-WINDOW:], u[-WINDOW:]
        if grp is not None:
            yield edge(part, grp, ent, raw, 1)

    def edge(part, grp, ent, raw, last, start=0):
        """The first rows belong to the edge before this partition, the last to the edge after it."""
        n = len(ent)
        place = [start + i if not last else i - n for i in range(n)]
        return frame(1, ent, [0] * n, [part + last] * n, grp, place, raw)

    def across(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("place", kind="stable")
        ent, u = df["a"].to_numpy(), _words(df["raw"].tolist())
        a, b = _window_pairs(ent, u, int((df["place"] < 0).sum()), limits)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    keyed = ents.select("dim", "raw", "ent", "centre").mapInPandas(key, "pass int, dim int, key long, ent long, raw binary")
    out = stored(_sorted(keyed, "pass", "dim", "key").mapInPandas(run, "kind int, a long, b long, edge long, place long, grp long, raw binary"), "windows")
    edges = out.where("kind = 1").groupBy("grp", "edge").applyInPandas(across, "a long, b long")  # at most 2 * WINDOW rows each
    return out.where("kind = 0").select("a", "b").union(edges).distinct()


def _table(ents: DataFrame) -> DataFrame:
    """(ent, size, reach: least cosine to the centre, mid: centre or vector)"""
    return stored(ents.groupBy("ent").agg(F.count(F.lit(1)).alias("size"), F.min("cosine").alias("reach"),
                                          F.any_value(F.when(F.col("ent") < 0, F.col("centre")).otherwise(F.col("raw"))).alias("mid")), "entity-table")


def _decided(pairs: DataFrame, table: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """Pairs (a, b, full, na, nb), without those too far apart for any link.

    ``full``: all members of a are linked with all of b, by centre distance and radii."""
    limit = math.acos(threshold)

    def run(batches):
        for df in batches:
            full, near = [], []
            for a, b, ra, rb, x, y in zip(df["a"], df["b"], df["ra"], df["rb"], df["x"], df["y"], strict=True):
                p = _unit([x], "<f8" if a < 0 else dtype)[0]
                q = _unit([y], "<f8" if b < 0 else dtype)[0]
                if a >= 0 and b >= 0:  # two vectors
                    full.append(True)
                    near.append(float(p @ q) >= threshold)
                    continue
                d = math.acos(min(1.0, max(-1.0, float(p @ q))))
                radii = math.acos(min(1.0, ra)) + math.acos(min(1.0, rb))
                full.append(d + radii <= limit - EPS)
                near.append(d - radii <= limit + 1e-5)
            yield pd.DataFrame({"a": df["a"], "b": df["b"], "full": full, "na": df["na"], "nb": df["nb"]})[np.array(near, bool)]

    side = lambda e, n, r, m: table.select(F.col("ent").alias(e), F.col("size").alias(n), F.col("reach").alias(r), F.col("mid").alias(m))
    j = pairs.join(side("a", "na", "ra", "x"), "a").join(side("b", "nb", "rb", "y"), "b")
    return stored(j.mapInPandas(run, "a long, b long, full boolean, na long, nb long"), "decided")


def _by_member(unsure: DataFrame, ents: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """Exact links between the members of two entities, in blocks of at most
    about BLOCK members: kind 0, (rid, its links); kind 1, (a, b) linked."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    # the single vectors that a ball meets go together, so its members are not repeated for each
    many = unsure.where("b >= 0").groupBy("a").agg(F.count(F.lit(1)).alias("singles"))
    work = stored(unsure.join(many, "a", "left")
                  .select("a", "b", "na", F.when(F.col("b") < 0, F.col("b")).otherwise(F.pmod(F.xxhash64("b"), blocks("singles"))).alias("grp"),
                          F.when(F.col("b") < 0, F.col("nb")).otherwise(1).alias("ng")), "unsure")

    def side(pairs, e, own, other, s):
        m = pairs.join(ents.select(F.col("ent").alias(e), "rid", "raw"), e)
        return (m.withColumn("mine", F.pmod(F.xxhash64("rid"), blocks(own)))
                .withColumn("its", F.explode(F.sequence(F.lit(0).cast("long"), blocks(other) - 1)))
                .select("a", "grp", F.col("mine" if s == 0 else "its").alias("ba"), F.col("its" if s == 0 else "mine").alias("bb"),
                        F.lit(s).alias("side"), F.col(e).alias("ent"), "rid", "raw"))

    def unit(df: pd.DataFrame) -> pd.DataFrame:
        x, y = df[df["side"] == 0], df[df["side"] == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"kind": [], "a": [], "b": [], "n": []}).astype("int64")
        hit = _unit(x["raw"].tolist(), dtype) @ _unit(y["raw"].tolist(), dtype).T >= threshold
        rid = np.concatenate((x["rid"], y["rid"]))
        n = np.concatenate((hit.sum(1), hit.sum(0)))
        other = np.unique(y["ent"].to_numpy()[hit.any(0)])
        return pd.concat([pd.DataFrame({"kind": 0, "a": rid, "b": 0, "n": n})[n > 0],
                          pd.DataFrame({"kind": 1, "a": df["a"].iloc[0], "b": other, "n": 1})])

    both = (side(work.select("a", "grp", "na", "ng").distinct(), "a", "na", "ng", 0)
            .union(side(work.select("a", "b", "grp", "na", "ng"), "b", "ng", "na", 1)))
    return stored(both.groupBy("a", "grp", "ba", "bb").applyInPandas(unit, "kind int, a long, b long, n long"), "members")


def _crowded(sure: DataFrame, label: DataFrame, table: DataFrame, dtype: str, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """Components with a vector that has WINDOW links or more, their entities
    compared all with all: (kind 0, (vector, its linked vectors); kind 1, pairs
    with a ball that may hold links), and the entities."""
    ends = sure.where("a >= 0").select(F.explode(F.array("a", "b")).alias("ent")).groupBy("ent").count().where(F.col("count") >= WINDOW)
    of = label.select(F.col("node").alias("ent"), F.col("component").alias("grp"))
    groups = stored(ends.join(of, "ent", "left").select(F.coalesce("grp", "ent").alias("grp")).distinct(), "crowded")
    if groups.isEmpty():
        return None
    members = stored(table.join(of, "ent", "left").withColumn("grp", F.coalesce("grp", "ent")).join(groups, "grp")
                     .select("grp", "ent", "reach", "mid"), "crowd")
    size = members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("k"))
    dealt = (members.join(size, "grp").withColumn("mine", F.pmod(F.xxhash64("ent"), F.col("k")))
             .withColumn("its", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
             .select("grp", F.least("mine", "its").alias("lo"), F.greatest("mine", "its").alias("hi"), "mine", "ent", "reach", "mid"))
    limit = math.acos(threshold)

    def unit(df: pd.DataFrame) -> pd.DataFrame:
        same = df["lo"].iloc[0] == df["hi"].iloc[0]
        ent, ball = df["ent"].to_numpy(), (df["ent"] < 0).to_numpy()
        u = None
        for at, kind in ((np.flatnonzero(ball), "<f8"), (np.flatnonzero(~ball), dtype)):
            if len(at):
                v = _unit(df["mid"].iloc[at].tolist(), kind)
                u = np.empty((len(df), v.shape[1])) if u is None else u
                u[at] = v
        radius = np.where(ball, np.arccos(np.minimum(1.0, df["reach"].to_numpy())), 0.0)
        first = np.ones(len(df), bool) if same else (df["mine"] == df["lo"]).to_numpy()
        x, y = np.flatnonzero(first), np.arange(len(df)) if same else np.flatnonzero(~first)
        near = u[x] @ u[y].T
        hit = (near >= threshold) & ~ball[x][:, None] & ~ball[y] & (ent[x][:, None] != ent[y])
        n = np.zeros(len(df), np.int64)
        n[x] += hit.sum(1)
        if not same:
            n[y] += hit.sum(0)
        i, j = np.nonzero((ball[x][:, None] | ball[y]) & (ent[x][:, None] != ent[y]))
        ok = np.arccos(np.clip(near[i, j], -1, 1)) <= limit + radius[x][i] + radius[y][j] + 1e-5
        p, q = ent[x][i[ok]], ent[y][j[ok]]
        return pd.concat([pd.DataFrame({"kind": 0, "a": ent, "b": 0, "n": n})[n > 0],
                          pd.DataFrame({"kind": 1, "a": np.minimum(p, q), "b": np.maximum(p, q), "n": 0}).drop_duplicates()])

    return stored(dealt.groupBy("grp", "lo", "hi").applyInPandas(unit, "kind int, a long, b long, n long"), "crowd-links"), members


@releasing
def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links
    (other vectors linked directly), component_id (smallest vec_id reachable)
    and kept (vec_id is component_id).

    Null or zero vectors and vectors with null or non-finite components link
    with nothing, nor do vectors of different lengths with each other.
    Repeated rows are vectors of their own.  An empty table gives no rows.
    Other columns are not read.  ``passes`` follows from the number of rows
    if not given."""
    base, dtype = prepare(vectors)
    ents = entities(base, dtype, threshold)
    passes = passes or passes_for(base.where("raw is not null").count(), threshold)
    table = _table(ents)
    pairs = _decided(window_links(ents, dtype, threshold, passes), table, dtype, threshold)
    exact = _by_member(pairs.where("not full"), ents, dtype, threshold)
    sure = pairs.where("full")
    label = components(sure.select("a", "b").union(exact.where("kind = 1").select("a", "b")).distinct())
    each = lambda t: t.select(F.col("a").alias("ent"), F.col("nb").alias("n")).union(t.select(F.col("b").alias("ent"), F.col("na").alias("n")))
    counts = each(sure)
    if crowd := _crowded(sure, label, table, dtype, threshold):
        counted, members = crowd
        new = counted.where("kind = 1").select("a", "b").distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
        late = _decided(new, table, dtype, threshold)
        exact = exact.union(_by_member(late.where("not full"), ents, dtype, threshold))
        # the vectors' links with one another were counted anew
        counts = (each(sure.where("a < 0")).union(each(sure.where("a >= 0").join(members.select(F.col("ent").alias("a")), "a", "left_anti").select(*sure.columns)))
                  .union(each(late.where("full"))).union(counted.where("kind = 0").select(F.col("a").alias("ent"), "n")))
    more = counts.groupBy("ent").agg(F.sum("n").alias("more"))
    table = (table.select("ent", "size").join(more, "ent", "left").join(label.withColumnRenamed("node", "ent"), "ent", "left")
             .select("ent", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("ent_links"), F.coalesce("component", "ent").alias("label")))
    own = exact.where("kind = 0").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("own"))
    rows = stored(base.select("rid", "vec_id").join(ents.select("rid", "ent"), "rid", "left").join(table, "ent", "left")
                  .join(own, "rid", "left")
                  .select("vec_id", "label", (F.coalesce("ent_links", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n_links")), "rows")
    low = rows.where("label is not null").groupBy("label").agg(F.min("vec_id").alias("low"))
    return (rows.join(low, "label", "left")
            .select("vec_id", "n_links", F.when(F.col("label").isNull(), F.col("vec_id")).otherwise(F.col("low")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
