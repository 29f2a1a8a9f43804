"""op13: hard negatives against a plain search of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("llm")

from llm import hard_negatives as hn  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, id long, q string, digest long, dim int, score int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "q", 2, 3, 4) for r in rows], SCHEMA).repartition(3)


def brute(rows, k=5, m=10):
    ok = {(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab in rows
          if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in ok:
        if a[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1], r) for r in ok if r != a and len(r[2]) == len(a[2]))
        for s, i, lab, _ in [x for x in scored if x[2] == a[1]][:k]:
            fit = [x for x in scored if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
            out += [(a[0], i, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def rows_of(rng, n, dims=(8,), spread=0.3):
    centre = {(lab, d): [rng.gauss(0, 1) for _ in range(d)] for lab in range(4) for d in dims}
    out = []
    for i in range(n):
        d, lab = rng.choice(dims), rng.randrange(4)
        out.append((i, [x + rng.gauss(0, spread) for x in centre[lab, d]], lab))
    return out


def mined(spark, rows, **kw):
    got = hn.mine(table(spark, rows), F.col("id") % 100 == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_equals_plain_search(spark):
    rng = random.Random(1)
    rows = rows_of(rng, 900, dims=(8, 5), spread=1.0)
    rows += [(100 * k + 7, None, 1) for k in range(3)] + [(2001, [1.0] * 8, None), (2002, [float("nan")] * 8, 1), (2003, [None] * 8, 2),
                                                          (2100, [float("inf")] + [0.0] * 7, 3), (None, [1.0] * 8, 1), (2200, [], 1), (2201, [], 2)]
    rows += rows[:20] * 3  # repeated rows count once
    rows += [(3000 + i, rows[0][1], 1) for i in range(30)]  # ties
    rows += [(3100, [0.0] * 8, 1), (3101, [-x for x in rows[0][1]], rows[0][2])]  # zero scores, negative scores
    want = brute(rows)
    assert len(want) > 200
    assert mined(spark, rows) == want
    assert mined(spark, rows, shard_anchors=3) == want  # several shards


def test_empty_and_few(spark):
    assert mined(spark, []) == [] == mined(spark, [(100, [1.0, 2.0], 1)])
    assert mined(spark, [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2)]) == [(100, 1, 1, 2, 65536, 32768)]


def test_bounds_hold_and_prune():
    """Every skipped row is outside the window; near anchors skip most rows."""
    rng = np.random.default_rng(2)
    base = rng.normal(0, 60, (4, 16))
    anchors = np.floor(np.repeat(base, 25, 0) + rng.normal(0, 3, (100, 16)))
    s = hn.Shard(np.arange(100), np.zeros(100), anchors)
    assert (s.parent[1:] < np.arange(1, 100)).all() and s.parent[0] == -1
    rows = np.floor(rng.normal(0, 60, (2000, 16)))
    norms, allowed, scored = np.sqrt((rows * rows).sum(1)), np.ones(2000, bool), 0
    full = rows @ anchors.T
    seen = set()
    for a, at, score in hn.walk(s, rows, norms, lambda a: (allowed, 30000.0, 60000.0)):
        assert (np.sort(at) == np.flatnonzero((full[:, a] >= 30000) & (full[:, a] <= 60000))).all()
        assert (score == full[at, a]).all()
        seen.add(a)
        scored += len(at)
    for a in set(range(100)) - seen:
        assert not ((full[:, a] >= 30000) & (full[:, a] <= 60000)).any()


def test_large_components_are_exact(spark):
    big = [(100, [3e6, 1.0], 1), (1, [3e6, 1.0], 1), (2, [1.5e6, 1.0], 2), (3, [1.5e6, 2.0], 2)]
    assert mined(spark, big) == brute(big) != []


def test_depth_of_tree_is_bounded(monkeypatch):
    monkeypatch.setattr(hn, "DEPTH", 5)
    line = np.arange(200, dtype=float).reshape(-1, 1)
    parent, edge = hn.spanning_tree(line)
    depth = [0] * 200
    for i in range(1, 200):
        depth[i] = depth[parent[i]] + 1
    assert max(depth) < 5 and (edge[1:] == np.abs(line[1:, 0] - line[parent[1:], 0])).all()
