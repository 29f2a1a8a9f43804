"""op12: Merkle manifests against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("llm")

from llm import merkle  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `group` string, d int, path string, subroot string, n long"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, plus=0):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    n = None if r["n_chars"] is None else r["n_chars"] + plus
    return sha("".join(field(n if c == "n_chars" else r[c]) for c in COLUMNS))


def levels(nodes, k):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + k])) for i in range(0, len(out[-1]), k)])
    return out


def path(lv, i, k):
    for nodes in lv[:-1]:
        at = i - i % k
        yield nodes[at:i], nodes[i + 1:at + k]
        i //= k


def brute(rows, k, hit):
    groups = sorted({r["lang"] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))
    of = [sorted((r for r in rows if r["lang"] == g), key=key) for g in groups]
    trees = [levels([leaf(r) for r in t], k) for t in of]
    top = levels([t[-1][0] for t in trees], k)
    out = []
    for g, t in enumerate(of):
        for i, r in enumerate(t):
            steps = [*path(trees[g], i, k), *path(top, g, k)]
            cur = leaf(r, int(hit(r)))
            for a, b in steps:
                cur = sha("".join(a) + cur + "".join(b))
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in steps)), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, "p", "s", 9) for r in rows], SCHEMA)


def rows_of(n, langs, rng, null=0.1):
    maybe = lambda v: None if rng.random() < null else v
    return [{"doc_id": maybe(rng.randint(0, n)), "text": maybe(rng.choice(["", "é", "ab" * rng.randint(0, 9), "z" * 200_000])),
             "lang": maybe(rng.choice(langs)), "source": maybe("s"), "n_chars": maybe(rng.randint(0, 9))} for _ in range(n)]


@pytest.mark.parametrize("arity,n,langs", [(2, 19, ["a", "b", "é", "Z", ""]), (3, 24, ["a", "b"])])
def test_manifest_equals_plain_tree(spark, arity, n, langs):
    rng = random.Random(arity)
    rows = rows_of(n, langs, rng)
    rows += rows[:3] + [rows[0]] * 4  # repeated rows are leaves each
    d = table(spark, rows)
    got = merkle.manifest(d, arity=arity, changed={"n_chars": F.col("n_chars") + 1}, when=F.col("doc_id") % 3 == 0)
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == brute(rows, arity, lambda r: r["doc_id"] is not None and r["doc_id"] % 3 == 0)


def test_manifest_one_row_one_group_and_empty(spark):
    rows = rows_of(1, ["a"], random.Random(1), null=0)
    r = merkle.manifest(table(spark, rows)).collect()[0]
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded"] == leaf(rows[0]) and r["verified"]
    assert r["proof_sha256"] == sha("")
    assert merkle.manifest(table(spark, rows).limit(0)).count() == 0


def test_changed_row_is_found_and_order_does_not_matter(spark):
    rows = rows_of(9, ["a", "b"], random.Random(5), null=0)
    root = {r["root"] for r in merkle.manifest(table(spark, rows)).collect()}
    assert root == {r["root"] for r in merkle.manifest(table(spark, rows[::-1]).repartition(5)).collect()} and len(root) == 1
    rows[7]["text"] += " "
    assert root != {r["root"] for r in merkle.manifest(table(spark, rows)).collect()}
