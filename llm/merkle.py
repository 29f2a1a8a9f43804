"""Merkle manifest of a data set by sibling-shift self-joins.

Every row is a leaf: the hash of its columns, each as its UTF-8 byte count, a
colon and its value, or ``-`` for null.  The leaves of a group stand in order;
runs of ``arity`` consecutive nodes become their parent (the last run may be
shorter, even one node) until one node, the group's subroot, remains.  The
subroots in order of their groups give the root in the same way.

A level is one stored table with a row per node (tree, idx, n = nodes of the
tree on this level, d).  An equijoin of the level with itself on computed
indices finds each node's siblings: ``idx ^ 1`` in a binary tree, else the
slots one, two, ... places further round the run.  Rows in slot zero then
emit the parents, which are the next level.  Proofs go down the same levels:
a node's path is its own siblings followed by its parent's path, an equijoin
on (tree, idx / arity).  No step gathers a tree, a group or a path of all rows
in one task: levels halve, and every join key has at most ``arity`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import fresh, stored
from revlens.functions.ordered import running

COPIES = 1 << 16


def sha(*digests: Column) -> Column:
    """Digest (binary) of the concatenated digests as lower-case hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*digests))).cast("binary"), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field_text(c: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    t = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in columns]).cast("binary"), 256))


@dataclass
class Tree:
    """Levels from the leaves up; ``roots`` has (tree, n, height, d, idx)."""
    arity: int
    levels: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``lefts`` and ``rights``: the concatenated digests of the
    nodes before and behind each one in its run."""
    slot, base = F.col("idx") % arity, F.col("idx") - F.col("idx") % arity
    out = nodes
    for o in range(1, arity):
        at = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else base + (slot + o) % arity
        other = nodes.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("d").alias(f"_s{o}"))
        out = out.withColumn("_at", at).join(other, (F.col("tree") == F.col("_t")) & (F.col("_at") == F.col("_i")), "left")
        out = out.drop("_t", "_i", "_at")
    none = F.lit(b"")
    # the node in slot p stands (p - slot) places round the run
    place = [F.coalesce(*[F.when((slot + o) % arity == p, F.col(f"_s{o}")) for o in range(1, arity)], none) for p in range(arity)]
    lefts = F.concat(*[F.when(slot > p, place[p]).otherwise(none) for p in range(arity)])
    rights = F.concat(*[F.when(slot < p, place[p]).otherwise(none) for p in range(arity)])
    return out.withColumns({"lefts": lefts, "rights": rights}).drop(*[f"_s{o}" for o in range(1, arity)])


def build(leaves: DataFrame, arity: int = 2) -> Tree:
    """All levels over ``leaves`` (tree long, idx long from 0 without gaps, n
    long = leaves of the tree, d binary, other columns stay on the first level)."""
    if not 2 <= arity <= 256:
        raise ValueError("arity must be 2 to 256")
    tree = Tree(arity)
    done, nodes, height = [], leaves, 0
    while True:
        level = stored(_siblings(nodes.where("n > 1"), arity), "merkle-level")
        done.append(nodes.where("n = 1").select("tree", F.lit(height).alias("height"), "d"))
        if level.isEmpty():
            break
        tree.levels.append(level)
        height += 1
        nodes = level.where(F.col("idx") % arity == 0).select(
            "tree", F.floor(F.col("idx") / arity).cast("long").alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n"),
            sha("d", "rights").alias("d"))
    roots = done[0]
    for d in done[1:]:
        roots = roots.union(d)
    tree.roots = stored(roots, "merkle-roots")
    return tree


def paths(tree: Tree, tops: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Rows of the first level (tree, idx, d, own columns) and of trees of one
    leaf, with ``path`` and the ``carry`` columns of their tree.

    ``tops`` has (tree, height, path, *carry): for each tree the path above its
    root, an array of (l, r), from the bottom up."""
    cols = ["tree", "idx", "path", *carry]
    above = None
    for height in range(len(tree.levels), -1, -1):
        here = tops.where(F.col("height") == height).withColumn("idx", F.lit(0).cast("long")).select(*cols)
        above = here if above is None else above.union(here)
        if height == 0:
            return above
        level = tree.levels[height - 1]
        own = [c for c in level.columns if c not in ("lefts", "rights", "n", "d")] if height > 1 else \
            [c for c in level.columns if c not in ("lefts", "rights", "n")]
        up = above.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("path").alias("_up"), *carry)
        pair = F.struct(F.col("lefts").alias("l"), F.col("rights").alias("r"))
        down = level.join(up, (F.col("tree") == F.col("_t")) & (F.floor(F.col("idx") / tree.arity).cast("long") == F.col("_i")))
        down = down.withColumn("path", F.concat(F.array(pair), F.col("_up")))
        if height == 1:
            return down.select(*own, "path", *carry)
        above = down.select(*cols)
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its path give."""
    return F.aggregate(path, leaf, lambda acc, p: sha(p["l"], acc, p["r"]))


def proof(path: Column) -> Column:
    """All siblings of the path in order, concatenated."""
    return F.aggregate(path, F.lit(b""), lambda acc, p: F.concat(acc, p["l"], p["r"]))


def _placed(leaves: DataFrame) -> DataFrame:
    """(group, key, leaf, other) -> tree, idx, n: place among the leaves of the
    group by key, then leaf hash; equal rows (all of which have one leaf) are
    counted first and spread over tasks again."""
    rows = stored(leaves.groupBy(*leaves.columns).agg(F.count(F.lit(1)).alias("_c")), "leaves")
    groups = running(rows.groupBy("group").agg(F.sum("_c").alias("n")), ["group"], {"tree": F.lit(1)})
    out = running(rows, ["key", "d", "tampered"], {"idx": F.col("_c")}, by=["group"], group_info=stored(groups, "groups"))
    once, more = out.where("_c = 1").drop("_c"), out.where("_c > 1")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1, F.lit(COPIES).cast("long")))
    more = more.withColumn("_b", block).repartition("tree", "idx", "_b")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("_c") - F.col("_b")) - 1))
    more = more.withColumn("_k", copy).withColumn("idx", F.col("idx") + F.col("_b") + F.col("_k")).select(*once.columns)
    return once.union(more)


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
             key: str = "doc_id", arity: int = 2, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: the key, ``leaf``, ``subroot``, ``root`` and
    ``proof_sha256`` as hex text; ``folded`` (the root that the leaf gives with
    its siblings, after the columns in ``changed`` took their new values where
    ``when`` holds) and ``verified`` (folded equals the root).

    Groups stand by value, null first, strings by UTF-8 bytes; leaves by key
    (null first), then hash, so the order of the input does not matter.
    Repeated rows are leaves each.  Null values are ``-``, empty texts ``0:``.
    Texts of any length are hashed whole and never shuffled; other columns are
    not read, whatever their names.  A single row's leaf is its subroot and its
    root.  An empty table gives no rows.
    """
    new = {c: (changed or {}).get(c, docs[c]) for c in columns}
    hit = F.coalesce(when, F.lit(False)) if when is not None else F.lit(False)
    leaves = docs.select(docs[group].alias("group"), docs[key].alias("key"), leaf_hash(*[docs[c] for c in columns]).alias("d"),
                         F.when(hit, leaf_hash(*new.values())).alias("tampered"))
    leaves = stored(_placed(leaves).drop("group"), "merkle-leaves")
    low = build(leaves, arity)
    count = low.roots.count()
    top = build(low.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"),
                                 "d", F.col("height").alias("below")), arity)
    one = F.broadcast(top.roots.select(F.col("d").alias("root")))  # one row
    none = F.array().cast("array<struct<l:binary,r:binary>>")
    start = top.roots.select("tree", "height", none.alias("path"))
    upper = paths(top, start, [])
    if top.levels:
        upper = upper.select(F.col("idx").alias("tree"), F.col("below").alias("height"), "path", F.col("d").alias("subroot"))
    else:  # one group, or none
        upper = low.roots.select("tree", "height", none.alias("path"), F.col("d").alias("subroot"))
    upper = stored(upper, "merkle-upper")
    full = paths(low, upper, ["subroot"])
    if low.levels:
        lone = leaves.where("n = 1").select("tree", "key", "d", "tampered").join(upper.select("tree", "path", "subroot"), "tree")
        want = ["key", "d", "tampered", "path", "subroot"]
        full = full.select(*want).union(lone.select(*want))
    else:
        full = leaves.join(upper.select("tree", "path", "subroot"), "tree")
    full = full.crossJoin(one)
    (key_out,) = fresh(full, "key_out")
    full = full.withColumn("folded", fold(F.coalesce("tampered", "d"), F.col("path"))).withColumnRenamed("key", key_out)
    return full.select(F.col(key_out).alias(key), as_hex(F.col("d")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"),
                       as_hex(F.col("root")).alias("root"), as_hex(sha(proof(F.col("path")))).alias("proof_sha256"),
                       as_hex(F.col("folded")).alias("folded"), (F.col("folded") == F.col("root")).alias("verified"))


def tampering(docs: DataFrame) -> tuple[dict[str, Column], Column]:
    """The planted change of ``op12``: one more character where 7 divides the
    CRC-32 of the decimal doc_id."""
    return {"n_chars": docs["n_chars"] + 1}, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0


def _sql_field(c: str) -> str:
    return f"coalesce(cast(octet_length(encode(cast({c} AS VARCHAR))) AS VARCHAR) || ':' || cast({c} AS VARCHAR), '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_SQL_UP = ("SELECT tree, l + 1, list_transform(range(0, (len(nodes) + 1) // 2), "
           "lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM {t} WHERE len(nodes) > 1")

#: DuckDB SQL of ``op12_merkle_manifest``; the CRC table follows from its polynomial.
MANIFEST_SQL = f"""
WITH RECURSIVE
crc AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
          lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
        FROM (SELECT unnest(range(0, 256)) AS i)),
d AS MATERIALIZED (SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, {_sql_leaf("(n_chars + 1)")} AS other,
        xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda x: cast(ascii(x) AS BIGINT))),
          lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 0 AS hit
      FROM documents, crc),
p AS MATERIALIZED (SELECT doc_id, leaf, CASE WHEN hit THEN other ELSE leaf END AS used,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i FROM d),
low(tree, l, nodes) AS (SELECT tree, 0, list(leaf ORDER BY i) FROM p GROUP BY tree UNION ALL {_SQL_UP.format(t="low")}),
sub AS MATERIALIZED (SELECT tree, nodes[1] AS d FROM low WHERE len(nodes) = 1),
top(tree, l, nodes) AS (SELECT 0, 1000, list(d ORDER BY tree) FROM sub HAVING count(*) > 0 UNION ALL {_SQL_UP.format(t="top")}),
n AS MATERIALIZED (SELECT tree, l, len(nodes) AS size, unnest(range(0, len(nodes))) AS i, unnest(nodes) AS d FROM low
      UNION ALL SELECT NULL, l, len(nodes), unnest(range(0, len(nodes))), unnest(nodes) FROM top),
s AS MATERIALIZED (
  SELECT p.doc_id, p.i, k.l, (p.i >> k.l) % 2 AS slot, coalesce(n.d, '') AS d
  FROM p JOIN (SELECT DISTINCT tree, l FROM low WHERE len(nodes) > 1) k ON p.tree = k.tree
  LEFT JOIN n ON n.tree = p.tree AND n.l = k.l AND n.i = xor(p.i >> k.l, 1)
  UNION ALL
  SELECT p.doc_id, p.i, k.l, (p.tree >> (k.l - 1000)) % 2, coalesce(n.d, '')
  FROM p CROSS JOIN (SELECT l FROM top WHERE len(nodes) > 1) k
  LEFT JOIN n ON n.tree IS NULL AND n.l = k.l AND n.i = xor(p.tree >> (k.l - 1000), 1)),
f AS (SELECT doc_id, i, string_agg(d, '' ORDER BY l) AS all_d, list({{'slot': slot, 'd': d}} ORDER BY l) AS steps FROM s GROUP BY doc_id, i),
r AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1),
o AS (SELECT p.doc_id, p.leaf, sub.d AS subroot, r.root, sha256(coalesce(f.all_d, '')) AS proof_sha256,
        list_reduce(list_concat([{{'slot': cast(0 AS BIGINT), 'd': p.used}}], coalesce(f.steps, [])),
          lambda a, b: {{'slot': cast(0 AS BIGINT), 'd': sha256(CASE WHEN b.slot = 0 THEN a.d || b.d ELSE b.d || a.d END)}}).d AS folded_root
      FROM p JOIN sub ON sub.tree = p.tree CROSS JOIN r LEFT JOIN f ON f.doc_id IS NOT DISTINCT FROM p.doc_id AND f.i = p.i)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM o
"""
