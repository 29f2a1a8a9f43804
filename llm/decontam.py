"""Benchmark decontamination: a BM25 inverted index of the test items,
searched with every training passage under block-max bounds.

Impacts are BM25 weights divided by the item's score for its own text, so
one threshold serves all items.  Postings are cut into blocks of ``BLOCK``
items, each with its largest impact per term.  For every passage the sums
of block maxima bound the score of any item in a block (very long lists
count with their list maximum, for all blocks at once); only blocks that can
reach the threshold are scored, and items that do are verified by the
overlap of their five-word shingles.  An item is found if a passage holds
OVERLAP of its shingles, or OVERLAP of those of its question (all but the last
sentence), whatever became of the answer (the last sentence).  A question of
under SHINGLE words says too little and counts only with its answer; nor is an
answer alone a finding.

An item of few distinct words (binary, digit or DNA strings, very long texts)
may lack so many shingles that no score follows; such loose items are found by
their shingles instead and stay out of the blocks.

Passages are two segments long and start at every segment; a segment holds
the longest item, so each copy of an item lies whole in some passage.  The
items go through in shards of a proven size, whose index is broadcast; the
documents are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches, stored

_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SENTENCE = re.compile(r"[.!?:\n]+")
K1, B = 1.2, 0.75
BLOCK = 4
LONG_LIST = 64
OVERLAP = 0.8
SHINGLE = 5
ITEMS_PER_SHARD = 20_000
CELLS = 1 << 22
ROUNDING = 1e-9
LEAST_FLOOR = 1e-6
MATCH = "item_id: long, score: double, overlap: double, question_overlap: double, answer_overlap: double"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words (UTF-8); all ASCII but letters and digits separates them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACE).split() if text else []


def _grams(ids, k: int = SHINGLE) -> set:
    k = min(k, len(ids))
    return set(zip(*(ids[i:] for i in range(k)), strict=False)) if k else set()


def _floor(shares: np.ndarray, grams: set) -> float:
    """Least score of a part that shares OVERLAP of its shingles: it lacks at
    most so many words as shingles, at worst its heaviest; 0 if that is all."""
    lost = int((1 - OVERLAP) * len(grams) + ROUNDING)
    return float(np.sort(shares)[:len(shares) - lost].sum()) if lost < len(shares) else 0.0


class Index:
    """Inverted index of (item_id, text) rows; items without words match nothing.
    ``whole`` has the figures of the whole benchmark where the rows are a shard
    of it: items, mean length and items per word."""

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, float, dict[bytes, int]] | None = None):
        items = sorted((i, t) for i, t in items if i is not None and words(t))
        toks = [words(t) for _, t in items]
        self.item_ids = [i for i, _ in items]
        self.terms: dict[bytes, int] = {}
        ids = [[self.terms.setdefault(w, len(self.terms)) for w in ws] for ws in toks]
        n, nt = len(items), len(self.terms)
        self.segment = max((len(x) for x in ids), default=1) + SHINGLE
        df = np.zeros(nt)
        for x in ids:
            df[list(set(x))] += 1
        total, mean = n, sum(map(len, ids)) / max(n, 1)
        if whole:
            total, mean = whole[:2]
            df = np.array([whole[2][w] for w in self.terms], float)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        self.grams, self.item_terms, self.impacts, self.shares = [], [], [], []
        self.least: list[int] = []  # shingles of the smallest part that decides
        self.loose: dict[tuple, list[int]] = {}  # shingle -> loose items that hold it
        self.loose_term = np.zeros(nt + 1, bool)  # unknown words mark the last place
        tight = np.ones(n, bool)
        for i, ((_, text), x) in enumerate(zip(items, ids, strict=True)):
            t, tf = np.unique(x, return_counts=True)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean))
            self.item_terms.append(t)
            share = w / w.sum()
            floor = _floor(share, _grams(x))
            last = [p for p in SENTENCE.split(text.rstrip(" .!?:\n\t")) if words(p)]
            cut = len(x) - len(words(last[-1])) if len(last) > 1 else len(x)
            self.grams.append((_grams(x), _grams(x[:cut]), _grams(x[cut:])))
            if SHINGLE <= cut < len(x):  # the question alone decides too
                floor = min(floor, _floor(share[np.isin(t, x[:cut])], self.grams[i][1]))
            tight[i] = floor > LEAST_FLOOR
            self.least.append(len(self.grams[i][1 if SHINGLE <= cut < len(x) else 0]))
            self.shares.append(share)
            self.impacts.append(share / floor if tight[i] else np.zeros(len(t)))
            if not tight[i]:  # it has SHINGLE words or more, so its shingles are that long
                self.loose_term[t] = True
                for g in self.grams[i][0]:
                    self.loose.setdefault(g, []).append(i)
        self.blocks = -(-n // BLOCK)
        if n:
            sizes = [len(x) for x in self.item_terms]
            used = np.repeat(tight, sizes)
            t = np.concatenate(self.item_terms)[used]
            b = np.repeat(np.arange(n) // BLOCK, sizes)[used]
            key, at = np.unique(t * self.blocks + b, return_inverse=True)
            top = np.zeros(len(key))
            np.maximum.at(top, at, np.concatenate(self.impacts)[used])
            t, b = key // self.blocks, key % self.blocks
            lists = np.bincount(t, minlength=nt)
            long = lists > LONG_LIST
            self.list_max = np.zeros(nt)  # of the long lists; 0 for the others
            np.maximum.at(self.list_max, t[long[t]], top[long[t]])
            short = ~long[t]
            self.post_block, self.post_max = b[short], top[short]
            self.post_len = np.where(long, 0, lists)
            self.post_at = np.concatenate(([0], np.cumsum(self.post_len)[:-1]))

    # -- search

    def candidates(self, ids: np.ndarray, seg: np.ndarray, follows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(passage, blocks that may reach the threshold): ``seg`` is each
        word's segment, ``follows[s]`` whether s + 1 is of the same text."""
        nseg = len(follows)
        pairs = np.unique(seg[ids >= 0] * np.int64(len(self.terms)) + ids[ids >= 0])  # a term counts once a segment
        s_all, t_all = pairs // len(self.terms), pairs % len(self.terms)
        step = max(1, CELLS // max(self.blocks, 1))
        for lo in range(0, nseg, step):
            hi = min(nseg, lo + step + 1)  # one more: the second half of the last passage
            i, j = np.searchsorted(s_all, [lo, hi])
            s, t = s_all[i:j] - lo, t_all[i:j]
            n = self.post_len[t]
            at = np.repeat(self.post_at[t] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            bound = np.bincount(np.repeat(s, n) * self.blocks + self.post_block[at], self.post_max[at],
                                (hi - lo) * self.blocks).reshape(hi - lo, self.blocks)
            bound += np.bincount(s, self.list_max[t], hi - lo)[:, None]
            both = bound.copy()
            both[:-1] += np.where(follows[lo:hi - 1, None], bound[1:], 0)
            rows, blocks = np.nonzero(both[:min(step, hi - lo)] >= 1 - ROUNDING)
            cuts = np.flatnonzero(np.diff(rows)) + 1
            for r, b in zip(np.split(rows, cuts), np.split(blocks, cuts), strict=True):
                if len(r):
                    yield lo + int(r[0]), b

    def search(self, texts) -> list[dict[int, tuple]]:
        """For each text: item -> (score, overlap, question overlap, answer overlap), verified."""
        out: list[dict[int, tuple]] = [{} for _ in texts]
        if not self.item_ids:
            return out
        get, parts, owner, seg_of, starts = self.terms.get, [], [], [], []
        nseg = 0
        for k, t in enumerate(texts):
            ids = [get(w, -1) for w in words(t)]
            if not ids:
                continue
            m = -(-len(ids) // self.segment)
            parts.append(np.array(ids, np.int64))
            seg_of.append(nseg + np.arange(len(ids)) // self.segment)
            owner += [k] * m
            starts += [(len(parts) - 1, i * self.segment) for i in range(m)]
            nseg += m
        if not parts:
            return out
        own = np.array(owner)
        follows = np.append(own[1:] == own[:-1], False)
        all_ids, all_segs = np.concatenate(parts), np.concatenate(seg_of)
        for p, blocks in self.candidates(all_ids, all_segs, follows):
            ids, row = self._passage(parts, starts[p]), out[owner[p]]
            have = np.zeros(len(self.terms) + 1, bool)
            have[ids] = True  # unknown words mark the last, unused place
            grams: dict[int, set] = {}
            for b in blocks:
                for i in range(b * BLOCK, min((b + 1) * BLOCK, len(self.item_ids))):
                    if self.impacts[i][have[self.item_terms[i]]].sum() >= 1 - ROUNDING:
                        self._verify(i, ids, have, grams, row)
        for p in self._loose_passages(all_ids, all_segs, follows) if self.loose else ():
            ids, row = self._passage(parts, starts[p]), out[owner[p]]
            have = np.zeros(len(self.terms) + 1, bool)
            have[ids] = True
            grams = {SHINGLE: _grams(ids.tolist())} if len(ids) >= SHINGLE else {SHINGLE: set()}
            shared = Counter(i for g in grams[SHINGLE] for i in self.loose.get(g, ()))
            for i, k in shared.items():
                if k >= OVERLAP * self.least[i] - ROUNDING:
                    self._verify(i, ids, have, grams, row)
        return out

    def _passage(self, parts: list[np.ndarray], start: tuple[int, int]) -> np.ndarray:
        return parts[start[0]][start[1]:start[1] + 2 * self.segment]

    def _loose_passages(self, ids: np.ndarray, seg: np.ndarray, follows: np.ndarray) -> list[int]:
        """Passages that hold SHINGLE words in a row that loose items have."""
        known = np.concatenate(([0], np.cumsum(self.loose_term[ids])))
        run = np.flatnonzero(known[SHINGLE:] - known[:-SHINGLE] == SHINGLE)
        hit = np.zeros(len(follows), bool)
        hit[seg[run]] = hit[seg[run + SHINGLE - 1]] = True
        hit[:-1] |= hit[1:] & follows[:-1]  # as the second half of the passage before
        return np.flatnonzero(hit).tolist()

    def _verify(self, i: int, ids: np.ndarray, have: np.ndarray, grams: dict, row: dict) -> None:
        """Enter item ``i`` into the text's ``row`` if the passage shares enough of its shingles."""
        whole, question, answer = self.grams[i]
        o, q = self._part(whole, ids, grams), self._part(question, ids, grams)
        if o >= OVERLAP or (q >= OVERLAP and self.least[i] < len(whole)):
            item = self.item_ids[i]
            new = (float(self.shares[i][have[self.item_terms[i]]].sum()), o, q, self._part(answer, ids, grams))
            if item not in row or row[item][1:] + row[item][:1] < new[1:] + new[:1]:
                row[item] = new

    @staticmethod
    def _part(want: set, ids: np.ndarray, grams: dict) -> float:
        if not want:
            return 1.0
        k = len(next(iter(want)))
        if k not in grams:
            grams[k] = _grams(ids.tolist(), k)
        return len(want & grams[k]) / len(want)


def _terms(items: DataFrame) -> DataFrame:
    """(word, length of the item): one row per item and different word; a
    benchmark's words are lower-cased and cut as in ``words``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(w, len(ws), i == 0) for ws in map(words, df["text"]) for i, w in enumerate(dict.fromkeys(ws))]
            yield pd.DataFrame(rows, columns=["word", "size", "first"])

    return items.select("text").mapInPandas(run, "word binary, size long, first boolean")


def shards(benchmark: DataFrame) -> Iterator[Index]:
    """One index for each shard of about ITEMS_PER_SHARD items.  Weights rest
    on the whole benchmark: its counts are a table, from which a shard takes
    those of its own words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    n = items.count()
    k = max(1, -(-n // ITEMS_PER_SHARD))
    if k == 1:
        yield Index([(r["item_id"], r["text"]) for r in items.collect()])  # one shard of stated size
        return
    terms = _terms(items)
    table = stored(terms.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "benchmark-terms")
    size = terms.where("first").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    for i in range(k):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i)
        df = _terms(part).select("word").distinct().join(table, "word").collect()  # the words of one shard
        yield Index([(r["item_id"], r["text"]) for r in part.collect()], (size["n"], size["mean"], {bytes(r["word"]): r["df"] for r in df}))


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "matches") -> DataFrame:
    """All rows and columns of ``docs`` plus ``out``: the verified items of
    the row's text, an array of structs by item.

    Null and empty texts match nothing, nor do items that are null or have
    no word; repeated rows are searched each; an empty table gives no rows,
    an empty benchmark empty arrays.  A column named like ``out`` is replaced."""
    small_batches(docs.sparkSession)
    rows = docs.drop(out).withColumn(out, F.array().cast(f"array<struct<{MATCH}>>"))
    for index in shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([[(i, *v) for i, v in sorted(x.items())] for x in shared.value.search(list(texts))], dtype=object)

        udf = F.pandas_udf(run, f"array<struct<{MATCH}>>")
        rows = rows.withColumn(out, F.concat(out, udf(F.col(text_col))))
    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and benchmark item found in it."""
    found = matches(docs.select("doc_id", "text"), benchmark).where("size(matches) > 0")
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    tmp = "_matches"
    while tmp in docs.columns:
        tmp = "_" + tmp
    return matches(docs, benchmark, out=tmp).where(F.size(tmp) == 0).drop(tmp)
