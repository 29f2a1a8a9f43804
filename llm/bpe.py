"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut at the added tokens, then into words by the published pattern
of byte-level BPE.  A word's bytes are its first tokens.  The leaves of a
segment tree are the adjacent pairs, each with (rank of its merge, place), or
infinity when the pair has no merge; an inner node is the least of its two
children, so the root is the leftmost pair of lowest rank.  It is merged, the
pairs on both sides get their new ranks and the pair that vanished gets
infinity, each by one walk to the root, until the root is infinite.  A word of
n bytes thus takes O(n log n) steps, however long it is.

The distinct words of a batch that were not met before are merged side by
side: one tree a row of a matrix, one merge in every row at a time.  Long
words have a tree of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import fresh, small_batches

# FIXED VALUES: word pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 62
#: Words of up to LONGEST bytes are merged side by side, up to ROWS at a time.
LONGEST, ROWS = 65, 1 << 14
CACHE_WORDS, CACHE_BYTES = 300_000, 32
#: Texts are taken in blocks of about so many characters.
BLOCK_CHARS = 4 << 20


def default_vocab() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files:
    visible Latin-1 characters for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """Token strings with ids, merges in order, and added tokens of a JSON
    tokenizer file; other kinds than plain byte-level BPE are an error."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, pre = d["model"], d.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if d.get("normalizer") or not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("not a plain byte-level BPE file")
    added = d.get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take their surroundings are not supported")
    return {"vocab": model["vocab"], "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
            "added": {t["content"]: t["id"] for t in added if t["content"]}}


class PairTree:
    """Minimum over (rank, place) of adjacent pairs."""

    def __init__(self, keys: Sequence[int]):
        self.size = size = 1 << max(0, (len(keys) - 1).bit_length())
        self.tree = tree = [NONE] * size + list(keys) + [NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def least(self) -> int:
        return self.tree[1]

    def put(self, place: int, key: int) -> None:
        tree, i = self.tree, self.size + place
        tree[i] = key
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low


class Bpe:
    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], added: dict[str, int]):
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        as_bytes = lambda t: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode("utf-8")
        self.piece = {i: as_bytes(t) for t, i in [*vocab.items(), *added.items()]}
        self.added = added
        longest = sorted(added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if added else None
        self.words = regex.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}
        pairs = np.array([a << 32 | b for a, b in self.rank] or [-1], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], np.array(list(self.rank.values()) or [0], np.int64)[order]
        self.first_ids, self.merged_ids = np.array(self.first, np.int64), np.array(self.merged or [0], np.int64)

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one word."""
        token = [self.first[b] for b in data]
        n, rank, merged = len(token), self.rank.get, self.merged
        if n < 2:
            return token
        key = lambda i, j: NONE if (r := rank((token[i], token[j]))) is None else r << 32 | i
        pairs = PairTree([key(i, i + 1) for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := pairs.least()) != NONE:
            i = low & 0xFFFFFFFF
            gone = after[i]
            token[i], token[gone] = merged[low >> 32], -1
            j = after[i] = after[gone]
            if j < n:
                before[j] = i
                pairs.put(gone, NONE)
            pairs.put(i, key(i, j) if j < n else NONE)
            if before[i] >= 0:
                pairs.put(before[i], key(before[i], i))
        return [t for t in token if t >= 0]

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(rank, place) of each pair of ids as one number, NONE without a merge."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.pair_rank[at] << 32 | place, NONE)

    def _side_by_side(self, words: list[bytes], size: int) -> list[bytes]:
        """Packed ids of words of 2 to ``size`` + 1 bytes; ``size`` is a power of two."""
        n = np.array([len(w) for w in words])
        rows, width = len(words), size + 1
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(rows, width)
        token = self.first_ids[raw]
        token[np.arange(width) >= n[:, None]] = -1
        tree = np.full((rows, 2 * size), NONE, np.int64)
        place = np.broadcast_to(np.arange(size), (rows, size))
        tree[:, size:] = np.where(place < (n - 1)[:, None], self._keys(token[:, :-1], token[:, 1:], place), NONE)
        s = size
        while s > 1:
            tree[:, s // 2:s] = np.minimum(tree[:, s:2 * s:2], tree[:, s + 1:2 * s:2])
            s //= 2
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        before = np.tile(np.arange(-1, width), (rows, 1))
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            low = tree[live, 1]
            i = low & 0xFFFFFFFF
            gone = after[live, i]
            made = self.merged_ids[low >> 32]
            token[live, i], token[live, gone] = made, -1
            j = after[live, gone]
            after[live, i], before[live, j] = j, i
            more = j < n[live]
            leaf = np.full((3, len(live)), 2 * size - 1)  # places whose way to the root is renewed
            key = self._keys(made, token[live, np.minimum(j, size)], i)
            tree[live, size + i] = np.where(more, key, NONE)
            leaf[0] = size + i
            at = live[more]
            tree[at, size + gone[more]] = NONE
            leaf[1, more] = size + gone[more]
            p = before[live, i]
            has = p >= 0
            at = live[has]
            tree[at, size + p[has]] = self._keys(token[at, p[has]], made[has], p[has])
            leaf[2, has] = size + p[has]
            s = size
            while s > 1:
                leaf >>= 1
                for x in leaf:
                    tree[live, x] = np.minimum(tree[live, 2 * x], tree[live, 2 * x + 1])
                s //= 2
            live = live[tree[live, 1] != NONE]
        keep = token >= 0
        packed = token[keep].astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum(keep.sum(1) * 4))).tolist()
        return [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def learn(self, words: set[str]) -> None:
        """Put words into the cache; it is emptied first when it would overflow."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {}
            new = list(words)
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            data = w.encode("utf-8", "surrogatepass")
            size = 0 if len(data) < 2 or len(data) > LONGEST else 1 << max(0, (len(data) - 2).bit_length())
            sizes.setdefault(size, []).append((w, data))
        for w, data in sizes.pop(0, []):
            self.cache[w] = np.array(self.merge(data), "<u4").tobytes()
        for size, some in sizes.items():
            for at in range(0, len(some), ROWS):
                part = some[at:at + ROWS]
                self.cache.update(zip((w for w, _ in part), self._side_by_side([d for _, d in part], size), strict=True))

    def encode_many(self, texts: Sequence[str | None]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit integers) of each text."""
        out, block, held = [], [], 0
        for t in texts:
            block.append([self.words(part) if i % 2 == 0 else part for i, part in enumerate(self.cut.split(t) if self.cut else (t,))] if t else [])
            held += len(t or "")
            if held > BLOCK_CHARS:
                out += self._packed(block)
                block, held = [], 0
        return out + self._packed(block)

    def _packed(self, block: list[list]) -> list[bytes]:
        """``block`` has a list for each text: words in even places, an added token in odd ones."""
        self.learn({w for parts in block for words in parts[::2] for w in words})
        get = self.cache.__getitem__
        out = [b"".join(b"".join(map(get, x)) if i % 2 == 0 else self.added[x].to_bytes(4, "little") for i, x in enumerate(parts)) for parts in block]
        for w in [w for w in self.cache if len(w) > CACHE_BYTES]:
            del self.cache[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; unknown ids give nothing, broken UTF-8 gives U+FFFD."""
        get = self.piece.get
        return b"".join([get(i, b"") for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


class _Shared:
    """The vocabulary broadcast once; each worker process builds its tables
    once and keeps its word cache."""
    _built: dict[str, Bpe] = {}

    def __init__(self, docs: DataFrame, path: str | None):
        self.path = path or default_vocab()
        self.data = docs.sparkSession.sparkContext.broadcast(load(self.path))

    def get(self) -> Bpe:
        if self.path not in self._built:
            self._built[self.path] = Bpe(**self.data.value)
        return self._built[self.path]


def encode(docs: DataFrame, vocab_path: str | None = None, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the whole text in ``out``, packed as
    little-endian unsigned 32-bit integers (see ``unpacked``).

    Null and empty texts give no ids (empty, not null).  Words of any length
    are merged exactly.  The strings of added tokens in a text are those
    tokens.  Repeated rows are encoded each; all other columns stay, and an
    own column named ``out`` is an error.  An empty table gives no rows.  The
    vocabulary (its size is that of the file) is read on the driver and broadcast.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} exists already")
    small_batches(docs.sparkSession)
    shared = _Shared(docs, vocab_path)

    @F.pandas_udf("binary")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = shared.get()
        for s in texts:
            yield pd.Series(bpe.encode_many(s), dtype=object)

    return docs.withColumn(out, ids(F.col(text_col)))


def decode(docs: DataFrame, vocab_path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the packed ids in ``out`` (empty for null and
    for no ids), special tokens written out; other columns stay."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} exists already")
    shared = _Shared(docs, vocab_path)

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = shared.get()
        for s in ids:
            yield pd.Series([bpe.decode(i) if i else "" for i in s], dtype=object)

    return docs.withColumn(out, text(F.col(ids_col)))


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of longs."""
    digits = F.hex(ids)
    pair = lambda i, b: F.substring(digits, i * 8 + 2 * b + 1, F.lit(2))
    one = lambda i: F.conv(F.concat(pair(i, 3), pair(i, 2), pair(i, 1), pair(i, 0)), 16, 10).cast("long")
    return F.when(n_tokens(ids) > 0, F.transform(F.sequence(F.lit(0), n_tokens(ids).cast("int") - 1), one)).otherwise(
        F.array().cast("array<long>"))


def round_trip(docs: DataFrame, vocab_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids`` and ``decoded`` (underscores go
    before a name that is taken)."""
    ids, decoded = fresh(docs, "ids", "decoded")
    return decode(encode(docs, vocab_path, text_col, ids), vocab_path, ids, decoded).drop(text_col)
