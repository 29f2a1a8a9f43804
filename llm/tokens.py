"""Token counts by a linear longest-match automaton.

The vocabulary (byte strings) is a trie; each node has a failure link and
the number of tokens popped when it is followed, so the length of a word's
greedy longest-match split is summed in one pass, never stepping back and
never building a piece.  Failure links of node ``v`` = child ``c`` of ``u``:
a token pops itself and fails to the root; any other node pops what ``u``
pops and goes on from the failure of ``u`` until a node with child ``c``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from llm.common import small_batches

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A word takes one leading space; runs of punctuation and of white space stand alone.
PRETOKEN = re.compile(r" ?\w+| ?[^\w\s]+|\s+")
CACHE_WORDS = 200_000


def load_vocab(path: str = DEFAULT_VOCAB) -> list[bytes]:
    """Token strings of a ranks file (base64 token, space, rank per line)."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    def __init__(self, vocab: Iterable[bytes]):
        child: dict[int, int] = {}
        depth_order: list[list[tuple[int, int, int]]] = []
        token = [False]
        for t in vocab:
            node = 0
            for i, b in enumerate(t):
                key = node << 8 | b
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(token)
                    token.append(False)
                    while len(depth_order) <= i:
                        depth_order.append([])
                    depth_order[i].append((node, b, nxt))
                node = nxt
            if t:
                token[node] = True
        fail, pops = [-1] * len(token), [0] * len(token)
        for level in depth_order:
            for u, c, v in level:
                if token[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                z, p = fail[u], pops[u]
                while z >= 0 and (z << 8 | c) not in child:
                    p += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = child[z << 8 | c], p
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: bytes) -> int:
        """Tokens of the greedy split; 1 (unknown) when it cannot be split."""
        child, fail, pops = self.child.get, self.fail, self.pops
        node = n = 0
        for b in word:
            nxt = child(node << 8 | b)
            while nxt is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = child(node << 8 | b)
            node = nxt
        while node > 0:
            n += pops[node]
            node = fail[node]
        return n if node == 0 else 1


class _Cache(dict):
    """Counts of words seen; emptied when full, so memory stays bounded."""

    def __init__(self, auto: Automaton):
        self.auto = auto

    def __missing__(self, word: str) -> int:
        n = self.auto.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocab_path: str = DEFAULT_VOCAB, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_pretokens, n_tokens (longs).

    Null and empty texts count 0; other columns (of any name) are not read;
    repeated rows are counted each.  An empty table gives no rows.  The
    automaton is built from the vocabulary file on the driver (its size is
    that of the file) and broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    auto = spark.sparkContext.broadcast(Automaton(load_vocab(vocab_path)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Cache(auto.value)
        get = cache.__getitem__
        for df in batches:
            pre, tok = [], []
            for t in df["text"]:
                words = PRETOKEN.findall(t) if t else ()
                pre.append(len(words))
                tok.append(sum(map(get, words)))
            yield pd.DataFrame({"id": df["id"], "n_pretokens": pre, "n_tokens": tok})

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return (src.mapInPandas(run, f"id {kind}, n_pretokens long, n_tokens long")
            .withColumnRenamed("id", id_col))
