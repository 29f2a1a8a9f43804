"""op11: byte-level BPE against the tokenizers library and a plain merge loop."""

import array
import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("llm")
tokenizers = pytest.importorskip("tokenizers")

from llm import bpe  # noqa: E402
from llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
ALPHABET = "ab cde' \n\t<|endoftext|>é日本🙂1²'s're  ,.!\x85\xa0​\x00"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_vocab())


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(**bpe.load(bpe.default_vocab()))


def ids(own, text):
    return list(array.array("I", own.encode(text)))


def test_pair_tree_is_the_least_key():
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 8, 33):
        keys = [rng.randrange(99) for _ in range(n)]
        t = bpe.PairTree(keys)
        for _ in range(50):
            assert t.least() == min(keys)
            i = rng.randrange(n)
            keys[i] = rng.choice([bpe.NONE, rng.randrange(99)])
            t.put(i, keys[i])


def test_merges_are_leftmost_lowest_rank():
    """Every word over a small alphabet with overlapping merges, against a loop
    that looks for the least pair anew at each step."""
    letters = bpe.byte_letters()
    vocab = {letters[b]: b for b in range(256)}
    merges = [("a", "a"), ("aa", "b"), ("b", "a"), ("aa", "aa"), ("c", "aab")]
    for m in merges:
        vocab["".join(m)] = len(vocab)
    b = bpe.Bpe(vocab, merges, {})
    name = {i: t for t, i in vocab.items()}

    def plain(w):
        parts = list(w)
        while True:
            at = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
            if not at:
                return parts
            i = min(at)[1]
            parts[i:i + 2] = ["".join(parts[i:i + 2])]

    rng = random.Random(2)
    for _ in range(2000):
        w = "".join(rng.choice("aabc") for _ in range(rng.randint(1, 14)))
        assert [name[i] for i in b.merge(w.encode())] == plain(w)


def test_equals_library(library, own):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>", " <|endoftext|> x"]) for _ in range(3000)]
    texts += ["", "x" * 50_000, "".join(rng.choice("abcdefgh") for _ in range(50_000)), " " * 3000, "<|endoftext|>" * 3, "�\U0010ffff"]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        got = own.encode(t)
        assert e.ids == list(array.array("I", got)), t[:80]
        assert own.decode(got) == t == library.decode(e.ids, skip_special_tokens=False)


def test_decode_of_any_ids(library, own):
    rng = random.Random(4)
    for _ in range(500):
        some = [rng.randrange(50257) for _ in range(rng.randint(0, 8))]  # broken UTF-8 too
        assert own.decode(array.array("I", some).tobytes()) == library.decode(some, skip_special_tokens=False)


def test_query_equals_library(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_bpe_codec"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        want = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(array.array("I", want).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_edges(spark, own):
    texts = [None, "", "hi", "hi", "<|endoftext|>", "z" * 200_000]
    df = spark.createDataFrame([(i if i != 3 else 2, t, "own", b"own") for i, t in enumerate(texts)], "doc_id long, text string, decoded string, ids binary")
    out = bpe.round_trip(df)
    assert out.columns == ["doc_id", "decoded", "ids", "_ids", "_decoded"]  # own columns stay
    rows = out.collect()
    assert sorted(r["_decoded"] for r in rows) == sorted(t or "" for t in texts)
    assert all(r["decoded"] == "own" and r["ids"] == b"own" for r in rows)
    assert bpe.encode(df.drop("ids")).withColumn("a", bpe.unpacked(F.col("ids"))).where("text = 'hi'").first()["a"] == ids(own, "hi")
    assert bpe.round_trip(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df)
