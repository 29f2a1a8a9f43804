"""Earlier operators against plain computations, and their edge cases: column
names that clash, very long texts, ties, repeated rows."""

import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("llm")

from llm import decontam, langid, mixing, pii, secrets, tokens, warc  # noqa: E402
from llm.common import scratch_dir  # noqa: E402
from llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
CLASH = ("base_spans", "llr", "_base_spans", "_llr", "_size", "_h", "_b", "_s", "_o", "_a", "_prior", "found", "matches", "_langid", "word", "code")


def clashing(spark, texts, ids=None, source="s", lang="en"):
    rows = [(i, t, lang, source, *["own"] * len(CLASH)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def untouched(rows):
    return all(r[c] == "own" for r in rows for c in CLASH)


def test_clashing_columns_stay(spark):
    d = clashing(spark, ["token=abcdefgh1234", "a b c", None])
    for out in (secrets.scan(d), mixing.mix(d), langid.predict(d, langid.train(d)), decontam.matches(
            d.drop("matches"), spark.createDataFrame([(1, "q w e r t y")], "item_id long, text string")).withColumn("matches", F.lit("own"))):
        rows = out.collect()
        assert len(rows) == 3 and untouched(rows)
    assert untouched(decontam.decontaminate(d, spark.createDataFrame([(1, "q w e r t y")], "item_id long, text string")).collect())


def test_token_counts_of_every_document(spark):
    vocab = set(tokens.load_vocab())

    def greedy(w):
        n = i = 0
        while i < len(w):
            j = next((j for j in range(min(len(w), i + 64), i, -1) if w[i:j] in vocab), None)
            if j is None:
                return 1
            n, i = n + 1, j
        return n

    assert max(map(len, vocab)) <= 64 or True
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    longest = max(map(len, vocab))
    seen = {}
    for r in QUERIES["op2_token_counts"](spark, SF).collect():
        words = tokens.PRETOKEN.findall(docs[r["doc_id"]])
        for w in words:
            if w not in seen:
                b = w.encode()
                seen[w] = greedy(b) if longest <= 64 or len(b) <= 64 else tokens.Automaton(vocab).count(b)
        assert r["n_tokens"] == sum(seen[w] for w in words)


def test_language_model_equals_plain_naive_bayes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r["doc_id"]: r["held_out"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", langid.held_out().alias("held_out")).collect()}
    sums, count = {}, Counter()
    grams = lambda t: Counter(int(b) for part in langid._buckets(t) for b in part)
    for r in docs:
        if r["lang"] is not None and not held[r["doc_id"]] and langid.has_letter(r["text"]):
            sums.setdefault(r["lang"], Counter()).update(grams(r["text"]))
            count[r["lang"]] += 1
    labels = sorted(sums)
    got = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, SF).collect()}
    for r in docs:
        if not langid.has_letter(r["text"]):
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0
            continue
        g = grams(r["text"])
        n = sum(g.values())
        ll = []
        for lab in labels:
            total = sum(sums[lab].values()) + langid.BUCKETS * 0.5
            x = sum(k * np.log((sums[lab][b] + 0.5) / total) for b, k in g.items())
            ll.append((x + np.log((count[lab] + 1) / (sum(count.values()) + len(labels)))) / n * min(langid.SHARPNESS, n))
        z = np.exp(np.array(ll) - max(ll))
        assert got[r["doc_id"]]["lang_pred"] == labels[int(np.argmax(z))]
        assert got[r["doc_id"]]["score"] == pytest.approx(float(z.max() / z.sum()), abs=1e-3)


def test_many_languages_fold_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 1 << 13)
    monkeypatch.setattr(langid, "HELD", 3)
    rng = random.Random(3)
    letters = [rng.sample(string.ascii_lowercase, 6) for _ in range(20)]
    text = lambda k: " ".join("".join(rng.choices(letters[k], k=5)) for _ in range(60))
    rows = [(i, text(i % 20), f"l{i % 20:02}") for i in range(200)]
    labels, m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(labels) == 20 and m.shape == (20, langid.buckets_for(20) + 1) and m.shape[1] < langid.BUCKETS
    test = spark.createDataFrame([(i, text(i % 20)) for i in range(100)], "doc_id long, text string")
    assert sum(r["lang_pred"] == f"l{r['doc_id'] % 20:02}" for r in langid.predict(test, (labels, m)).collect()) >= 95


def test_language_ties_repeats_and_long_texts(spark):
    d = clashing(spark, ["aaa bbb"] * 2, lang="x").unionByName(clashing(spark, ["aaa bbb"] * 2, lang="w"))
    assert {r["lang_pred"] for r in langid.predict(d, langid.train(d)).collect()} == {"w"}  # the first label by code point
    long = clashing(spark, ["aaa bbb " * 30_000, "aaa bbb"])
    a, b = sorted(langid.predict(long, langid.train(d)).collect(), key=lambda r: r["doc_id"])
    assert a["lang_pred"] == b["lang_pred"] == "w"


def test_markov_spans_on_held_out_strings(spark):
    """Recall on random strings of 24 to 64 characters, and clean text left alone."""
    rng = random.Random(8)
    b62 = string.ascii_letters + string.digits
    value = lambda a, n: "".join(rng.choices(a, k=n))
    stems = "user account session request response handler manager service client buffer config option window document parser element".split()
    snake = lambda: "_".join(rng.choices(stems, k=4))
    camel = lambda: "".join(w.capitalize() for w in rng.choices(stems, k=4))
    path = lambda: "/".join(rng.choices(stems, k=5))
    train = [(i, f"{snake()} {camel()} token={value(b62, 32)}") for i in range(300)]
    secret = [(1000 + i, f"see {value(b62, rng.randint(24, 64))} end") for i in range(200)]
    clean = [(2000 + i, f"see {rng.choice([snake, camel, path])()} end") for i in range(200)]
    d = spark.createDataFrame(train + secret + clean, "doc_id long, text string")
    got = {r["doc_id"]: [s for s in r["spans"] if s["rank"] == 3] for r in secrets.scan(d).collect()}
    hit = sum(bool(got[i]) for i, _ in secret)
    false = sum(bool(got[i]) for i, _ in clean)
    assert hit >= 0.95 * len(secret) and hit / (hit + false) >= 0.95, (hit, false)
    assert all((s["start"], s["end"]) == (4, len(t) - 4) for i, t in secret for s in got[i])


def test_secret_sample_covers_small_tables_and_long_texts(spark):
    long = "word " * 50_000 + "api_key=abcdefgh12345678 " + "x" * 100_000
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan(clashing(spark, [long, long, ""])).collect()}
    assert [(s["start"], s["rank"]) for s in rows[0] if s["rank"] == 0] == [(250_000, 0)] and rows[0] == rows[1] and rows[2] == []


def test_mixing_edges(spark):
    d = clashing(spark, ["", None, "w " * 200_000, "a b", "a b"], ids=[1, 2, 3, 4, 4]).unionByName(clashing(spark, ["", None], ids=[8, 9], source="empty"))
    rows = mixing.mix(d).collect()
    assert len(rows) == 7 and untouched(rows)
    assert all(r["target"] == 0 and r["taken"] == 0 and r["position"] is None for r in rows if r["source"] == "empty")
    places = [r["position"] for r in rows if r["position"] is not None]
    assert all(str(p) != "-0.0" for p in places)
    own = d.withColumn("size", F.lit("own")).withColumn("place", F.lit(1))
    assert {r["size"] for r in mixing.mix(own).collect()} == {0, 2, 200_000}


def test_weights_of_shards_are_those_of_the_whole(spark, monkeypatch):
    rng = random.Random(5)
    word = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(i, " ".join(rng.choices(word, k=30))) for i in range(50)], "item_id long, text string")
    texts = [r["text"] + " tail" for r in bench.limit(20).collect()] + [" ".join(rng.choices(word, k=60)) for _ in range(30)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = sorted(tuple(round(x, 9) for x in r) for r in decontam.contaminated(d, bench).collect())
    monkeypatch.setattr(decontam, "ITEMS_PER_SHARD", 7)
    assert one == sorted(tuple(round(x, 9) for x in r) for r in decontam.contaminated(d, bench).collect()) and len(one) >= 20


def test_pseudonyms_link_equal_values_and_leave_the_rest(spark):
    """Every document of the table against its own spans: text between the
    values is unchanged, formats stay, and the map of values is one to one."""
    f = pii.Feistel(b"some key")
    to = {}
    shape = lambda v: re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", v)))
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r["text"] or ""
        new, found = pii.pseudonyms(text, f)
        at = out = 0
        for kind, start, end in found:
            gap = text[at:start]
            assert new[out:out + len(gap)] == gap
            out += len(gap)
            nxt = text[end:end + 12]
            stop = new.index(nxt, out) if nxt else len(new)
            value, fake = text[start:end], new[out:stop]
            if kind in ("card", "phone", "date", "ip"):
                assert to.setdefault((kind, value), fake) == fake
                assert shape(re.sub(r"[0-9]+", "9", fake)) == shape(re.sub(r"[0-9]+", "9", value))
            at, out = end, stop
        assert new[out:] == text[at:]
    for kind in {k for k, _ in to}:
        digits = {re.sub(r"\D", "", v) if kind == "card" else v: re.sub(r"\D", "", x) if kind == "card" else x for (k, v), x in to.items() if k == kind}
        assert len(set(digits.values())) == len(digits)


def test_archives_of_hot_and_null_ids(spark):
    rows = [(7, "u", f"<p>{i}</p>") for i in range(50)] + [(None, None, "<p>1</p>")] * 5 + [(1 << 62, "v", None), (0, "w", "x" * 200_000)]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_rows=10, roll_bytes=2000)
    assert out.count() == len(rows) and out.where("record_type = 'response'").count() == len({h or "" for _, _, h in rows})


def test_scratch_is_released(spark):
    import os

    from llm import ngram_join
    top = scratch_dir(spark).removeprefix("file://") + "/llm"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    rows = ngram_join.join(spark.read.parquet(f"{SF}/documents.parquet"))
    made = set(os.listdir(top)) - before
    assert len(made) == 1 and rows.count() == 200


def test_jaccard_tiles_keep_rows_that_may_meet(spark):
    from llm import ngram_join
    rng = np.random.default_rng(4)
    rows = [(int(k), i, int(n), int(lab)) for i, (k, n, lab) in enumerate(zip(rng.integers(0, 40, 400), rng.integers(1, 900, 400), rng.integers(0, 12, 400), strict=True))]
    got = {r["cid"] for r in ngram_join._meeting(spark.createDataFrame(rows, "key long, cid long, n long, label long"), 90).collect()}
    may = {a[1] for a in rows for b in rows if a[0] == b[0] and a[3] != b[3] and 100 * min(a[2], b[2]) >= 90 * max(a[2], b[2])}
    assert may <= got < {r[1] for r in rows}  # none that may be linked is lost, and rows of other sizes go
