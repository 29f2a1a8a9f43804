"""Forms that differ by size give the same results; staging, quantiles and
run metrics against plain computations."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.functions.quantiles import exact_quantiles
from revlens.operators import explore as X
from revlens.operators import language as L
from revlens.operators import metrics as M
from revlens.operators import quality as Q
from revlens.operators import textprep as P
from revlens.plans import stages as E
from revlens.sources import files as S
from revlens.sources.tables import full_reviews, reviews, table

SF = "/root/testdata/sf0.001"


def test_exact_quantiles_equal_numpy(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 1.0, 2.0, 1e18, -5.5, float(rng.randint(0, 500))])) for _ in range(3000)]
    rows += [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    probs = [0.0, 0.013, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "x", probs, by=["g"]).collect()}
    of = {}
    for g, x in rows:
        if x is not None and x == x:
            of.setdefault(g, []).append(x)
    assert set(got) == set(of) and "none" not in got
    for g, xs in of.items():
        assert np.allclose(got[g], np.quantile(xs, probs))
    whole = exact_quantiles(df, "x", probs).first()["q"]
    assert np.allclose(whole, np.quantile([x for xs in of.values() for x in xs], probs))
    assert exact_quantiles(df.limit(0), "x", probs).collect()[0]["q"] is None


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1, 3), (5, 1), (9, 0), (2, 2)], "x int, w long")
    assert exact_quantiles(df, "x", [0.5, 1.0], weight="w").first()["q"] == [1.5, 5.0]


def test_pareto_and_lorenz_with_one_common_count(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 1000).alias("k"))  # every key three times
    p = X.pareto(df, "k").collect()
    assert sorted(r["cumulative"] for r in p) == [3 * (i + 1) for i in range(1000)]
    assert [r["k"] for r in sorted(p, key=lambda r: r["cumulative"])] == sorted(r["k"] for r in p)
    g = X.lorenz_gini(df, "k").collect()
    assert len(g) == 1 and abs(g[0]["gini"]) < 1e-12 and g[0]["cum_key_share"] == 1


def test_duplicate_flags_by_key_and_row(spark):
    rows = [("1", "a", None)] * 3 + [("1", "b", None), ("2", "c", "x"), (None, "d", None), (None, "d", "")]
    df = spark.createDataFrame(rows, "id string, t string, u string")
    out = Q.flag_duplicates(df, {"row": None, "by_id": ["id"], "by_both": ["id", "t"]}).collect()
    assert len(out) == len(rows)
    assert sum(r["row"] for r in out) == 2  # two of three equal rows
    assert sum(r["by_id"] for r in out if r["id"] == "1") == 3 and sum(r["by_id"] for r in out if r["id"] is None) == 1
    assert sum(r["by_both"] for r in out) == 3 and not any(r["by_id"] for r in out if r["id"] == "2")
    again = Q.flag_duplicates(df.repartition(4), {"row": None, "by_id": ["id"]}).collect()  # the order of the rows does not matter
    assert sorted(map(repr, ((*r[:3], r["by_id"]) for r in out))) == sorted(map(repr, ((*r[:3], r["by_id"]) for r in again)))


def test_only_rows_with_copies_are_shuffled_whole(spark):
    df = table(spark, SF, "documents").select("doc_id", "text")
    plan = Q.flag_duplicates(df, {"row": None})._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate(keys=[doc_id" not in plan and "keys=[text" not in plan


def test_packed_and_joined_language_agree(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "!!", None), (-4, "x", None), (-5, "日本 語", None)], docs.schema)
    docs = docs.union(extra)
    model = L.fit_language_model(docs, "text", "lang")
    langs = [r[0] for r in model.select("lang").distinct().collect()]
    one = {r["doc_id"]: r["p"] for r in L.detect_language(docs, model, "text", langs, "p").collect()}
    two = {r["doc_id"]: r["p"] for r in L.detect_language(docs, model, "text", langs, "p", packed_bytes=0).collect()}
    assert one == two and one[-1] is None and len(set(one.values())) > 2
    plan = L.detect_language(docs, model, "text", langs, "p")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_token_map_in_place_and_joined_agree(spark):
    rng = random.Random(3)
    rows = [(i % 30, [rng.choice(["cats", "dogs", "sun", "ü", ""]) for _ in range(rng.randint(0, 9))]) for i in range(60)] + [(99, None), (99, [])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    m = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("sun", "sun"), ("", "empty")], "word string, lemma string")
    to = {"cats": "cat", "dogs": "dog", "": "empty"}
    want = sorted((i, [to.get(w, w) for w in t or []]) for i, t in rows)
    for limit in (P.MAP_BYTES, 0):
        got = P.apply_token_map(df, "t", m, "out", map_bytes=limit)
        assert sorted((r["id"], r["out"]) for r in got.collect()) == want


@pytest.mark.parametrize("keys,distincts", [(["category"], {"apps": "app_id"}), (["author"], {"apps": "app_id", "cats": "category"}), (["category", "author"], {})])
def test_metrics_direct_and_by_histogram_agree(spark, keys, distincts):
    r = reviews(spark, SF)
    r = r.withColumn("rating", F.when(~F.col("id").endswith("3"), F.col("rating")))
    r = r.unionByName(r.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in r.dtypes}))  # a group of nulls
    cols = None
    for hot in (10**9, 0, 40):
        out = M.metric_block(r, keys, distincts, hot=hot)
        cols = cols or out.columns
        rows = sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in (x[c] for c in cols)) for x in out.collect()], key=repr)
        if hot == 10**9:
            want = rows
        assert rows == want


def test_staging_skips_what_is_there(spark):
    path = S.shared_scratch(spark, "stage-test")
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b b", 3, ""), (None, 4, "y")], "category string, n int, t string")
    assert S.stage_files(df, path).count() == 3
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".csv")}
    first = files()
    assert S.stage_files(df.repartition(3), path).count() == 0 and files() == first
    changed = df.where("n != 2").union(spark.createDataFrame([("c", 9, "z")], df.schema))
    assert {r["category"] for r in S.stage_files(changed, path).collect()} == {"a", "c"}
    same = {f for f in first if "category=a" not in f}
    assert same <= files() and len([f for f in files() if "category=a" in f]) == 1
    assert S.stage_files(changed, path, force=True).count() == 4
    assert {r["category"]: r["rows"] for r in S.staged_markers(spark, path, "category").collect()} == {"a": 1, "b b": 1, None: 1, "c": 1}
    back = spark.read.option("header", True).option("sep", "\t").csv(path)
    assert back.count() == 4  # the marker table is not read as data


def test_files_with_different_headers(spark):
    path = S.shared_scratch(spark, "overview-test")
    os.makedirs(f"{path}/category=a%20b")
    os.makedirs(f"{path}/category=c")
    open(f"{path}/category=a%20b/1.tsv", "w").write("id\tname\n1\tab\n2\té\n")
    open(f"{path}/category=c/2.tsv", "w").write("id\tname\tnote\n1\tab\t\"\"\n")
    rows = {r["category"]: r for r in S.fileset_overview(spark, f"{path}/*/*.tsv", key="category").collect()}
    assert {k: (r["rows"], r["columns"], r["value_bytes"]) for k, r in rows.items()} == {"a b": (2, 2, 6), "c": (1, 3, 3), "Total": (3, 3, 9)}
    with pytest.raises(FileNotFoundError):
        S.acquire_reviews(spark, f"{path}/*.none")


def test_run_metrics_are_observed(spark):
    base = S.shared_scratch(spark, "observed")
    spark.range(500).write.parquet(f"{base}/src")
    E.run_stage(spark, lambda d: d.where("id < 123"), f"{base}/src", f"{base}/dst", "DataCleaningTask", f"{base}/m")
    E.run_stage(spark, lambda d: d.where("id < 0").orderBy("id"), f"{base}/src", f"{base}/none", "DataCleaningTask", f"{base}/m")
    rows = E.read_metrics(spark, f"{base}/m").orderBy("start").collect()
    assert [(r["input_records"], r["output_records"]) for r in rows] == [(500, 123), (500, 0)]
    assert all(r["start"] <= r["stop"] and r["runtime"] > 0 for r in rows)


def test_every_review_has_a_text(spark):
    r, f = reviews(spark, SF), full_reviews(spark, SF)
    assert f.count() == r.count() and f.where("content is null").count() == table(spark, SF, "documents").where("text is null").count() * 0
    assert f.select("content").distinct().count() > 100


def test_duplicates_same_by_numbers_digests_and_bit_map(spark, monkeypatch):
    """Hot keys, keys told by a map of bits and keys told by a join get the same flags."""
    rows = [(i % 40, f"t{i % 3}", None if i % 7 == 0 else float(i % 2)) for i in range(200)] + [(None, "t", None)] * 3 + [(1000 + i, "u", 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, t string, x double").repartition(5)
    flags = {"row": None, "by_id": ["id"]}
    found = []
    for few, hot in ((1 << 20, 100_000), (0, 100_000), (0, 3), (1 << 20, 0)):
        monkeypatch.setattr(Q, "FEW_KEYS", few)
        out = Q.flag_duplicates(df, flags, hot=hot).collect()
        assert len(out) == len(rows)
        found.append(sorted(map(repr, out)))
    assert found[0] == found[1] == found[2] == found[3]
    assert sum("by_id=False" in r for r in found[0]) == len({r[0] for r in rows})
    assert sum("row=False" in r for r in found[0]) == len(set(rows))


def test_rows_of_single_keys_are_not_shuffled_whole(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW_KEYS", 0)
    df = spark.range(2000).selectExpr("id % 1900 as id", "repeat('x', 50) as t")
    plan = Q.flag_duplicates(df, {"by_id": ["id"]})._jdf.queryExecution().executedPlan().toString()
    # one branch passes its rows as they are, the other one orders those of repeated keys
    assert plan.count("Window") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_noisy_reviews_join_their_tables_once(spark):
    from revlens.plans.q_quality import noisy_reviews
    plan = noisy_reviews(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_language_of_long_short_and_foreign_texts(spark, monkeypatch):
    """Texts cut into pieces, batches and alphabets too large for a table give the joined form's verdicts."""
    docs = spark.createDataFrame([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de"), ("こんにちは世界 " * 5, "ja")], "text string, lang string")
    texts = ["the dog", "die katze", "", None, "a", "ab", "the " * 40 + "der hund", "der " * 40, "世界 こんにちは", "\U00020000 xyz", "123"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    model = L.fit_language_model(docs, "text", "lang")
    langs = ["de", "en", "ja"]
    want = {r["i"]: r["p"] for r in L.detect_language(df, model, "text", langs, "p", packed_bytes=0).collect()}
    for direct, chunk in ((1 << 22, 1 << 20), (0, 1 << 20), (1 << 22, 7), (0, 3)):
        monkeypatch.setattr(L, "_DIRECT", direct)
        monkeypatch.setattr(L, "_CHUNK", chunk)
        assert {r["i"]: r["p"] for r in L.detect_language(df, model, "text", langs, "p").collect()} == want


def test_ngrams_make_no_array_for_each_gram(spark):
    from revlens.functions import text as T
    df = spark.createDataFrame([(["a", "b", None, "c"],), (["a"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(T.ngrams(F.col("t"), 2)).collect()] == [["a_b", "b", "c"], [], [], []]
    assert [r[0] for r in df.select(T.ngrams(F.col("t"), 3)).collect()] == [["a_b", "b_c"], [], [], []]
    assert "array_join" not in df.select(T.ngrams(F.col("t"), 3))._jdf.queryExecution().optimizedPlan().toString()


def test_guards_keep_the_patterns_verdicts(spark):
    from revlens.functions import constants as K
    texts = [None, "", "a@b.cd", "a @ b", "http://a.bc/x", "www.a.bc", "ftp://a.bc", "5551212", "555.121 2", "(555) 555-1212", "x5551212", "5551212x", "damn", "Damned", "sh!t", "f*ck", "éshit shit", "_damn"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    c = F.col("c")
    for f, p in ((Q.contains_email, K.EMAIL_PATTERN), (Q.contains_url, K.URL_PATTERN), (Q.contains_phone, K.PHONE_PATTERN)):
        assert df.where(f(c) != F.coalesce(c.rlike(p), F.lit(False))).count() == 0
        plan = df.select(f(c))._jdf.queryExecution().optimizedPlan().toString()
        assert " AND " in plan  # a cheap test stands before the pattern
    assert [r[0] for r in df.where(L.has_profanity(c)).collect()] == ["damn", "sh!t", "f*ck", "éshit shit"]


def test_large_token_map_moves_no_single_occurrence(spark):
    # by blocks: every block has its own rows, copies of one text too, and rows pass with all their columns
    rows = [(i % 7, "x" * i, ["cats"] * 40 + [f"w{i}"]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, other string, t array<string>")
    m = spark.createDataFrame([("cats", "cat"), *[(f"w{i}", f"v{i}") for i in range(0, 50, 2)]], "word string, to string")
    out = P.apply_token_map(df, "t", m, "out", map_bytes=0)
    assert out.columns == ["id", "other", "t", "out"]
    got = sorted((r["other"], r["id"], r["out"]) for r in out.collect())
    assert got == sorted((x, i, ["cat"] * 40 + [w[-1] if int(w[-1][1:]) % 2 else "v" + w[-1][1:]]) for i, x, w in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "sha2" not in plan


def test_corrections_go_by_rising_distance(spark):
    v = spark.createDataFrame([("houses", 8), ("mouse", 9), ("house", 5), ("hose", 1), ("xxuse", 1), ("moues", 2), ("zzz", 1), ("hauses", 1)], "word string, freq long")
    got = {r["word"]: r["correction"] for r in P.fit_spell_corrections(v).collect()}
    # one edit beats two whatever the frequency; at two the commoner word, then the first
    assert got == {"hose": "house", "xxuse": "mouse", "moues": "mouse", "hauses": "houses"}
    near = {r["word"]: r["correction"] for r in P.fit_spell_corrections(v, max_distance=1).collect()}
    assert near == {"hose": "house", "hauses": "houses"}


def test_spell_keys_of_distance_two_only_for_words_left(spark, monkeypatch):
    seen = []
    near = P._nearest
    monkeypatch.setattr(P, "_nearest", lambda words, dic, d: seen.append((d, words.count())) or near(words, dic, d))
    v = spark.createDataFrame([("house", 9), ("hous", 1), ("hou", 1)], "word string, freq long")
    assert P.fit_spell_corrections(v).count() == 2 and seen == [(1, 2), (2, 1)]


def test_collocations_split_texts_once(spark):
    from revlens.operators import explore as E
    df = spark.createDataFrame([(["a", "b", "a"],), (["c"],), ([],), (None,), (["a", "b"],)], "t array<string>")
    out = E.collocations(df, "t")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # pairs and words come from one stored count
    got = {(r["w1"], r["w2"]): (r["count"], round(r["pmi"], 9)) for r in out.collect()}
    import math
    assert got == {("a", "b"): (2, round(math.log((2 / 3) / (3 / 6 * 2 / 6)), 9)), ("b", "a"): (1, round(math.log((1 / 3) / (3 / 6 * 2 / 6)), 9))}


def test_metrics_of_large_tables_get_more_tasks(spark, monkeypatch):
    r = reviews(spark, SF)
    want = sorted(map(tuple, M.app_metrics(r).collect()), key=repr)
    monkeypatch.setattr(M, "TASK_ROWS", 100)
    out = M.app_metrics(r)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, out.collect()), key=repr)
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in got] == [tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in want]


def test_duplicate_flags_of_long_texts_move_only_kept_rows(spark):
    rng = random.Random(5)
    head = "same words " * 8  # longer than the head that is compared first
    rows = [(rng.choice(["1", "2", "3", "4", None]), rng.choice([1, 2, None]), rng.choice([None, "", head, head + "a", head + "b", "c"]), rng.choice([7, 8, None])) for _ in range(150)]
    df = spark.createDataFrame([*rows, ("9", 1, "x", 7)], "id string, rating int, content string, votes int").repartition(5)
    keys = {"row": None, "by_id": ["id"]}
    plain = sorted(map(str, Q.flag_duplicates(df, keys).collect()))
    assert sorted(map(str, Q.flag_duplicates(df, keys, wide=["content"]).collect())) == plain
    only = df.select("id", "content", "rating")  # the text before other columns, and as the only other one
    for d in (only, only.select("id", "content"), df.select("content", "id")):
        assert sorted(map(str, Q.flag_duplicates(d, keys, wide=["content"]).collect())) == sorted(map(str, Q.flag_duplicates(d, keys).collect()))
    flags = Q.assess_quality(df, outlier_columns=(), date_column=None)
    plan = flags.where("not dqa_contains_email")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    windows = [i for i, line in enumerate(plan) if "Window [" in line]
    assert windows and any("RLIKE" in line and "Filter" in line for line in plan[max(windows):])  # the filter is below the numbering


def test_value_counts_spread_large_tables_over_tasks(spark, monkeypatch):
    from revlens.functions import stats
    from revlens.operators import reports as R
    rows = [(f"r{i % 900}", f"a{i % 7}", None if i % 5 == 0 else f"u{i % 50}", "c" if i % 3 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, app_id string, author string, category string")
    plain = sorted(map(str, R.by_category(df).collect()))
    monkeypatch.setattr(stats, "TASK_ROWS", 100)
    tasks = df.count() // 100
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = R.by_category(df)
    assert "REPARTITION_BY_NUM" in large._jdf.queryExecution().executedPlan().toString() and sorted(map(str, large.collect())) == plain


def test_tfidf_counts_documents_where_they_are(spark):
    import math
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i, rng.choices("uvwxyz", k=rng.randint(0, 8))) for i in range(60)]
    many = [("a", 1, ["u", "u"]), ("b", 1, ["u", "q"]), (None, 1, ["q"]), ("a", None, ["v"]), ("b", None, ["v", "q"]), ("a", 77, None)]  # documents of several rows
    for data in (rows, rows + many):
        df = spark.createDataFrame(data, "g string, id long, t array<string>")
        out = X.tfidf_top_terms(df, "t", "g", n=99)
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # both figures come from one stored count
        tf, docs = {}, {}
        for g, i, ts in data:
            for t in ts or []:
                tf[g, t] = tf.get((g, t), 0) + 1
                docs.setdefault(t, set()).add(i)
        want = sorted(((g, t, n, len(docs[t]), round(n * math.log(len(data) / len(docs[t])), 9)) for (g, t), n in tf.items()), key=str)
        assert sorted(((r["g"], r["term"], r["tf"], r["df"], round(r["tfidf"], 9)) for r in out.collect()), key=str) == want


def test_acquisition_moves_only_rows_that_may_repeat(spark, tmp_path):
    head = "id\tapp_id\tapp_name\tcategory_id\tcategory\tauthor\trating\ttitle\tcontent\tvote_count\tvote_sum\tdate\n"
    line = "{}\tb\tn\tc\tc\tw\t{}\tt{}\tx\t1\t2\t2020-01-01 00:00:00\n"
    for name, rows in (("one", [(1, 5, "a"), (1, 5, "b"), (2, 5, "a"), (3, "", "a")]), ("two", [(1, 5, "a"), (1, 4, "a"), (2, 5, "a"), (2, 5, "a")])):
        (tmp_path / f"{name}.csv").write_text(head + "".join(line.format(*r) for r in rows))
    out = S.acquire_reviews(spark, f"{tmp_path}/*.csv")
    # titles are no part of a row, files are; a row without a rating goes
    assert sorted((r["id"], r["rating"]) for r in out.collect()) == [("1", 4.0), ("1", 5.0), ("1", 5.0), ("2", 5.0), ("2", 5.0)]
    (tmp_path / "two.csv").write_text(head + line.format(1, 5, "a") + line.format(2, 5, "a"))
    assert "Aggregate" not in S.acquire_reviews(spark, f"{tmp_path}/two.csv")._jdf.queryExecution().executedPlan().toString()


def test_texts_by_reference_give_the_same_flags_and_do_not_move(spark):
    head = "same start " * 10
    texts = [(0, head + "b"), (1, head + "a"), (2, head + "b"), (3, None), (4, ""), (5, "é"), (6, "z 555-1212"), (7, "mail a@b.org")]
    rows = [(f"{i % 9}", 1 + i % 2, k) for i, k in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8] * 6)] + [("one", 3, 7), (None, 4, 1), (None, 4, 0), (None, 4, 2), ("two", None, 9)]
    by_key, of = spark.createDataFrame(rows, "id string, rating int, k int").repartition(5), spark.createDataFrame(texts, "k int, content string").repartition(3)
    whole = by_key.join(of, "k", "left").drop("k")
    want = Q.assess_quality(whole, outlier_columns=("rating",))
    got = Q.assess_quality(by_key, outlier_columns=("rating",), texts=of, text_key="k")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    twice = of.union(of.where("k = 1"))  # a key of two texts gives two rows
    assert sorted(map(str, Q.assess_quality(by_key, outlier_columns=(), texts=twice, text_key="k").collect())) == sorted(
        map(str, Q.assess_quality(by_key.join(twice, "k", "left").drop("k"), outlier_columns=()).collect()))
    numbered, places = Q.number_texts(of, "k", "content")
    assert [r["content"] for r in numbered.orderBy("_text").collect()] == sorted({t for _, t in texts if t is not None}, key=lambda t: t.encode())
    assert {r["k"] for r in places.where("_text is null").collect()} == {3} and places.count() == len(texts)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not [x for x in plan.split("\n") if "content#" in x and any(n in x for n in ("Window", "Aggregate", "Repartition"))]


def test_token_maps_go_one_after_another_and_rows_move_once(spark, monkeypatch):
    words = ["colour", "colours", "colors", "colour", "running", "run", "runing", "cats", "cat", "cta", "the", "x"]
    rows = [(i, None if i == 7 else " ".join(words[(i * j) % len(words)] for j in range(i % 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, content string")
    want = sorted(map(str, P.text_prep(df).collect()))
    monkeypatch.setattr(P, "MAP_BYTES", 0)
    monkeypatch.setattr(P, "BLOCK_ROWS", 8)
    out = P.text_prep(df)
    assert sorted(map(str, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    moved = [x for x in plan.split("\n") if "Exchange" in x]
    assert plan.count("FlatMapCoGroups") == 1 and len(moved) == 2
    maps = [spark.createDataFrame(m, "w string, t string") for m in ([("a", "b"), ("c", "d"), ("e", "e")], [("b", "x"), ("c", "y"), ("f", "z")])]
    t = spark.createDataFrame([(["a", "c", "e", "f", "b", None],), ([],), (None,)], "t array<string>")
    got = sorted(map(str, P.apply_token_maps(t, "t", F.col("t"), {"one": maps[0], "two": maps[1]}).select("one", "two").collect()))
    assert got == sorted(["Row(one=[], two=[])"] * 2 + ["Row(one=['b', 'd', 'e', 'f', 'b', None], two=['x', 'd', 'e', 'z', 'x', None])"])
