"""Hand-made rows with known answers (FIXTURES section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.operators import normalize as N
from revlens.operators import quality as Q
from revlens.operators.reports import describe_categorical


def _one(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"c {typ}")
    return [r[0] for r in df.select(expr(F.col("c"))).collect()]


def test_special_chars_empty_and_accents(spark):
    assert _one(spark, [""], Q.has_excessive_special_chars) == [False]
    share = _one(spark, ["déjà vu, très bien"], T.special_char_share)[0]
    assert abs(share - 1 / 18) < 1e-12


def test_newlines(spark):
    assert _one(spark, ["a\nb\r\nc"], N.remove_newlines) == ["a b\r c"]


def test_phone_forms(spark):
    assert _one(spark, ["5551212", "555-1212", "555.555.1212", "(555) 555-1212"], Q.contains_phone) == [True] * 4


def test_url_forms(spark):
    assert _one(spark, ["http://a.co", "www.a.com/x", "a.com"], Q.contains_url) == [True, True, False]


def test_email(spark):
    assert _one(spark, ["write to a.b@c.org now", "a@b"], Q.contains_email) == [True, False]


def test_date_bounds(spark):
    vals = [dt.datetime(2006, 12, 31), dt.datetime(2007, 1, 1), dt.datetime(2024, 1, 1, 0, 0),
            dt.datetime(2024, 1, 1, 0, 1)]
    assert _one(spark, vals, Q.has_invalid_date, "timestamp_ntz") == [True, False, False, True]


def test_rating_bounds(spark):
    assert _one(spark, [-1, 0, 5, 6, None], Q.has_invalid_rating, "int") == [True, False, False, True, False]


def test_emoji(spark):
    assert _one(spark, ["great app 😀", "plain text", "★ star", "⌘ \u2713 \u2780", "⭐ ❤"], Q.has_emoji) == [True, False, False, False, True]


def test_null_category_kept(spark):
    df = spark.createDataFrame([("Shopping",), (None,), ("Games",)], "category string")
    assert sorted(r[0] or "" for r in N.trim_category(df).collect()) == ["", "Games"]


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(x,) for x in "baab"], "x string")
    assert describe_categorical(df, "x").first()["top"] == "a"


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],)], "t array<string>")
    out = df.select(T.ngrams(F.col("t"), 2).alias("b"), T.ngrams(F.col("t"), 3).alias("c")).collect()
    assert [list(r.b) for r in out] == [["a_b", "b_c"], []]
    assert [list(r.c) for r in out] == [["a_b_c"], []]


def test_elapsed_days_not_calendar(spark):
    from revlens.operators.features import parse_dates
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23),), (dt.datetime(2024, 1, 2, 1),)], "date timestamp_ntz")
    ages = sorted(r.dt_review_age for r in parse_dates(df).collect())
    assert ages == [0, 0]


def test_tokens_and_sentences(spark):
    df = spark.createDataFrame([("It's fine. Really!? yes",)], "c string")
    r = df.select(T.tokens(F.col("c")).alias("t"), F.size(T.sentences(F.col("c"))).alias("s")).first()
    assert list(r.t) == ["It's", "fine", ".", "Really", "!", "?", "yes"]
    assert r.s == 3


def test_noisy_row_flags(spark):
    """The injected noisy text trips e-mail, URL and phone flags."""
    from revlens.plans.q_prep import NOISY_TEXT
    df = spark.createDataFrame([(NOISY_TEXT,)], "c string")
    r = df.select(Q.contains_email(F.col("c")), Q.contains_url(F.col("c")), Q.contains_phone(F.col("c"))).first()
    assert list(r) == [True, True, True]


def test_repair_drops_broken_bytes_only(spark):
    df = spark.sql("SELECT cast(unhex('61C32862FF') AS string) AS a, 'x�y' AS b")
    r = df.select(N.repair_utf8(df.a).alias("a"), N.repair_utf8(df.b).alias("b")).first()
    assert (r["a"], r["b"]) == ("a(b", "x�y")


def test_profanity_beside_punctuation(spark):
    from revlens.operators.language import has_profanity
    assert _one(spark, ["this is shit!", "crap-app", "crap/joke", "scrapper", "f*ck", "damn_it"], has_profanity) == \
        [True, True, True, False, True, False]


def test_language_of_rows_that_share_an_id(spark):
    from revlens.operators import language as L
    train = spark.createDataFrame([("the thing is there", "en"), ("le chat est la", "fr")] * 3, "t string, lang string")
    rows = spark.createDataFrame([(1, "the thing there"), (1, "le chat la"), (None, "the"), (2, None), (3, "")], "id int, t string")
    got = L.flag_non_english(rows, L.fit_language_model(train, "t", "lang"), "t", ["en", "fr"], "flag").collect()
    assert len(got) == 5 and {(r["id"], r["t"]): r["flag"] for r in got}[(1, "le chat la")] is True
    assert not any(r["flag"] for r in got if r["t"] != "le chat la")


def test_token_map_keeps_rows_with_one_id_apart(spark):
    from revlens.operators.textprep import apply_token_map
    df = spark.createDataFrame([(1, ["apple", "banana"]), (1, ["cherry"]), (None, []), (None, ["apple"])], "id int, t array<string>")
    m = spark.createDataFrame([("apple", "pear")], "w string, to string")
    got = sorted((str(r["id"]), r["o"]) for r in apply_token_map(df, "t", m, "o").collect())
    assert got == [("1", ["cherry"]), ("1", ["pear", "banana"]), ("None", []), ("None", ["pear"])]


def test_spelling_of_long_words(spark):
    from revlens.operators.textprep import fit_spell_corrections
    long = "abcdefghijklmnopqrstuvwxyz" * 3
    v = spark.createDataFrame([(long, 9), (long[1:-1], 1), ("hello", 5), ("helo", 1), ("x" * 21, 3), ("x" * 20, 1)], "word string, freq long")
    got = {r["word"]: r["correction"] for r in fit_spell_corrections(v).collect()}
    assert got == {long[1:-1]: long, "helo": "hello", "x" * 20: "x" * 21}


def test_group_without_measures_stays(spark):
    from revlens.operators import metrics as M
    df = spark.createDataFrame([("a", None, None, None, None, None, None, None, None)],
                               "category string, app_id string, app_name string, author string, rating int, "
                               "review_length int, vote_count long, vote_sum long, date timestamp")
    r = M.category_metrics(df).collect()
    assert len(r) == 1 and r[0]["review_count"] == 1 and r[0]["app_count"] == 0
