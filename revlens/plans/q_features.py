"""Date, text, lexical, readability features,
anonymisation and the token pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.operators import features as X
from revlens.operators import textprep as P
from revlens.plans.registry import register
from revlens.plans.sqlgen import with_views
from revlens.sources.tables import DOC_REVIEWS_SQL, REVIEWS_SQL, doc_reviews, reviews, table


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


STOP_SQL = "[" + ", ".join(q(w) for w in T.english_stop_words()) + "]"
TOK = f"regexp_extract_all(content, {q(T.TOKEN_PATTERN)})"
SENT = f"len(regexp_extract_all(content, {q(T.SENTENCE_PATTERN)}))"
WORDS = f"list_filter(tok, lambda x: regexp_matches(x, {q('^[\\p{L}\\p{N}_]')}))"
NORM = (f"list_filter(list_transform(tok, lambda t: regexp_replace(lower(t), {q('[^\\p{L}]')}, '', 'g')), "
        f"lambda t: length(t) > 0)")
NOSTOP = f"list_filter({NORM}, lambda t: NOT list_contains({STOP_SQL}, t))"
TOKVIEW = f"SELECT id, content, {TOK} AS tok FROM d"
NSVIEW = f"SELECT id, {NOSTOP} AS ns FROM t"


def _ngram_sql(col, n):
    return f"list_transform(range(1, len({col}) - {n} + 2), lambda i: array_to_string({col}[i:i + {n - 1}], '_'))"


# ------------------------------------------------------------------ F1 / F2
@register("parse_dates", sql=with_views(
    "SELECT event_id, date, date_sub('day', date, m.mx) AS dt_review_age, strftime(date, '%Y') AS dt_year, "
    "strftime(date, '%B') AS dt_month, strftime(date, '%A') AS dt_day, strftime(date, '%Y-%m') AS dt_year_month, "
    "strftime(date, '%Y-%m-%d') AS dt_ymd FROM e CROSS JOIN m",
    e="SELECT event_id, ts AS date FROM events", m="SELECT max(date) AS mx FROM e"))
def parse_dates(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("date"))
    return X.parse_dates(e)


# ------------------------------------------------------------------ X1 - X9
_TEXT_SQL = f"""SELECT id, {SENT}::BIGINT AS text_sentence_count, len(tok)::BIGINT AS text_word_count,
       length(replace(content, ' ', ''))::BIGINT AS text_char_count,
       len(regexp_extract_all(content, {q(T.PUNCTUATION_CLASS)}))::BIGINT AS text_punctuation_count,
       len(list_filter(tok, lambda x: list_contains({STOP_SQL}, lower(x))))::BIGINT AS text_stopwords_count,
       CASE WHEN len(tok) > 0 THEN length(replace(content, ' ', '')) / len(tok) END AS text_word_density,
       CASE WHEN {SENT} > 0 THEN len(tok) / {SENT} END AS text_sentence_density,
       len(tok)::BIGINT AS review_length
    FROM t"""


@register("text_features", sql=with_views(_TEXT_SQL, d=DOC_REVIEWS_SQL, t=TOKVIEW), dbl=["text_word_density", "text_sentence_density"])
def text_features(spark, sf):
    d = doc_reviews(spark, sf).select("id", "content")
    return X.text_features(d).drop("content")


_LEX_SQL = f"""SELECT id, len(list_distinct(tok))::BIGINT AS lexical_unique_word_count,
       CASE WHEN len(tok) > 0 THEN len(list_distinct(tok)) / len(tok) END AS lexical_type_token_ratio,
       CASE WHEN len(tok) > 0 THEN len(list_filter(tok, lambda x: regexp_matches(x, {q('^\\p{L}')})
            AND NOT list_contains({STOP_SQL}, lower(x)))) / len(tok) END AS lexical_density,
       CASE WHEN len(tok) > 0 THEN list_sum(list_transform(tok, lambda x: length(x))) / len(tok) END
            AS lexical_avg_word_length
    FROM t"""


@register("lexical_features", sql=with_views(_LEX_SQL, d=DOC_REVIEWS_SQL, t=TOKVIEW),
          dbl=["lexical_type_token_ratio", "lexical_density", "lexical_avg_word_length"])
def lexical_features(spark, sf):
    d = doc_reviews(spark, sf).select("id", "content")
    return X.lexical_features(d).drop("content")


_READ_SQL = f"""
SELECT id,
  CASE WHEN w > 0 AND s > 0 THEN 206.835 - 1.015 * (w / s) - 84.6 * (y / w) END AS readability_flesch_reading_ease,
  CASE WHEN w > 0 AND s > 0 THEN 0.39 * (w / s) + 11.8 * (y / w) - 15.59 END AS readability_flesch_kincaid_grade,
  CASE WHEN w > 0 AND s > 0 THEN 0.4 * (w / s + 100 * (c / w)) END AS readability_gunning_fog,
  CASE WHEN w > 0 AND s > 0 THEN 1.043 * sqrt(30 * c / s) + 3.1291 END AS readability_smog_index
FROM (SELECT id, len(syl)::DOUBLE AS w, s::DOUBLE AS s, coalesce(list_sum(syl), 0)::DOUBLE AS y,
             len(list_filter(syl, lambda x: x >= 3))::DOUBLE AS c
      FROM (SELECT id, {SENT} AS s,
                   list_transform({WORDS}, lambda x: len(regexp_extract_all(lower(x), {q(T.VOWEL_GROUP)}))) AS syl
            FROM t))
"""


@register("readability", sql=with_views(_READ_SQL, d=DOC_REVIEWS_SQL, t=TOKVIEW),
          dbl=["readability_flesch_reading_ease", "readability_flesch_kincaid_grade",
               "readability_gunning_fog", "readability_smog_index"])
def readability(spark, sf):
    d = doc_reviews(spark, sf).select("id", "content")
    return X.readability(d).drop("content")


@register("engineer_features", sql=with_views(
    "SELECT d.* EXCLUDE (content), f.* EXCLUDE (id), l.* EXCLUDE (id), r.* EXCLUDE (id) FROM d JOIN f ON d.id = f.id JOIN l ON d.id = l.id "
    "JOIN rd r ON d.id = r.id", d=DOC_REVIEWS_SQL, t=TOKVIEW, f=_TEXT_SQL, l=_LEX_SQL, rd=_READ_SQL),
    dbl=["text_word_density", "text_sentence_density", "lexical_type_token_ratio", "lexical_density", "lexical_avg_word_length",
         "readability_flesch_reading_ease", "readability_flesch_kincaid_grade", "readability_gunning_fog", "readability_smog_index"])
def engineer_features(spark, sf):
    """All feature blocks on one shared token array."""
    return X.engineer_features(doc_reviews(spark, sf)).drop("content")


# ------------------------------------------------------------------ H1
@register("anonymize_author", sql=with_views(
    "SELECT id, substr(sha256(author), 1, 20) AS author FROM r", r=REVIEWS_SQL))
def anonymize_author(spark, sf):
    return X.anonymize_authors(reviews(spark, sf).select("id", "author"))


@register("anonymize_author_blake2b")
def anonymize_author_blake2b(spark, sf):
    """Exact BLAKE2b (10-byte digest) via an Arrow pandas UDF (rows check)."""
    return X.anonymize_authors(reviews(spark, sf).select("id", "author"), method="blake2b")


# ------------------------------------------------------------------ T2 - T8
@register("tokenize", sql=with_views("SELECT id, tok AS tokenized FROM t", d=DOC_REVIEWS_SQL, t=TOKVIEW))
def tokenize(spark, sf):
    return doc_reviews(spark, sf).select("id", P.tokenize(F.col("content")).alias("tokenized"))


@register("normalize_tokens", sql=with_views(f"SELECT id, {NORM} AS normalized FROM t",
                                             d=DOC_REVIEWS_SQL, t=TOKVIEW))
def normalize_tokens(spark, sf):
    return doc_reviews(spark, sf).select("id", P.normalize_tokens(P.tokenize(F.col("content"))).alias("normalized"))


@register("remove_stopwords", sql=with_views(f"SELECT id, {NOSTOP} AS no_stopwords FROM t",
                                             d=DOC_REVIEWS_SQL, t=TOKVIEW))
def remove_stopwords(spark, sf):
    return doc_reviews(spark, sf).select(
        "id", P.remove_stopwords(P.normalize_tokens(P.tokenize(F.col("content")))).alias("no_stopwords"))


@register("bigrams", sql=with_views(f"SELECT id, {_ngram_sql('ns', 2)} AS bigrams FROM n",
                                    d=DOC_REVIEWS_SQL, t=TOKVIEW, n=NSVIEW))
def bigrams_q(spark, sf):
    ns = P.remove_stopwords(P.normalize_tokens(P.tokenize(F.col("content"))))
    return doc_reviews(spark, sf).select("id", P.bigrams(ns).alias("bigrams"))


@register("trigrams", sql=with_views(f"SELECT id, {_ngram_sql('ns', 3)} AS trigrams FROM n",
                                     d=DOC_REVIEWS_SQL, t=TOKVIEW, n=NSVIEW))
def trigrams_q(spark, sf):
    ns = P.remove_stopwords(P.normalize_tokens(P.tokenize(F.col("content"))))
    return doc_reviews(spark, sf).select("id", P.trigrams(ns).alias("trigrams"))


_VOCAB_SQL = f"SELECT w AS word, count(*) AS freq FROM (SELECT unnest({NOSTOP}) AS w FROM t) GROUP BY w"


def _vocab(spark, sf):
    ns = P.remove_stopwords(P.normalize_tokens(P.tokenize(F.col("content"))))
    return P.token_vocabulary(doc_reviews(spark, sf).select(ns.alias("ns")), "ns")


# DuckDB's levenshtein counts UTF-8 bytes; Spark's counts characters.  The
# oracle maps every non-ASCII letter of the vocabulary to a spare one-byte
# symbol (normalised tokens hold only lower-case letters), so byte distance
# equals character distance.
_SPARE = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{|}~"


_SPELL_SQL = """SELECT word, correction FROM (
         SELECT r.word, dct.word AS correction,
                row_number() OVER (PARTITION BY r.word ORDER BY levenshtein(r.a, dct.a), dct.freq DESC, dct.word) AS rn
         FROM va r JOIN va dct ON dct.freq >= 3 AND levenshtein(r.a, dct.a) <= 2
         WHERE r.freq < 3)
       WHERE rn = 1"""
_SPELL_VIEWS = dict(
    d=DOC_REVIEWS_SQL, t=TOKVIEW, v=_VOCAB_SQL,
    ch="SELECT string_agg(c, '' ORDER BY c) AS src FROM (SELECT DISTINCT unnest(string_split(word, '')) AS c "
       "FROM v) WHERE ord(c) > 127",
    va=f"SELECT word, freq, translate(word, ch.src, substr('{_SPARE}', 1, length(ch.src))) AS a FROM v, ch")


@register("spell_correct", sql=with_views(_SPELL_SQL, **_SPELL_VIEWS))
def spell_correct(spark, sf):
    return P.fit_spell_corrections(_vocab(spark, sf), min_freq=3)


def _lemma_sql():
    arms = []
    for i, (suf, rep) in enumerate(P.LEMMA_RULES):
        arms.append(f"SELECT word, {i} AS rule, substr(word, 1, length(word) - {len(suf)}) || {q(rep)} AS lemma "
                    f"FROM v WHERE suffix(word, {q(suf)}) AND length(word) > {len(suf) + 2}")
    c = " UNION ALL ".join(arms)
    return ("SELECT word, lemma FROM (SELECT c.word, c.lemma, row_number() OVER (PARTITION BY c.word ORDER BY c.rule) AS rn "
            f"FROM ({c}) c WHERE c.lemma IN (SELECT word FROM v)) WHERE rn = 1")


@register("lemmatize", sql=with_views(_lemma_sql(), d=DOC_REVIEWS_SQL, t=TOKVIEW, v=_VOCAB_SQL))
def lemmatize(spark, sf):
    return P.fit_lemmas(_vocab(spark, sf))


def _map_sql(src, col, table, word, to, out):
    """Every token of an array through a (word, target) table, in order."""
    return (f"SELECT s.id, list(coalesce(m.{to}, s.w) ORDER BY s.i) AS {out} FROM (SELECT id, unnest({col}) AS w, "
            f"unnest(range(0, len({col}))) AS i FROM {src}) s LEFT JOIN {table} m ON s.w = m.{word} GROUP BY s.id")


@register("text_prep", sql=with_views(
    f"""SELECT c.id, c.tokenized, c.normalized, c.ns AS no_stopwords, coalesce(sc.a, []) AS spell_checked, coalesce(le.a, []) AS lemmatized,
               coalesce({_ngram_sql('le.a', 2)}, []) AS bigrams, coalesce({_ngram_sql('le.a', 3)}, []) AS trigrams
        FROM c LEFT JOIN sc ON sc.id = c.id LEFT JOIN le ON le.id = c.id""", **_SPELL_VIEWS,
    c=f"SELECT id, tok AS tokenized, {NORM} AS normalized, {NOSTOP} AS ns FROM t",
    sp=_SPELL_SQL, lm=_lemma_sql(), sc=_map_sql("c", "ns", "sp", "word", "correction", "a"),
    le=_map_sql("sc", "a", "lm", "word", "lemma", "a")))
def text_prep(spark, sf):
    """Whole fitted chain, seven array columns per document."""
    d = doc_reviews(spark, sf).select("id", "content")
    return P.text_prep(d).drop("content")
