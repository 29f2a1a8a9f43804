"""Secret scans: fixed patterns, plus spans found by character Markov models.

Two first-order models over ASCII characters, one of random strings and one
of ordinary identifiers, are trained from labelled samples: values that the
fixed patterns find against the other long words of ordinary documents.  A
candidate (a run of 20 or more key characters outside the base spans) is a
secret when the log-likelihood ratio per character and in all is high.

DataFrame operations only.  Java's patterns give no offsets, so they come
from the lengths of the pieces between matches (``split``) and of the
matches (``regexp_extract_all``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import fresh, stored

#: The three base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs are maximal, so this is [0-9a-f]+ of 32 or more
ASSIGN_MIN, ACCESS_MIN = 8, 16

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WORDLIKE = r"[A-Za-z0-9_-]{8,}"
#: Shape of the negative samples: words and camel, snake or kebab identifiers.
ORDINARY = r"^[A-Z]?[a-z]{2,}(?:[_-]?[A-Z]?[a-z]{2,})*[0-9]{0,4}$"
KINDS = ("assign", "access", "hex", "markov")
#: Size of the labelled samples (different texts each) that fit the two models.
SAMPLE_DOCS = 4000
BACKOFF = 16.0
MIN_PER_CHAR, MIN_TOTAL = 0.6, 15.0
SPAN = "struct<start:int,end:int,rank:int>"
NONE = f"array<{SPAN}>"


def _located(text: Column, pattern: str, rank: int, keep, group: int = 0) -> Column:
    """Spans (code points, end exclusive) of the non-overlapping matches that ``keep`` (of the group's text) accepts."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    parts = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    zipped = F.arrays_zip(parts.alias("p"), hits.alias("m"), value.alias("v"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(NONE).alias("out"))

    def step(acc, z):
        s = acc["pos"] + F.length(z["p"])
        e = s + F.length(z["m"])
        one = F.array(F.struct(s.alias("start"), e.alias("end"), F.lit(rank).alias("rank")))
        return F.struct(e.alias("pos"), F.when(keep(z["v"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _when(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(NONE))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then kind."""
    assign = _when(text.rlike("[:=]") & text.rlike(ASSIGN), _located(text, ASSIGN, 0, lambda v: F.length(v) >= ASSIGN_MIN, 2))
    access = _when(F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS), _located(text, ACCESS, 1, lambda v: F.length(v) >= ACCESS_MIN))
    hexes = _when(text.rlike(HEX), _located(text, HEX, 2, lambda v: F.lit(True)))
    return F.array_sort(F.concat(assign, access, hexes), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                        .otherwise(a["rank"] - b["rank"]))


def _pairs(words: DataFrame) -> DataFrame:
    """(code of a character pair, count) over a column ``w`` of ASCII words; a word starts after code 0."""
    chars = F.transform(F.split(F.col("w"), ""), lambda c: F.ascii(c))
    prev = F.concat(F.array(F.lit(0)), chars)
    pair = F.zip_with(F.slice(prev, F.lit(1), F.size(chars)), chars, lambda a, b: a * 128 + b)
    return words.select(F.explode(pair).alias("code")).where("code between 0 and 16383").groupBy("code").count()


def fit(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row with the array ``llr`` of 128 x 128 log-likelihood ratios.

    Trained from about ``SAMPLE_DOCS`` different texts with base spans and as
    many of all (all of them where there are fewer): those whose hash lies
    under a bound that follows from the two counts, so no text is sorted.
    Without any positive sample the random model is uniform."""
    src = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    has = (F.col("t").rlike("[:=]") & F.col("t").rlike(ASSIGN)) | F.col("t").rlike(ACCESS) | F.col("t").rlike(HEX)
    size = src.agg(F.count(F.lit(1)).alias("all"), F.count_if(has).alias("found")).first()

    def sample(n, cond):  # equal texts have one hash and count once
        bound = SAMPLE_DOCS / max(n, 1)
        few = src if bound >= 1 else src.where(F.xxhash64("t") < int(bound * (1 << 64)) - (1 << 63))
        return few.where(cond).groupBy(F.xxhash64("t").alias("h")).agg(F.any_value("t").alias("t"))

    found = sample(size["found"], has)
    values = F.concat(F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_MIN),
                      F.filter(F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), lambda v: F.length(v) >= ACCESS_MIN),
                      F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    random = _pairs(found.select(F.explode(values).alias("w")))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = _pairs(sample(size["all"], F.lit(True)).select(F.explode(F.regexp_extract_all(clean, F.lit(WORDLIKE), F.lit(0))).alias("w")).where(F.col("w").rlike(ORDINARY)))
    cells = (docs.sparkSession.range(128 * 128).select(F.col("id").cast("int").alias("code"))
             .join(random.withColumnRenamed("count", "r"), "code", "left").join(plain.withColumnRenamed("count", "o"), "code", "left")
             .na.fill(0, ["r", "o"]))
    row, column, every = Window.partitionBy(F.floor(F.col("code") / 128)), Window.partitionBy(F.col("code") % 128), Window.partitionBy()

    def p(c):  # pairs, smoothed by the second character's own share (64 characters, BACKOFF pseudo-counts)
        share = (F.sum(c).over(column) + 0.5) / (F.sum(c).over(every) + 32)
        return (F.col(c) + BACKOFF * share) / (F.sum(c).over(row) + BACKOFF)

    return (cells.select("code", F.log(p("r") / p("o")).alias("l"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "l"))), lambda x: x["l"]).alias("llr")))


def _score(word: Column, llr: Column) -> Column:
    """Sum of the log-likelihood ratios of a word's character pairs."""
    zero = F.struct(F.lit(0).alias("prev"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(F.ascii(c).alias("prev"), (acc["sum"] + F.get(llr, acc["prev"] * 128 + F.ascii(c))).alias("sum"))
    return F.aggregate(F.split(word, ""), zero, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """All rows and columns of ``docs`` plus ``out``: an array of (start, end,
    rank) by start, then kind; ranks index ``KINDS``.

    Null text has no spans.  Spans of different base kinds may overlap; a
    Markov span overlaps none.  Repeated rows are scanned each; an empty
    table gives no rows; a column named like ``out`` is replaced."""
    model = stored(fit(docs, text_col), "secret-model")  # one row of 16,384 doubles
    docs = docs.drop(out)
    base, llr = fresh(docs, "base_spans", "llr")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn(base, base_spans(text)).crossJoin(F.broadcast(model.withColumnRenamed("llr", llr)))

    def good(word):
        s = _score(word, F.col(llr))
        return (s >= MIN_TOTAL) & (s >= MIN_PER_CHAR * F.length(word))

    more = _when(text.rlike(CANDIDATE), _located(text, CANDIDATE, 3, good))
    clear = F.filter(more, lambda m: ~F.exists(F.col(base), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    both = F.array_sort(F.concat(F.col(base), clear), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                        .otherwise(a["rank"] - b["rank"]))
    return rows.withColumn(out, both).drop(base, llr)


def described(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("s"))

    def step(acc, x):
        fresh = x["start"] >= acc["pos"]
        piece = F.concat(acc["s"], F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]), F.lit(mark))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(fresh, piece).otherwise(acc["s"]).alias("s"))

    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["s"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
