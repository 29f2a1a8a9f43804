"""Stateless quality flags through Structured Streaming."""

import os

from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.functions import text as T
from revlens.operators import language as L
from revlens.plans.q_quality import _null_flag, _rx, _special
from revlens.plans.registry import register
from revlens.plans.sqlgen import with_views
from revlens.sources.files import shared_scratch
from revlens.streaming.flags import stream_flags_to_table

_SPLIT = "[\\s.,;:?()\\[\\]{}\"']+"


@register("stream_flags", sql=with_views(
    f"""SELECT id, {_null_flag(['id', 'content'])} AS dqa_has_null_values,
       {_rx('content', T.EMOJI_CLASS)} AS dqa_has_emojis, {_special('content')} AS dqa_has_excessive_special_chars,
       coalesce(regexp_matches(lower(content), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(w.replace('*', chr(92) + '*') for w in L.PROFANITY)})([^\\p{{L}}\\p{{N}}_]|$)'), false) AS dqa_has_profanity,
       {_rx('content', K.EMAIL_PATTERN)} AS dqa_contains_email, {_rx('content', K.URL_PATTERN)} AS dqa_contains_url,
       {_rx('content', K.PHONE_PATTERN)} AS dqa_contains_phone_number FROM d""",
    d="SELECT cast(doc_id AS VARCHAR) AS id, text AS content FROM documents"))
def stream_flags(spark, sf):
    """documents streamed file by file (availableNow) through the row checks."""
    base = shared_scratch(spark, "stream")
    # a glob: the file source watches a folder pattern, not a single file
    out = stream_flags_to_table(spark, os.path.join(sf, "documents.parque[t]"),
                                "doc_id bigint, text string, lang string, source string, n_chars bigint", base,
                                text_column="text", key="doc_id")
    return out.select(F.col("doc_id").cast("string").alias("id"), *[c for c in out.columns if c.startswith("dqa_")])
