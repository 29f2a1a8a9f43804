"""The registered queries of this package: ``opN_<name>`` and ``pipeline``,
each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import read
from llm.hard_negatives import NEGATIVES_SQL
from llm.merkle import MANIFEST_SQL
from llm.mixing import MIX_SQL, POSITION_SQL
from llm.warc import ARCHIVE_SQL


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from llm.html_extract import main_text
    return main_text(read(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy token counts of every document."""
    from llm.tokens import token_counts
    return token_counts(read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base spans, all spans."""
    from llm.secrets import described, scan
    rows = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), out="found")
    of = lambda rank: F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")
    base = described(F.filter("found", lambda s: s["rank"] < 3))
    return rows.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                       F.sha2(base.cast("binary"), 256).alias("base_sha256"), described(F.col("found")).alias("spans"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    from llm.embed_dedup import near_duplicates
    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    from llm.mixing import mix
    return (mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
            .select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 6).alias("position")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced by pseudonyms."""
    from llm.pii import pseudonymise
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    from llm.decontam import contaminated
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 90 % of their three-word shingles."""
    from llm.ngram_join import join
    return join(read(spark, sf_dir, "documents"), k=3, percent=90).drop("h")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    from llm.warc import archive
    return archive(read(spark, sf_dir, "pages")).drop("url", "file")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from llm.langid import identify
    return identify(read(spark, sf_dir, "documents"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the text that they decode to."""
    from llm.bpe import n_tokens, round_trip
    rows = round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, verified against planted changes."""
    from llm.merkle import manifest, tampering
    docs = read(spark, sf_dir, "documents")
    changed, when = tampering(docs)
    return manifest(docs, changed=changed, when=when).withColumnRenamed("folded", "folded_root")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding and its five best positives."""
    from llm.hard_negatives import mine
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(rows["vec_id"] % 7 == 0, (rows["label"] + 1) % 10).otherwise(rows["label"])
    return mine(rows, F.col("id") % 100 == 0, relabel=moved)


QUERIES = {"op1_html_text": op1_html_text, "op4_embedding_dedup": op4_embedding_dedup, "op8_ngram_jaccard": op8_ngram_jaccard, "op6_pii": op6_pii, "op7_decontamination": op7_decontamination, "op3_secret_scan": op3_secret_scan, "op5_mixing": op5_mixing,
           "op2_token_counts": op2_token_counts, "op9_warc": op9_warc, "op10_language_id": op10_language_id,
           "op11_bpe_codec": op11_bpe_codec, "op12_merkle_manifest": op12_merkle_manifest,
           "op13_hard_negatives": op13_hard_negatives}
ORACLES: dict[str, str] = {
    "op5_mixing": MIX_SQL.format(docs="documents", cols="doc_id, cast(size AS BIGINT) AS size, source_size, round(target, 6) AS target, "
                                 f"cast(size * copies AS BIGINT) AS taken, round({POSITION_SQL}, 6) AS position"),
    "op9_warc": ARCHIVE_SQL,
    "op12_merkle_manifest": MANIFEST_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
