"""Registered queries of the training-data operators: thin calls with production
parameters over whole tables, and their SQL where SQL can state the result."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import mine_phrases
from .common import crc_of_id
from .decontaminate import decontaminate
from .jaccard import jaccard_components
from .langid import identify_languages
from .licenses import scan_licenses
from .lm import score_documents
from .manifest import ABC, abc, merkle_manifest
from .pieces import encode_documents
from .sharding import shard_documents
from .simhash import simhash_components
from .topk import top_k
from .urls import Rule, filter_urls
from .warc_zip import round_trip

#: Shards of op7.
SHARDS = 24
#: Rules of op10.
URL_RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
             Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def piece_vocabulary() -> str:
    """Vocabulary file of op5, a path that every executor can open: PIECE_VOCABULARY, or the installed package's."""
    if os.environ.get("PIECE_VOCABULARY"):
        return os.environ["PIECE_VOCABULARY"]
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _remainder(mod: int, of: int) -> Column:
    return F.pmod(crc_of_id("doc_id"), F.lit(mod)) == of


def op1_lm_score(spark: SparkSession, d: str) -> DataFrame:
    """Log-bilinear and unigram scores of all documents; four fifths of them are learned from."""
    return score_documents(_table(spark, d, "documents"), held_out=_remainder(5, 1))


def op2_topk_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best rows for every row whose vec_id is divisible by 20."""
    return top_k(_table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have Jaccard similarity of 0.85 or more."""
    return jaccard_components(_table(spark, d, "documents"), words=4, threshold=(85, 100)).select(
        "doc_id", "n_shingles", "component_id")


def op4_license_scan(spark: SparkSession, d: str) -> DataFrame:
    """Known licences of whole documents and of their lines."""
    return scan_licenses(_table(spark, d, "documents"))


def op5_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all documents with an end id, and the text decoded from them, as digests."""
    return encode_documents(_table(spark, d, "documents"), piece_vocabulary(), keep_ids=False)


def op6_warc_zip(spark: SparkSession, d: str) -> DataFrame:
    """All pages written as WARC records in ZIP archives and read back."""
    return round_trip(_table(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bin_packing(spark: SparkSession, d: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes, equal texts together."""
    plan = shard_documents(_table(spark, d, "documents"), shards=SHARDS)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op8_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Predicted language of all documents; three quarters of them are learned from."""
    return identify_languages(_table(spark, d, "documents"), held_out=_remainder(4, 2)).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark windows of 13 words in all documents."""
    got = decontaminate(_table(spark, d, "documents"), _table(spark, d, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of every page by rule or model."""
    return filter_urls(_table(spark, d, "pages"), URL_RULES)


def op11_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Merkle leaves, roots and proofs of all documents, checked against texts of which a third was lower-cased since."""
    return merkle_manifest(_table(spark, d, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang",
                           changed={"text": F.translate("text", ABC, abc)},
                           where=F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)))


def op12_collocations(spark: SparkSession, d: str) -> DataFrame:
    """The 2,000 best phrases of 2 to 5 words of each language, of those with 100 places or more."""
    return mine_phrases(_table(spark, d, "documents"), least=100, top=2000)


def op13_simhash(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of all documents over 3-word shingles, and components of those within two bits."""
    return simhash_components(_table(spark, d, "documents"), words=3)


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_topk_search, op3_ngram_jaccard, op4_license_scan, op5_sentencepiece,
                                   op6_warc_zip, op7_bin_packing, op8_language_id, op9_decontamination, op10_url_filter,
                                   op11_merkle_manifest, op12_collocations, op13_simhash)}

from .oracle import ORACLE  # noqa: E402,F401  (their SQL)
