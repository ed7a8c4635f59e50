"""The registered queries of the corpus operators: thin calls with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_repeats, centroids, chat, hard_negatives, langid, metric_tree, mixing, pii, quality, simhash, url_filter, word_repeats
from .common import table, word_count

#: The contract's rules; the globs are the default policy for other hosts.
URL_RULES = (
    url_filter.HostRule("block", "net", "/"),
    url_filter.HostRule("allow", "example.net", "/en/"),
    url_filter.HostRule("block", "example.com", "/de/"),
    url_filter.HostRule("allow", "org", "/fr/"),
)
URL_GLOBS = (
    url_filter.Glob("block", "*cheap-pills*/**"),
    url_filter.Glob("block", "*casino*/**"),
    url_filter.Glob("block", "**/*.exe"),
)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("size"), F.array("source").alias("sources"))
    mixed = mixing.mix_sources(docs, "doc_id", "size", "sources")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    held_out = F.coalesce(fold == 0, F.lit(False))
    known = docs.where((fold != 0) & F.col("lang").isNotNull()).select("text", "lang")
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), known, keep=("doc_id", "held_out"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_snapshots(table(spark, sf_dir, "conversations"))


def op5_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_repeats.remove_repeated_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_repeats.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an id is divisible by 7 the label is wrong on purpose."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_langid, op4_chat, op5_word_repeats, op6_top_k, op7_url_filter, op8_bpe, op9_byte_repeats, op10_quality, op11_hard_negatives, op12_centroids, op13_personal_data)}
