"""A corpus pipeline: language ID, near-dedup, substring dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of ``documents``.  Repeated rows of a document count as copies
of it; rows with a null id or with one id and different texts are documents of
their own.  Very long texts are worked on in pieces; an empty table gives an empty
result in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, langid, mixing, near_copies, word_repeats
from palisade.llm.common import prepared, shared_folder, table, word_count
from palisade.llm.queries import tokenizer_file

#: Arrow batches of the stages: executors hold a few of them, unpacked and packed, for each core.
BATCH = "2m"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``documents``, with another text and its length."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles from the labelled documents; ``lang`` becomes the language found.

    Documents without a letter (or with a null text) have no language and go.
    """
    prepared(spark, BATCH)
    known = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    found = langid.identify(docs, known, keep=("doc_id", "text", "source", "n_chars"))
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash candidates, linked by a Jaccard similarity of their five-word shingles of 0.8 or more: the smallest id stays."""
    prepared(spark, BATCH)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("mark"))  # null ids come last
    docs = docs.withColumn("row", row)
    groups = near_copies.near_copies(docs, "row")
    kept = groups.where(F.col("row") == F.col("component_id")).select(F.col("row").alias("at"))
    return docs.join(kept, F.col("row") == F.col("at"), "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"])


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that start in an earlier document go; documents left without a word go.

    Windows are edges of a de Bruijn graph, joins compact its nonbranching paths, and a
    path's spans are verified by their source coordinates (``de_bruijn``).  Texts that lose nothing stay as they are.
    """
    prepared(spark, BATCH)
    cleaned = word_repeats.remove_repeated_words(docs, method="de_bruijn", keep=("lang", "source"), as_they_are=True)
    return with_text(cleaned.where("n_removed = 0 or n_removed < n_words"), "kept")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (none, once or twice)."""
    prepared(spark, BATCH)
    mark = F.hex(F.xxhash64("text", "lang", "source"))
    docs = docs.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), mark))
    sized = docs.select("row", word_count(F.col("text")).alias("size"), F.array("source").alias("sources"))
    taken = mixing.mix_sources(sized, "row", "size", "sources").where("repeats > 0").groupBy("row").agg(F.sum("repeats").alias("repeats"))
    again = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    return docs.dropDuplicates(["row"]).join(taken, "row").withColumn("time", again).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, a row for each time a text is taken."""
    prepared(spark, BATCH)
    return bpe.round_trip(docs, tokenizer_file(), cache=30_000)  # small: workers of the other stages share the memory


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL can express none of language profiles, similarity of near copies and BPE; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
