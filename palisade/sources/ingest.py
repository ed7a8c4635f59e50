"""Log lines from files, streams and single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decoded, sanitized, stripped
from ..operators.windows import settled
from ..options import PipelineOptions


def clean_lines(lines: DataFrame, options: PipelineOptions = PipelineOptions()) -> DataFrame:
    """``value`` decoded and sanitised; too long and blank lines go.  The same for batches and streams."""
    raw = F.col("value").cast("binary")
    kept = lines.where(F.octet_length(raw) + 1 <= options.max_line_length).withColumn("value", sanitized(decoded(raw)))
    # Settled: else the parsers' many columns would each carry the cleaning, and planning would never end.
    return settled(kept.where(stripped(F.col("value")) != "") if options.skip_empty_lines else kept)


def read_lines(spark: SparkSession, path: str, options: PipelineOptions = PipelineOptions()) -> DataFrame:
    """Lines of text files (gz by suffix): value, source.  Files are split; order is not kept."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"))
    return clean_lines(lines, options)


#: Up to so many file ranges, their table is sent to all tasks (about 100 MB); beyond it the join is Spark's to choose.
RANGES = 1_000_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, source, line_number (from 1; all physical lines count): large files are read and numbered by many tasks.

    Spark reads a file in byte ranges.  One pass counts the lines of each range;
    the counts are summed up by file, and a second pass numbers the lines: those of
    a range are in order in their task, so a line's number is that of its range's
    first line and its distance from it.  Only the counts are shuffled.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    where = [F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_start")]
    lines = raw.select("value", *where, F.monotonically_increasing_id().alias("_row"))
    ranges = lines.groupBy("source", "_start").agg(F.count("*").alias("_lines"), F.min("_row").alias("_first"))
    before = Window.partitionBy("source").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)  # ranges of one file
    placed = ranges.select("source", "_start", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    size = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() + len(raw.inputFiles()) <= RANGES
    joined = lines.join(F.broadcast(placed) if few else placed, ["source", "_start"])
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return joined.select(F.regexp_replace("value", "\r$", "").alias("value"), "source", number.alias("line_number"))


def read_numbered_lines(spark: SparkSession, path: str, options: PipelineOptions = PipelineOptions()) -> DataFrame:
    """As read_lines, with line_number (from 1, all physical lines count; see numbered_lines)."""
    return clean_lines(numbered_lines(spark, path), options)


def stream_lines(spark: SparkSession, path: str, options: PipelineOptions = PipelineOptions(), files_per_batch: int = 100) -> DataFrame:
    return clean_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path), options)


def single_text(spark: SparkSession, text: str, tenant: str = "default") -> DataFrame:
    """One line, as an API would hand it in."""
    return spark.createDataFrame([(text, tenant)], "value string, tenant string")


def acceptable(texts: DataFrame, column: str = "value", longest: int = 10_000) -> DataFrame:
    """Adds ``refused``: why a service would not take the text (too long, empty, unprintable), else null.

    A null text is empty; printable is anything but controls, surrogates, unassigned and separators other than the blank.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    odd = text.rlike(r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]")
    reason = F.when(F.length(text) > longest, "too long").when(stripped(text) == "", "empty").when(odd, "unprintable")
    return texts.withColumn("refused", reason)
