"""Sources of input documents: tables, folders of files, JSON lines; and the streams of the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.extract.common import TIME_CAP
from textrill.extract.dispatch import extract_files, extracted_flag
from textrill.functions.text import decode_base64
from textrill.schemas import CHANGES

CORPUS = "id string, title string, body string"
BROKEN_TRANSPORT = "the provider flagged the content as base64 but it does not decode: a transport bug on the provider's side"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A change feed or document table in Parquet."""
    return spark.read.parquet(path)


def read_files(spark: SparkSession, path: str, budget: int, seconds: float | None = TIME_CAP) -> DataFrame:
    """Files of a folder with their extracted text: path, modified, text, cause, message."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return extract_files(files.select("path", F.unix_timestamp("modificationTime").alias("modified"), "content"), "path", "content", budget, seconds).drop("content")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, plain or gzip, with id, title and body."""
    return spark.read.schema(CORPUS).json(path)


def transport(content: Column, encoded: Column) -> tuple[Column, Column]:
    """(bytes, broken): a document's bytes, base64 undone strictly where it is flagged."""
    raw = F.when(F.coalesce(encoded, F.lit(False)), decode_base64(content)).otherwise(F.encode(content, "UTF-8"))
    return raw, F.coalesce(encoded, F.lit(False)) & content.isNotNull() & decode_base64(content).isNull()


def with_content(documents: DataFrame, budget: int, seconds: float | None = TIME_CAP) -> DataFrame:
    """Input documents (title, content, content_encoded, ...) with extracted, text, cause, message and severity.

    Columns ``extracted``, ``cause`` and ``message`` that come with a document (its text was
    extracted before) are kept as they are. Broken transport gives no text, severity 3 and no cause.
    """
    raw, broken = transport(F.col("content"), F.col("content_encoded"))
    rows = documents.withColumn("_raw", raw).withColumn("_broken", broken)
    has_marker = "extracted" in documents.columns
    marked = rows.filter("extracted IS NOT NULL") if has_marker else None
    fresh = rows.filter("extracted IS NULL") if has_marker else rows
    keep = [c for c in documents.columns if c not in ("extracted", "cause", "message", "text", "severity")]
    done = extract_files(fresh.select(*keep, "_raw", "_broken"), "title", "_raw", budget, seconds)
    out = done.select(
        *keep,
        (extracted_flag(F.col("text"), F.col("cause")) & ~F.col("_broken")).alias("extracted"),
        "text",
        F.when(~F.col("_broken"), F.col("cause")).alias("cause"),
        F.when(F.col("_broken"), BROKEN_TRANSPORT).otherwise(F.col("message")).alias("message"),
        F.when(F.col("_broken"), 3).when(F.col("cause").isNotNull(), 1).otherwise(0).alias("severity"),
    )
    if marked is None:
        return out
    given = [F.col(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in ("cause", "message")]
    return out.unionByName(marked.select(*keep, "extracted", F.col("content").alias("text"), *given, F.when(F.col("cause").isNotNull() if "cause" in documents.columns else F.lit(False), 1).otherwise(0).alias("severity")))


def stream_changes(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A change feed as a stream of Parquet files."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path)
