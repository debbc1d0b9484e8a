"""Files as rows: what can't be read or understood is a row with its reason, not an error of the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of files that are read; words of a chunk.
KINDS = ["txt", "md", "html"]
CHUNK_WORDS = 200


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below path, read by executors, a file a row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def ingested(found: DataFrame, quarantines: Column | None = None) -> DataFrame:
    """found(path, content, ...) with text, status, reason and chunks. Status: failed (reason: unsupported, not_utf8, empty; no
    text, no chunks), quarantined where `quarantines` holds for `text`, else active. Null content counts as empty."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    read = F.coalesce(F.col("content"), F.lit(b""))
    valid = F.is_valid_utf8(read.cast("string"))
    reason = F.when(~kind.isin(KINDS), "unsupported").when(~valid, "not_utf8").when(F.trim(F.regexp_replace(read.cast("string"), "\\s+", " ")) == "", "empty")
    told = found.withColumn("reason", reason).withColumn("text", F.when(F.col("reason").isNull(), F.col("content").cast("string"))).drop("content")
    status = F.when(F.col("reason").isNotNull(), "failed").when(F.coalesce(quarantines if quarantines is not None else F.lit(False), F.lit(False)), "quarantined").otherwise("active")
    chunks = F.when(F.col("text").isNull(), 0).otherwise(F.ceil(F.size(F.split("text", " ")) / CHUNK_WORDS)).cast("long")
    return told.withColumns({"status": status, "chunks": chunks})
