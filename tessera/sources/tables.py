"""Sources: the given tables and the views that queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: an e-mail address. One in its text makes a document wait for approval.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key where it is read in fewer pieces than tasks can run: Spark doesn't split a file's row groups, and the
    texts of one would all fall to one task. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work on their texts."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their ingestion status; the scan reads only the columns that a query goes on to use."""
    status = F.when(F.contains("text", F.lit("@")) & F.col("text").rlike(EMAIL), "quarantined").otherwise("active")
    return texts(spark, sf_dir).withColumn("ingestion_status", status)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers: a user turn with the assistant turn after it."""
    t = table(spark, sf_dir, "conversations")
    ask = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answer = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return ask.join(answer, ["conv_id", "turn"])


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples (feature, ts, event_id, duration_ms, k, fallback): every fifth value of k marks a fallback."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_type").alias("feature"), "ts", "event_id", "user_id", F.col("value").alias("duration_ms"), k.alias("k"), (k % 5 == 0).alias("fallback"))
