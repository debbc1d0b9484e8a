"""The folder that driver and executors share, and tables kept there for a while."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch while a table is written: 10 000, Spark's default, of whole texts take tens of megabytes in the JVM and
#: several times that in the worker of each task.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below spark.checkpoint.dir; below a folder of our own where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete what stands at these paths, through the file system that they name."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, name: str, batch: int = BATCH_ROWS) -> DataFrame:
    """df written and read back: later steps read the table, and a lost executor loses none of it."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(min(int(before), batch) if int(before) > 0 else batch))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_CONF, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._kept_at = path
    return back


def released(*frames: DataFrame | None) -> None:
    """Delete tables that kept() wrote and that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            removed(df.sparkSession, path)
