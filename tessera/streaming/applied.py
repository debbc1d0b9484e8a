"""Batches of a stream applied to a versioned table, each exactly once, under the configuration of its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import kept, released, removed, scratch
from tessera.sources.tables import table
from tessera.sources.versions import Conflict, VersionedTable
from tessera.streaming.events import stream

SETTINGS = "user_id long, ts timestamp, event_id long, config int"


def applied(changes: DataFrame, batch: int, name: str, settings: VersionedTable, config: VersionedTable) -> bool:
    """Apply a batch of changes(user_id, ts, event_id, event_type): of each user the newest, and only if it is strictly newer than
    what settings(user_id, ts, event_id, config) hold. Types that config(event_type, enabled) doesn't enable at this time are left out.
    False, and nothing done, if the table holds this batch or a later one of the stream already: its number is committed with
    its rows, so a batch that is run again changes nothing. Where somebody else commits first, it is applied to what they left."""
    if settings.marks().get(name, -1) >= batch:
        return False
    version = config.version()
    enabled = config.read(version).where("enabled").select("event_type")
    rows = changes.join(F.broadcast(enabled), "event_type", "left_semi")  # one row a type
    newest = rows.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id"), F.struct("ts", -F.col("event_id"))).alias("new"))  # the first of equally new ones
    newest = kept(newest, "newest")

    def change(old: DataFrame) -> DataFrame:
        j = old.withColumn("had", F.lit(True)).join(newest, "user_id", "full")
        better = F.col("had").isNull() | F.coalesce(F.col("new.ts") > F.col("ts"), F.lit(False))
        pick = lambda new, was: F.when(better, new).otherwise(was)
        return j.select("user_id", pick(F.col("new.ts"), F.col("ts")).alias("ts"), pick(F.col("new.event_id"), F.col("event_id")).alias("event_id"), pick(F.lit(version), F.col("config")).cast("int").alias("config"))

    while True:
        try:
            settings.merge(newest.select("user_id"), change, settings.version(), (name, batch))
            released(newest)
            return True
        except Conflict:
            continue


def settled(changes: DataFrame, name: str, settings: VersionedTable, config: VersionedTable, checkpoint: str) -> None:
    """Run a stream of changes until its source is read."""
    changes.writeStream.foreachBatch(lambda df, batch: applied(df, batch, name, settings, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def st3_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's setting after all events but errors, which the configuration leaves out: the time and event that set it last, under
    which version of the configuration."""
    settings, config = VersionedTable(spark, scratch(spark, "settings"), "user_id"), VersionedTable(spark, scratch(spark, "config"), "event_type", parts=1)
    settings.create(spark.createDataFrame([], SETTINGS))
    types = table(spark, sf_dir, "events").select("event_type").where("event_type is not null").distinct()
    config.create(types.withColumn("enabled", F.lit(True)))
    config.update(F.col("event_type") == "error", {"enabled": F.lit(False)})
    checkpoint = scratch(spark, "state")
    changes = stream(spark, sf_dir).where("user_id is not null").select("user_id", "ts", "event_id", "event_type")
    settled(changes, "events", settings, config, checkpoint)
    out = kept(settings.read(), "settings")
    settings.drop()
    config.drop()
    removed(spark, checkpoint)
    return out


QUERIES = {"st3_settings": st3_settings}

ORACLES = {
    "st3_settings": "with e as (select * from events where user_id is not null and event_type <> 'error'), m as (select user_id, max(ts) ts from e group by 1) select user_id, ts, min(event_id) event_id, 2 config from e join m using (user_id, ts) group by all",
}
