"""Structured Streaming over the event table: event-time windows, rolling counters, an admission limit.

Each query reads the table as a stream, as far as it goes (availableNow), writes to the shared folder and returns what was
written. Left running on a growing folder the same plans go on from their checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.shared import kept, removed, scratch
from tessera.sources.tables import table

#: Admissions of a user within the seconds before.
LIMIT, SECONDS = 3, 86_400


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files: a folder of files, or one file of the data folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        rows = source.parquet(f"{sf_dir}/events.parquet")
    else:
        rows = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream until its source is read; the rows it gave."""
    spark = df.sparkSession
    out = scratch(spark, "stream")
    df.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rows = kept(spark.read.schema(df.schema).parquet(f"{out}/rows"), "rows")
    removed(spark, out)
    return rows


def st_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of each type in windows of 6 hours that the watermark (10 minutes) has closed."""
    windows = stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "6 hours").alias("w"), "event_type")
    sums = windows.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return drained(sums.select(F.col("w.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total")))


def st_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of users: events less than 12 hours apart."""
    sessions = stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return drained(sessions.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("until"), "n"))


def admitted(times: list[float], held: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Sliding-window admission in time order: hits older than the window go, a hit is denied at the limit, denied hits
    don't count."""
    out = []
    for t in times:
        held = [h for h in held if h >= t - seconds]
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


def _limit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    held = list(state.get[0]) if state.exists else []
    seconds = rows["ts"].astype("datetime64[ns]").astype("int64") / 1e9
    ok, held = admitted(seconds.tolist(), held, LIMIT, SECONDS)
    state.update((held,))
    yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "admitted": ok})


def st2_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event of a user is admitted: LIMIT within SECONDS. What a key holds is at most LIMIT times."""
    keyed = stream(spark, sf_dir).select("user_id", "event_id", "ts").groupBy("user_id")
    out = keyed.applyInPandasWithState(_limit, "user_id long, event_id long, admitted boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)
    return drained(out)


def _newer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("event_id")
    mark = state.get[0] if state.exists else -(1 << 62)
    times = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
    marks = np.maximum.accumulate(np.append(mark, times))
    state.update((int(marks[-1]),))
    yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "applied": times > marks[:-1]})


def st3_high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each change (event, in order of arrival) of a user's setting is applied: only if it is strictly newer than all
    before. What a key holds is one time."""
    keyed = stream(spark, sf_dir).select("user_id", "event_id", "ts").groupBy("user_id")
    return drained(keyed.applyInPandasWithState(_newer, "user_id long, event_id long, applied boolean", "mark long", "append", GroupStateTimeout.NoTimeout))


QUERIES = {f.__name__: f for f in (st_tumbling, st_sessions, st2_rate_limit, st3_high_water_mark)}

ORACLES = {
    "st_tumbling": "with e as (select *, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') s from events) select s as start, event_type, count(*) n, sum(value::decimal(18,2))::double total from e where s + interval 6 hours <= (select max(ts) from events) - interval 10 minutes group by all",
    "st_sessions": "with e as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 12 hours, true)::int as fresh from events), g as (select *, sum(fresh) over (partition by user_id order by ts) k from e), s as (select user_id, min(ts) as start, max(ts) + interval 12 hours as until, count(*) n from g group by user_id, k) select * from s where until <= (select max(ts) from events) - interval 10 minutes",
    "st3_high_water_mark": "select user_id, event_id, coalesce(ts > max(ts) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), true) applied from events",
}
