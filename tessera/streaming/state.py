"""Keyed state over the event stream: a window of the last samples, executions that time out, entries that expire."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.analytics import _RANK, _TELEMETRY, WINDOW
from tessera.streaming.events import drained, stream

#: Milliseconds until an execution is given up; seconds that a cached result lives.
GIVEN_UP_MS, TTL_SECONDS = 300_000, 900


def _latest(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["ts", "event_id"], ascending=False).head(WINDOW)


def _latest_of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, pd.DataFrame] = {}
    seen: Counter[str] = Counter()
    for frame in frames:
        for feature, rows in frame.groupby("feature"):
            seen[feature] += len(rows)
            held[feature] = _latest(pd.concat([held[feature], rows]) if feature in held else rows)
    for feature, rows in held.items():
        yield rows.assign(seen=[seen[feature]] + [0] * (len(rows) - 1))


def _rolling(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ts, ids, values, seen = state.get if state.exists else ([], [], [], 0)
    held = pd.DataFrame({"ts": pd.Series(list(ts), dtype="int64"), "event_id": pd.Series(list(ids), dtype="int64"), "value": pd.Series(list(values), dtype="float64")})
    for frame in frames:
        seen += int(frame["seen"].sum())
        held = _latest(pd.concat([held, frame[["ts", "event_id", "value"]]]) if len(held) else frame[["ts", "event_id", "value"]])
    state.update((held["ts"].tolist(), held["event_id"].tolist(), held["value"].tolist(), seen))
    ranked = held["value"].dropna().sort_values().tolist()
    at = lambda share: ranked[min(len(ranked) - 1, int(len(ranked) * share))] if ranked else None
    yield pd.DataFrame({"feature": [key[0]], "seen": [seen], "n": [len(held)], "p50": [at(0.5)], "p95": [at(0.95)]})


def st1_rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the last WINDOW samples of each feature, and how many came in all. A task passes on WINDOW samples of a
    feature at most, so that a feature with a third of all samples doesn't meet in one task; a key holds as many."""
    e = stream(spark, sf_dir).where("event_type is not null").select(F.col("event_type").alias("feature"), F.unix_micros("ts").alias("ts"), "event_id", "value")
    few = e.mapInPandas(_latest_of_task, "feature string, ts long, event_id long, value double, seen long")
    told = few.groupBy("feature").applyInPandasWithState(_rolling, "feature string, seen long, n long, p50 double, p95 double", "ts array<long>, ids array<long>, vals array<double>, seen long", "append", GroupStateTimeout.NoTimeout)
    last = drained(told).groupBy("feature").agg(F.max_by(F.struct("seen", "n", "p50", "p95"), "seen").alias("s"))
    return last.select("feature", "s.*")


def _executions(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    opened = list(zip(*state.get, strict=True)) if state.exists else []
    out = []
    if not state.hasTimedOut:
        for ts, event_id, kind in pd.concat(list(frames)).sort_values(["ts", "event_id"])[["ts", "event_id", "event_type"]].itertuples(index=False):
            if kind == "click":
                opened.append((int(event_id), int(ts)))
            else:
                out += [(e, "executed" if ts - t < GIVEN_UP_MS else "failed") for e, t in opened]
                opened = []
    mark = state.getCurrentWatermarkMs()
    out += [(e, "failed") for e, t in opened if t + GIVEN_UP_MS < mark]
    opened = [(e, t) for e, t in opened if t + GIVEN_UP_MS >= mark]
    if opened:
        state.update(([e for e, _ in opened], [t for _, t in opened]))
        state.setTimeoutTimestamp(min(t for _, t in opened) + GIVEN_UP_MS)
    else:
        state.remove()
    yield pd.DataFrame({"event_id": pd.Series([e for e, _ in out], dtype="int64"), "state": pd.Series([s for _, s in out], dtype=object)})


def st4_stale_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks start an execution that the user's next purchase ends: executed within GIVEN_UP_MS, failed later, or when a timer
    finds that the watermark (10 minutes) has passed that time. Those still running aren't shown."""
    e = stream(spark, sf_dir).where("event_type in ('click', 'purchase')").withWatermark("ts", "10 minutes")
    e = e.select("user_id", "event_id", "event_type", F.col("ts").alias("at"), F.unix_millis("ts").alias("ts"))
    return drained(e.groupBy("user_id").applyInPandasWithState(_executions, "event_id long, state string", "ids array<long>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout))


def st5_ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached results by key (type and k): from their first write until TTL_SECONDS after the last one before they expired; told
    when they have."""
    key = F.concat_ws(":", "event_type", F.get_json_object("props", "$.k"))
    lives = stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", f"{TTL_SECONDS} seconds").alias("w"), key.alias("key")).agg(F.count("*").alias("writes"))
    return drained(lives.select("key", F.col("w.start").alias("written"), F.col("w.end").alias("expired"), "writes"))


QUERIES = {f.__name__: f for f in (st1_rolling_window, st4_stale_timer, st5_ttl_expiry)}

ORACLES = {
    "st1_rolling_window": f"with {_TELEMETRY}, r as (select * from (select *, row_number() over (partition by feature order by ts desc, event_id desc) n from t) where n <= 1000) select feature, any_value(seen) seen, count(*) n, {_RANK.format(0.5)} p50, {_RANK.format(0.95)} p95 from r join (select feature, count(*) seen from t group by 1) using (feature) group by feature",
    "st4_stale_timer": "with e as (select * from events where event_type in ('click', 'purchase')), c as (select event_id, event_type, ts, min(case when event_type = 'purchase' then ts end) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) p from e) select event_id, case when epoch_ms(p) - epoch_ms(ts) < 300000 then 'executed' else 'failed' end as state from c where event_type = 'click' and (p is not null or epoch_ms(ts) + 300000 < (select max(epoch_ms(ts)) from e) - 600000)",
    "st5_ttl_expiry": "with e as (select concat_ws(':', event_type, props->>'$.k') as key, ts from events), f as (select *, coalesce(ts - lag(ts) over (partition by key order by ts) >= interval 900 seconds, true)::int as fresh from e), g as (select *, sum(fresh) over (partition by key order by ts) k from f), s as (select key, min(ts) as written, max(ts) + interval 900 seconds as expired, count(*) writes from g group by key, k) select * from s where expired <= (select max(ts) from events) - interval 10 minutes",
}
