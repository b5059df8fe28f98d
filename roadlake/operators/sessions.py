"""Session tables: pickers, lifecycle, live feed (T1-T6, ST8, W18, W19 inputs)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.plans import segmented as sg


def recent_sessions(sessions: DataFrame, n: int = 50) -> DataFrame:
    """Newest first; the limit is the picker's feature."""
    if not 1 <= n <= 200:
        raise ValueError("limit must lie in 1..200")
    return sessions.orderBy(F.desc("started_at")).limit(n)


def latest_rows(rows: DataFrame, n: int = 500, time: str = "time", tie: str = "event_id") -> DataFrame:
    """The newest rows; planned as a top-k, not a full sort."""
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(n)


def accel_points(rows: DataFrame, n: int = 2000, time: str = "time", tie: str = "event_id") -> DataFrame:
    """The first accelerometer points."""
    return rows.orderBy(time, tie).limit(n).select("accel_x", "accel_y")


def open_sessions(sessions: DataFrame) -> DataFrame:
    """T4."""
    return sessions.where(F.col("ended_at").isNull()).orderBy("started_at")


def session_ids(sessions: DataFrame) -> DataFrame:
    """T5."""
    return sessions.orderBy(F.desc("started_at")).select("session_id")


def fold_sessions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST8: start/end log -> sessions and rejected events.

    A session begins at its first start and ends at its first end after that.
    An end of an unknown session and a second end are rejected, as is a second
    start.  ``events`` has session_id, action ('start'/'end'), at, event_id.
    """
    first_start = F.min(F.when(F.col("action") == "start", F.struct("at", "event_id")))
    starts = events.groupBy("session_id").agg(first_start.alias("s"))
    e = events.join(starts, "session_id")
    after = (F.col("action") == "end") & (F.struct("at", "event_id") > F.col("s"))
    ends = e.groupBy("session_id").agg(F.first("s", ignorenulls=True).alias("s"), F.min(F.when(after, F.struct("at", "event_id"))).alias("e"))
    sessions = ends.where(F.col("s").isNotNull()).select(
        "session_id", F.col("s.at").alias("started_at"), F.col("e.at").alias("ended_at"))
    r = events.join(ends, "session_id")
    unknown = F.col("s").isNull() | (F.struct("at", "event_id") < F.col("s"))
    reason = F.when(unknown & (F.col("action") == "end"), "session not found").when(
        (F.col("action") == "end") & (F.col("event_id") != F.col("e.event_id")), "session already ended").when(
        (F.col("action") == "start") & (F.col("event_id") != F.col("s.event_id")), "session already exists")
    rejects = r.select(*events.columns, reason.alias("reason")).where(F.col("reason").isNotNull())
    return sessions, rejects


def feed_health(df: DataFrame, keys: list[str], arrival: str, sent: str, n: int = 20, tie: str = "event_id",
                segment_s: float | sg.Adaptive = sg.Adaptive(60)) -> DataFrame:
    """Mean interval of the last ``n`` messages and latency, per message.

    The arrival ``n - 1`` messages back lies in the row's own segment or among
    the last ``n - 1`` arrivals before it, which a segment gets from at most as
    many earlier segments.
    """
    keep, us = n - 1, F.unix_micros(arrival)
    d = sg.with_segment(df, arrival, segment_s, keys)
    here = Window.partitionBy(*keys, sg.SEG).orderBy(arrival, tie)
    back = Window.partitionBy(*keys, sg.SEG).orderBy(F.desc("_us"))
    slim = d.select(*keys, sg.SEG, us.alias("_us"))
    last = slim.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= keep).groupBy(*keys, sg.SEG).agg(F.array_sort(F.collect_list("_us")).alias("_l"))
    before = Window.partitionBy(*keys).orderBy(sg.SEG).rowsBetween(-keep, -1)
    past = F.flatten(F.collect_list("_l").over(before))
    carry = last.select(*keys, sg.SEG, F.when(F.size(past) > keep, F.slice(past, -keep, keep)).otherwise(past).alias("_past"))
    d = d.select("*", (F.row_number().over(here) - 1).alias("_i"), F.lag(us, keep).over(here).alias("_then"), F.min(us).over(here).alias("_first"))
    d = d.join(carry, [*keys, sg.SEG], "left")
    have = F.coalesce(F.size("_past"), F.lit(0))
    miss = F.lit(keep) - F.col("_i")  # how many of the earlier arrivals must come from before
    used = F.least(miss, have)
    then = F.when(F.col("_then").isNotNull(), F.col("_then")).when(used > 0, F.get("_past", have - used)).otherwise(F.col("_first"))
    span = F.when(F.col("_then").isNotNull(), F.lit(keep)).otherwise(F.col("_i") + F.greatest(used, F.lit(0)))
    return d.select(*df.columns, F.when(span >= 1, (us - then) / 1000.0 / span).alias("avg_interval_ms"), ((us - F.unix_micros(sent)) / 1000.0).alias("latency_ms"))


def last_message_age(df: DataFrame, keys: list[str], now: dt.datetime, arrival: str = "time") -> DataFrame:
    last = df.groupBy(*keys).agg(F.max(arrival).alias("last_at"))
    return last.withColumn("age_ms", (F.unix_micros(F.lit(now)) - F.unix_micros("last_at")) / 1000.0)
