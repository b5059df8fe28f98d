"""Live output: typed JSON messages and open-session snapshots (K6, ST7, ST9)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.operators.summary import summarize
from roadlake.plans.intervals import session_rows

_OPTS = {"ignoreNullFields": "false"}


def live_messages(rows: DataFrame, kind: str = "telemetry") -> DataFrame:
    """K6: each row as ``{"type": ..., "data": {...}}`` with explicit nulls."""
    body = F.struct(*[F.col(c) for c in rows.columns])
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), body.alias("data")), _OPTS).alias("value"))


def replay(rows: DataFrame, t0: dt.datetime, speed: float = 1.0, time: str = "time") -> DataFrame:
    """K7: stored rows split back into two payloads, re-stamped to play time.

    The start of the recording is a one-row aggregate, so no global window is
    needed; payloads keep nulls explicit.
    """
    from roadlake.schemas import ACCELS, PIDS, TOPIC_IMU, TOPIC_OBD

    start = rows.agg(F.min(F.unix_micros(time)).alias("_start"))
    d = rows.crossJoin(F.broadcast(start))
    at = F.unix_micros(F.lit(t0)) + F.round((F.unix_micros(time) - F.col("_start")) / F.lit(float(speed))).cast("long")
    d = d.withColumn("play_time", F.timestamp_micros(at)).withColumn("ts", at / 1e6)
    obd = F.to_json(F.struct("ts", F.lit("normal").alias("mode"), *PIDS), _OPTS)
    imu = F.to_json(F.struct("ts", *ACCELS), _OPTS)
    d = d.withColumn("_p", F.explode(F.array(F.struct(F.lit(TOPIC_OBD).alias("topic"), obd.alias("value")), F.struct(F.lit(TOPIC_IMU).alias("topic"), imu.alias("value")))))
    return d.select(*rows.columns, "play_time", "_p.topic", "_p.value")


def publish(rows: DataFrame, path: str, checkpoint: str, every: str = "500 milliseconds", kind: str = "telemetry"):
    """K6: the running live feed, one line of JSON per row in a text sink, one append per trigger."""
    return (live_messages(rows, kind).writeStream.format("text").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(processingTime=every).start(path))


def open_at(sessions: DataFrame, at: dt.datetime) -> DataFrame:
    """The sessions that run at a moment: begun, and not yet ended then."""
    return sessions.where((F.col("started_at") <= F.lit(at)) & (F.col("ended_at").isNull() | (F.col("ended_at") > F.lit(at))))


def open_session_snapshots(sessions: Callable[[], DataFrame], path: str, time: str = "time") -> Callable[[DataFrame, int], None]:
    """ST7: a foreachBatch function storing, at every trigger, the sessions open at
    its newest row."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at = batch.agg(F.max(time)).first()[0]
        if at is not None:
            open_at(sessions(), at).withColumn("seen_at", F.lit(at)).write.mode("overwrite").parquet(f"{path}/trigger={batch_id}")

    return write


def open_session_summaries(sessions: Callable[[], DataFrame], stored: Callable[[], DataFrame], path: str, time: str = "time") -> Callable[[DataFrame, int], None]:
    """ST9: a foreachBatch function storing, at every trigger, the summaries so far of
    the sessions then open, over the telemetry stored up to its newest row."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at = batch.agg(F.max(time)).first()[0]
        if at is not None:
            summarize_open(stored().where(F.col(time) <= F.lit(at)), sessions(), at).write.mode("overwrite").parquet(f"{path}/trigger={batch_id}")

    return write


def summarize_open(tel: DataFrame, sessions: DataFrame, now: dt.datetime) -> DataFrame:
    """ST9: summaries of the sessions still running, as of ``now``."""
    running = open_at(sessions, now).withColumn("ended_at", F.lit(None).cast("timestamp"))
    return summarize(session_rows(tel, running, now))
