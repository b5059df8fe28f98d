"""The driver's tables seen as telemetry.

Every view exists twice: as a DataFrame and as DuckDB text for the checks.  The
clock of ``events`` is compressed 3600 times, so that 30 days become 12 minutes
and gap and window logic has something to do.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.session import prepare

T0_US = 1704067200000000  # 2024-01-01 00:00:00 UTC
NOW = dt.datetime(2024, 1, 1, 0, 12, 0, tzinfo=dt.timezone.utc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TELEMETRY_COLUMNS = {
    "vehicle_id": "CAST(user_id % 8 AS INT)",
    "user_id": "user_id",
    "event_id": "event_id",
    "time": f"TIMESTAMP_MICROS({T0_US} + (UNIX_MICROS(CAST(ts AS TIMESTAMP)) - {T0_US}) DIV 3600)",
    "speed_kmh": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE "
    "CAST(FLOOR(LEAST(value, CAST(480 AS DOUBLE)) * CAST(2.5 AS DOUBLE)) AS DOUBLE) / 10 END",
    "rpm": "CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) "
    "ELSE CAST(700 + FLOOR(value * 10) AS DOUBLE) END",
    "throttle_pct": "CAST(GET_JSON_OBJECT(props, '$.k') AS DOUBLE)",
    "coolant_temp_c": "CAST(80 + event_id % 41 AS DOUBLE)",
    "engine_load_raw": "CAST(FLOOR(value) AS DOUBLE)",
    "engine_load_pct": "CASE WHEN FLOOR(value) BETWEEN 0 AND 100 THEN CAST(FLOOR(value) AS DOUBLE) END",
    "accel_x": "CAST((event_id * 7919) % 1201 - 600 AS DOUBLE) / 100",
    "accel_y": "CASE WHEN event_id % 17 = 0 THEN NULL "
    "ELSE CAST((event_id * 104729) % 801 - 400 AS DOUBLE) / 100 END",
    "accel_z": "CAST(900 + (event_id * 31) % 163 AS DOUBLE) / 100",
}

_SESSION_COLUMNS = {
    "session_id": "CONCAT('s', CAST(n_nationkey AS STRING))",
    "name": "n_name",
    "driver_id": "CONCAT('d', CAST(n_regionkey AS STRING))",
    "vehicle_id": "CAST(n_nationkey % 8 AS INT)",
    "started_at": f"TIMESTAMP_MICROS(CAST({T0_US} + n_nationkey * CAST(28000000 AS BIGINT) AS BIGINT))",
    "ended_at": "CASE WHEN n_nationkey = 24 THEN NULL ELSE "
    f"TIMESTAMP_MICROS(CAST({T0_US} + n_nationkey * CAST(28000000 AS BIGINT) "
    "+ (20 + n_nationkey % 7 * 15) * CAST(1000000 AS BIGINT) AS BIGINT)) END",
}


def _duck(text: str) -> str:
    for a, b in (
        ("UNIX_MICROS(CAST(ts AS TIMESTAMP))", "EPOCH_US(ts)"),
        ("TIMESTAMP_MICROS", "MAKE_TIMESTAMP"),
        (" DIV ", " // "),
        ("GET_JSON_OBJECT", "JSON_EXTRACT_STRING"),
        (" AS STRING", " AS VARCHAR"),
    ):
        text = text.replace(a, b)
    return text


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.selectExpr(*[f"{e} AS {n}" for n, e in _TELEMETRY_COLUMNS.items()])


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(*[f"{e} AS {n}" for n, e in _SESSION_COLUMNS.items()])


def trips(spark: SparkSession, sf_dir: str, seconds: int = 120) -> DataFrame:
    """Telemetry with a trip number: each vehicle drives one trip per ``seconds``."""
    us = F.unix_micros("time") - F.lit(T0_US)
    return telemetry(spark, sf_dir).withColumn("trip", F.floor(us / F.lit(seconds * 1000000)).cast("int"))


# Stop-and-go drive of the mount log: 15 s standing, 25 s uneven speeding up, 20 s
# uneven braking; shared text of both engines ({p} = seconds into the minute).
_MOUNT_V = ("CASE WHEN {p} < 15 THEN CAST(0 AS DOUBLE) WHEN {p} < 40 THEN ({p} - 15) * CAST(1.6 AS DOUBLE) + ABS({p} % 6 - 3) * CAST(1.5 AS DOUBLE) "
            "ELSE (60 - {p}) * CAST(2 AS DOUBLE) + ABS({p} % 4 - 2) END")
_MOUNT_A = ("CASE WHEN {p} < 15 THEN CAST(0 AS DOUBLE) WHEN {p} < 40 THEN (CAST(1.6 AS DOUBLE) + CASE WHEN {p} % 6 < 3 THEN CAST(-1.5 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END) / CAST(3.6 AS DOUBLE) "
            "ELSE (-2 + CASE WHEN {p} % 4 < 2 THEN -1 ELSE 1 END) / CAST(3.6 AS DOUBLE) END")
_MOUNT_STEPS = [
    "SELECT vehicle_id, event_id, time, CAST({us} % 60000000 AS DOUBLE) / 1000000 AS p, RADIANS(vehicle_id * CAST(45 AS DOUBLE) - 150) AS head, RADIANS(CAST(20 AS DOUBLE) + vehicle_id) AS tip, "
    "COALESCE(accel_y, CAST(0 AS DOUBLE)) / 20 AS nx, accel_x / 10 AS ny FROM tel",
    "SELECT *, CAST(FLOOR(" + _MOUNT_V.format(p="p") + ") AS DOUBLE) AS speed_kmh, " + _MOUNT_A.format(p="p") + " AS a FROM m0",
    "SELECT vehicle_id, event_id, time, speed_kmh, COS(tip) * (COS(head) * a + nx) + SIN(tip) * CAST(9.81 AS DOUBLE) AS ax, SIN(head) * a + ny AS ay, "
    "COS(tip) * CAST(9.81 AS DOUBLE) - SIN(tip) * (COS(head) * a + nx) AS az FROM m1",
]


def mount_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sensor samples of a tipped, turned mount on a stop-and-go drive.

    Sample times and noise come from ``events``; the axes carry the drive's
    acceleration turned by a heading of the vehicle and tipped about y.
    """
    d = telemetry(spark, sf_dir)
    for name, step in zip(("tel", "m0", "m1"), _MOUNT_STEPS):
        d = spark.sql(step.format(us="UNIX_MICROS(time)").replace(f"FROM {name}", "FROM {src}"), src=d)
    return d


TEL = "tel AS (SELECT " + ", ".join(f"{_duck(e)} AS {n}" for n, e in _TELEMETRY_COLUMNS.items()) + " FROM events)"
SES = "ses AS (SELECT " + ", ".join(f"{_duck(e)} AS {n}" for n, e in _SESSION_COLUMNS.items()) + " FROM nation)"
NOW_SQL = "TIMESTAMP '2024-01-01 00:12:00'"
TRIPS = TEL + ", trips AS (SELECT *, CAST((EPOCH_US(time) - 1704067200000000) // {us} AS INT) AS trip FROM tel)"
JOINED = (
    TEL + ", " + SES + ", j AS (SELECT s.session_id, t.* FROM tel t JOIN ses s ON t.time BETWEEN s.started_at "
    f"AND COALESCE(s.ended_at, {NOW_SQL}))"
)


MOUNT = TEL + "".join(f", {n} AS MATERIALIZED ({t.format(us='EPOCH_US(time)')})" for n, t in zip(("m0", "m1", "ml"), _MOUNT_STEPS))


def trips_sql(seconds: int = 120) -> str:
    return TRIPS.format(us=seconds * 1000000)


def solid_trips(spark: SparkSession, sf_dir: str, seconds: int = 120) -> DataFrame:
    """Trips whose readings are nearly complete, as fault windows need."""
    t = trips(spark, sf_dir, seconds)
    return t.withColumn("speed_kmh", F.coalesce("speed_kmh", F.lit(50.0))).withColumn(
        "engine_load_pct", F.expr("CASE WHEN event_id % 997 = 0 THEN NULL ELSE LEAST(engine_load_raw, CAST(100 AS DOUBLE)) END"))


def solid_sql(seconds: int = 120) -> str:
    return (trips_sql(seconds) + ", solid AS (SELECT * REPLACE (COALESCE(speed_kmh, 50.0::DOUBLE) AS speed_kmh, "
            "CASE WHEN event_id % 997 = 0 THEN NULL ELSE LEAST(engine_load_raw, 100.0::DOUBLE) END AS engine_load_pct) FROM trips)")
