"""One-minute rollup (A1, A1b) and what is read from it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.plans import intervals as iv


def measures() -> list[Column]:
    return [
        F.avg("speed_kmh").alias("avg_speed"), F.max("speed_kmh").alias("max_speed"), F.avg("rpm").alias("avg_rpm"),
        F.avg("throttle_pct").alias("avg_throttle"), F.avg("engine_load_pct").alias("avg_load"),
        F.max(F.abs("accel_x")).alias("max_accel_x"), F.max(F.abs("accel_y")).alias("max_accel_y"),
    ]


def rollup_1min(tel: DataFrame, by: Sequence[str] = (), time: str = "time") -> DataFrame:
    """Tumbling minute aggregates; ``by=['session_id']`` is the first schema's form."""
    g = tel.groupBy(*by, F.window(time, "1 minute").alias("_w")).agg(*measures())
    return g.select(*by, F.col("_w.start").alias("bucket"), *[c for c in g.columns if c not in ("_w", *by)])


def session_rollup(rollup: DataFrame, sessions: DataFrame, session_id: str, start: dt.datetime, end: dt.datetime,
                   now: dt.datetime | None = None) -> DataFrame:
    """Buckets whose start lies in the session and in the shown range."""
    return iv.between(iv.rows_of(rollup, sessions, session_id, now, time="bucket"), start, end, time="bucket")


def refresh(tel: DataFrame, stored: DataFrame | None, since: dt.datetime | None, time: str = "time") -> DataFrame:
    """Batch form of the refresh policy: buckets from ``since`` on are computed
    anew, older ones are taken from what is stored; without ``since`` all are."""
    if stored is None or since is None:
        return rollup_1min(tel, time=time)
    floor = since.replace(second=0, microsecond=0)
    fresh = rollup_1min(tel.where(F.col(time) >= F.lit(floor)), time=time)
    return stored.where(F.col("bucket") < F.lit(floor)).unionByName(fresh)
