"""Session summaries (A2-A9, W1, W10) as a two-level fold.

Level one folds the rows of a (session, minute) in one window and one partial
aggregate; level two stitches the minutes of a session together.  Both levels
are plain window and aggregate expressions, and the rows shuffle once, on
(session, minute), so a session of any length spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions.scalars import G
from roadlake.plans import segmented as sg

MAX_GAP_S = 2.0
IDLE_KMH = 1.0
HARSH_G = 0.30
START_KMH = 2.0
TARGET_KMH = 60.0
SPAN = sg.Adaptive(60)  # a session gathers the rows of every node, so spans may be crowded

PID_STATS = ["speed_kmh", "rpm", "throttle_pct", "coolant_temp_c", "engine_load_pct"]


def _mx(c: str) -> Column:
    return F.max(c)


def gap_seconds(t_us: Column, prev_us: Column, max_gap: float = MAX_GAP_S) -> Column:
    """Time since the previous row; 0 for the first row, a step back or a dropout."""
    d = (t_us - prev_us) / F.lit(1e6)
    return F.when((d > 0) & (d <= max_gap), d).otherwise(F.lit(0.0))


def with_dt(df: DataFrame, keys: Sequence[str], time: str = "time", tie: str = "event_id", max_gap: float = MAX_GAP_S,
            segment_s: float | sg.Adaptive = SPAN) -> DataFrame:
    """Adds ``dt_s``."""
    d = sg.with_segment(df, time, segment_s, keys)
    d = sg.lag_time(d, keys, time, tie, "_pt")
    return d.select(*df.columns, gap_seconds(F.unix_micros(time), F.col("_pt"), max_gap).alias("dt_s"))


def _minutes(rows: DataFrame, keys: list[str], time: str, tie: str, target: float, start: float, segment_s: float | sg.Adaptive) -> DataFrame:
    d = sg.with_segment(rows, time, segment_s, keys)
    us = F.unix_micros(time)
    v = F.col("speed_kmh").cast("double")
    d = d.select(
        *keys, sg.SEG, time, tie, *[F.col(c).cast("double").alias(c) for c in PID_STATS],
        F.col("accel_x").cast("double").alias("accel_x"), F.col("accel_y").cast("double").alias("accel_y"),
        us.alias("_us"), F.when(v.isNotNull(), us).alias("_st"),
        F.coalesce(F.col("accel_x") / G > HARSH_G, F.lit(False)).alias("_hi"),
        F.coalesce(F.col("accel_x") / G < -HARSH_G, F.lit(False)).alias("_lo"),
    )
    w = Window.partitionBy(*keys, sg.SEG).orderBy(time, tie)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.select(
        "*", F.lag("_us").over(w).alias("_pus"), F.lag("speed_kmh").over(w).alias("_pv"),
        F.lag("_hi", 1, False).over(w).alias("_phi"), F.lag("_lo", 1, False).over(w).alias("_plo"),
        F.max("_st").over(past).alias("_pst"),
        F.max(F.when(F.col("speed_kmh") <= start, F.col("_us"))).over(upto).alias("_s"),
    )
    d = d.withColumn("_brk", F.when(F.col("_st") - F.col("_pst") > int(MAX_GAP_S * 1e6), F.col("_st")))
    d = d.withColumn("_g", F.max("_brk").over(upto)).withColumn("_dt", gap_seconds(F.col("_us"), F.col("_pus")))
    hit = F.col("speed_kmh") >= target
    live = F.col("_s") >= F.coalesce("_g", "_s")
    edge = lambda now, before: (F.col(now) & ~F.col(before)).cast("long")
    ends = F.struct("_us", F.col("speed_kmh").alias("v"), F.col("_hi").alias("hi"), F.col("_lo").alias("lo"))
    return d.groupBy(*keys, sg.SEG).agg(
        F.count(F.lit(1)).alias("n"), F.min("_us").alias("t0"), F.max("_us").alias("t1"),
        *[f(c).alias(f"{p}_{c}") for c in PID_STATS for p, f in (("sum", F.sum), ("cnt", F.count), ("max", F.max))],
        F.max(F.abs("accel_x")).alias("max_ax"), F.max(F.abs("accel_y")).alias("max_ay"),
        F.max(F.hypot("accel_x", "accel_y")).alias("peak"),
        F.sum((F.col("speed_kmh") + F.col("_pv")) / 3.6 / 2 * F.col("_dt")).alias("dist"),
        F.sum(F.when(F.col("speed_kmh").isNotNull(), F.col("_dt"))).alias("tracked"),
        F.sum(F.when(F.col("speed_kmh") < IDLE_KMH, F.col("_dt"))).alias("idle"),
        F.sum(edge("_hi", "_phi")).alias("accels"), F.sum(edge("_lo", "_plo")).alias("brakes"),
        F.min_by(ends, F.struct(time, tie)).alias("first"), F.max_by(ends, F.struct(time, tie)).alias("last"),
        F.min("_st").alias("first_st"), F.max("_st").alias("last_st"),
        F.max("_s").alias("s_end"), F.max("_g").alias("g_end"),
        F.min(F.when(hit & live, F.col("_us") - F.col("_s"))).alias("best"),
        F.min(F.when(hit & F.col("_s").isNull() & F.col("_g").isNull(), F.col("_us"))).alias("open_hit"),
    )


def summarize(rows: DataFrame, keys: Sequence[str] = ("session_id",), time: str = "time", tie: str = "event_id",
              target_kmh: float = TARGET_KMH, start_kmh: float = START_KMH, segment_s: float | sg.Adaptive = SPAN) -> DataFrame:
    """One summary row per key from rows joined to their sessions."""
    keys = list(keys)
    m = _minutes(rows, keys, time, tie, target_kmh, start_kmh, segment_s)
    w = Window.partitionBy(*keys).orderBy(sg.SEG)
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    m = m.select("*", F.lag("last").over(w).alias("pl"), F.max("last_st").over(past).alias("pst"), F.max("s_end").over(past).alias("cs"),
                 F.max("g_end").over(past).alias("cg"))
    m = m.withColumn("brk", F.when(F.col("first_st") - F.col("pst") > int(MAX_GAP_S * 1e6), F.col("first_st")))
    m = m.withColumn("cut", F.greatest(F.col("cg"), F.max("brk").over(upto)))
    m = m.withColumn("bdt", gap_seconds(F.col("first._us"), F.col("pl._us")))
    carried = F.when(F.col("cut").isNull() | (F.col("cs") >= F.col("cut")), F.col("open_hit") - F.col("cs"))
    joint = lambda f: (F.col(f"first.{f}") & F.coalesce(F.col(f"pl.{f}"), F.lit(False))).cast("long")
    m = m.select(
        "*", carried.alias("best2"), joint("hi").alias("dup_hi"), joint("lo").alias("dup_lo"),
        F.coalesce((F.col("first.v") + F.col("pl.v")) / 3.6 / 2 * F.col("bdt"), F.lit(0.0)).alias("bdist"),
        F.when(F.col("first.v").isNotNull(), F.col("bdt")).otherwise(0.0).alias("btracked"),
        F.when(F.col("first.v") < IDLE_KMH, F.col("bdt")).otherwise(0.0).alias("bidle"),
    )
    z = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    tracked, idle = z("tracked") + z("btracked"), z("idle") + z("bidle")
    avg = lambda c: (F.sum(f"sum_{c}") / F.nullif(F.sum(f"cnt_{c}"), F.lit(0)))
    return m.groupBy(*keys).agg(
        F.sum("n").alias("row_count"),
        ((F.max("t1") - F.min("t0")) / 1e6).alias("duration_s"),
        avg("speed_kmh").alias("avg_speed_kmh"), _mx("max_speed_kmh").alias("max_speed_kmh"),
        avg("rpm").alias("avg_rpm"), _mx("max_rpm").alias("max_rpm"),
        avg("throttle_pct").alias("avg_throttle_pct"), _mx("max_throttle_pct").alias("max_throttle_pct"),
        avg("coolant_temp_c").alias("avg_coolant_temp_c"), _mx("max_coolant_temp_c").alias("max_coolant_temp_c"),
        avg("engine_load_pct").alias("avg_engine_load_pct"),
        _mx("max_ax").alias("max_abs_accel_x"), _mx("max_ay").alias("max_abs_accel_y"),
        ((z("dist") + z("bdist")) / 1000).alias("distance_km"),
        F.when(tracked > 0, idle / tracked * 100).alias("idle_pct"),
        (F.max("peak") / G).alias("peak_g"),
        (F.sum("accels") - F.sum("dup_hi")).alias("harsh_accel_count"),
        (F.sum("brakes") - F.sum("dup_lo")).alias("harsh_brake_count"),
        (F.least(F.min("best"), F.min("best2")) / 1e6).alias("best_0_60_s"),
    )


def speed_trace_rows(rows: DataFrame, keys: Sequence[str] = ("session_id",), time: str = "time", tie: str = "event_id",
                     points: int = 60, segment_s: float | sg.Adaptive = SPAN) -> DataFrame:
    """W10 as rows: at most ``points`` evenly spaced non-null speeds per key."""
    keys = list(keys)
    d = rows.where(F.col("speed_kmh").isNotNull()).select(*keys, time, tie, "speed_kmh")
    d = sg.row_index(sg.with_segment(d, time, segment_s, keys), keys, [time, tie], "i", total="n")
    last = points - 1
    # row i is kept when some grid step k has floor(k*(n-1)/last) == i
    k = F.ceil(F.col("i") * last / F.greatest(F.col("n") - 1, F.lit(1)))
    on_grid = F.floor(k * (F.col("n") - 1) / last) == F.col("i")
    keep = (F.col("n") <= points) | on_grid
    return d.where(keep).select(*keys, F.col("i").alias("pos"), F.col(time).alias("t"), F.bround("speed_kmh", 1).alias("v"))


def speed_trace(rows: DataFrame, keys: Sequence[str] = ("session_id",), **kw) -> DataFrame:
    """The trace as one array of (t, v) per key; at most ``points`` long."""
    pts = speed_trace_rows(rows, keys, **kw)
    arr = F.transform(F.array_sort(F.collect_list(F.struct("pos", "t", "v"))), lambda x: F.struct(x["t"].alias("t"), x["v"].alias("v")))
    return pts.groupBy(*keys).agg(arr.alias("speed_trace"))


def session_extents(tel: DataFrame, sessions: DataFrame, time: str = "time") -> DataFrame:
    """The data extent beside every session (a one-row side, broadcast)."""
    ext = tel.agg(F.min(time).alias("data_min_time"), F.max(time).alias("data_max_time"))
    return sessions.crossJoin(F.broadcast(ext)).orderBy("started_at")


def backfill_sessions(tel: DataFrame, key: str = "session_id", time: str = "time") -> DataFrame:
    """Session windows from a per-row session key."""
    return tel.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(time).alias("started_at"), F.max(time).alias("ended_at"))
