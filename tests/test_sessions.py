"""Session summaries against a row loop, and the small rules around sessions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from roadlake.functions import scalars as sc
from roadlake.operators import sessions as so
from roadlake.operators import summary as sm
from roadlake.operators.quality import missing_runs
from roadlake.plans.segmented import Adaptive

T0 = 1_704_067_200_000_000
G = 9.80665
COLS = "session_id string, event_id long, us long, speed_kmh double, rpm double, throttle_pct double, coolant_temp_c double, engine_load_pct double, accel_x double, accel_y double"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS).withColumn("time", F.timestamp_micros("us"))


def loop(rows):
    """The summary walked row by row from its definition."""
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    dist = idle = tracked = 0.0
    prev = start = last_speed = best = None
    was = {1: False, -1: False}
    events = {1: 0, -1: 0}
    for _, _, us, v, *_, ax, ay in rows:
        gap = (us - prev[0]) / 1e6 if prev else 0.0
        gap = gap if 0 < gap <= 2 else 0.0
        if prev and v is not None and prev[1] is not None:
            dist += (v + prev[1]) / 3.6 / 2 * gap
        if v is not None:
            tracked += gap
            idle += gap if v < 1 else 0
            if last_speed is not None and us - last_speed > 2_000_000:
                start = None
            last_speed = us
            if v <= 2:
                start = us
            elif start is not None and v >= 60:
                best = min(best or math.inf, (us - start) / 1e6)
                start = None
        for sign in (1, -1):
            hit = ax is not None and ax / G * sign > 0.3
            events[sign] += hit and not was[sign]
            was[sign] = hit
        prev = (us, v)
    peaks = [math.hypot(r[-2], r[-1]) / G for r in rows if r[-2] is not None and r[-1] is not None]
    return (len(rows), round(dist / 1000, 6), round(100 * idle / tracked, 6) if tracked else None, round(max(peaks), 6) if peaks else None, events[1], events[-1], best)


@pytest.mark.parametrize("segment", [3, 60, Adaptive(120, 40)])
def test_summary_matches_loop(spark, segment):
    rng = random.Random(11)
    rows, i = [], 0
    for s, n in (("a", 700), ("b", 200), ("c", 3), ("d", 1)):
        us, v = T0, 0.0
        for _ in range(n):
            us += rng.choice([100_000] * 12 + [2_000_000, 2_000_001, 2_100_000, 0, 40_000_000])
            v = max(0.0, min(130.0, v + rng.choice([-20, -3, 1, 6, 9]))) if rng.random() > 0.03 else 0.0
            rows.append((s, i, us, None if rng.random() < 0.1 else round(v, 1), 900.0, None, 80.0, 10.0,
                         None if rng.random() < 0.05 else rng.choice([0.0, 0.3 * G, 2.0, 3.5, -3.5]), None if rng.random() < 0.1 else rng.uniform(-3, 3)))
            i += 1
    got = sm.summarize(frame(spark, rows), segment_s=segment).collect()
    assert len(got) == 4
    for r in got:
        want = loop([x for x in rows if x[0] == r.session_id])
        have = (r.row_count, round(r.distance_km, 6), None if r.idle_pct is None else round(r.idle_pct, 6), None if r.peak_g is None else round(r.peak_g, 6),
                r.harsh_accel_count, r.harsh_brake_count, r.best_0_60_s)
        assert have == want


def drive(points, ax=0.0):
    return [("s", i, T0 + int(t * 1e6), v, None, None, None, None, a, 0.0) for i, (t, v, a) in enumerate((*p, ax)[:3] for p in points)]


def test_best_time_cases(spark):
    best = lambda pts: sm.summarize(frame(spark, drive(pts)), segment_s=3).first()["best_0_60_s"]
    steady = [(t, min(t * 7.5, 90.0)) for t in range(13)]
    assert best(steady) == 8.0
    assert best([(0, 0.0), (1, 20.0), (3.1, 40.0), (4, 70.0)]) is None  # a 2.1 s gap breaks the run
    assert best([(0, 30.0), (1, 70.0)]) is None  # rolling start
    assert best([(0, 0.0), (1, None), (2, 61.0)]) == 2.0


def test_harsh_run_cases(spark):
    count = lambda ax: (lambda r: (r.harsh_accel_count, r.harsh_brake_count))(sm.summarize(frame(spark, drive([(i * 0.1, 10.0, a) for i, a in enumerate(ax)])), segment_s=1).first())
    assert count([-4.0] * 25) == (0, 1)
    assert count([-4.0] * 5 + [None] + [-4.0] * 5) == (0, 2)
    assert count([0.30 * G, -0.30 * G, 0.0]) == (0, 0)
    assert count([4.0, -4.0, 4.0]) == (2, 1)


def test_trace_is_even(spark):
    rows = drive([(i * 0.5, float(i)) for i in range(200)])
    pts = sorted(r.pos for r in sm.speed_trace_rows(frame(spark, rows), segment_s=7).collect())
    assert pts == [i * 199 // 59 for i in range(60)]
    assert sm.speed_trace_rows(frame(spark, rows[:60]), segment_s=7).count() == 60


def test_limits_and_labels(spark):
    df = spark.createDataFrame([("s", "", dt.datetime(2024, 1, 5, 7, 3), None)], "session_id string, name string, started_at timestamp, ended_at timestamp")
    for n in (0, 201):
        with pytest.raises(ValueError):
            so.recent_sessions(df, n)
    assert df.select(sc.session_label().alias("l")).first()["l"].endswith(" · live")
    secs = spark.createDataFrame([(187.9,), (3725.0,), (None,)], "s double").select(sc.fmt_duration("s").alias("t"))
    assert [r.t for r in secs.collect()] == ["3m 07s", "1h 02m", "--"]
    assert len(df.select(sc.new_id().alias("i")).first()["i"]) == 32


def test_missing_runs(spark):
    secs = [0, 1, 2, 4, 8, 9, 1300]
    df = spark.createDataFrame([("a", T0 + s * 1_000_000 + 5) for s in secs], "k string, us long").withColumn("time", F.timestamp_micros("us"))
    got = sorted(((r.run_start.replace(tzinfo=dt.timezone.utc).timestamp() - T0 / 1e6), r.run_len) for r in missing_runs(df, ["k"]).collect())
    assert got == [(5.0, 3), (10.0, 1290)]


def test_nan_readings_are_missing(spark):
    from pyspark.sql import functions as F

    from roadlake.functions.scalars import no_nan
    from roadlake.sources import messages as ms

    d = spark.createDataFrame([(float("nan"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in d.select(no_nan("x")).collect()] == [None, 1.5, None]
    m = spark.createDataFrame([("telemetry/vehicle/obd", "n", '{"ts": 1.0, "mode": "normal", "rpm": NaN, "speed_kmh": 3.0}')], "topic string, key string, value string")
    obd, _, _ = ms.route(ms.parse(m))
    assert [tuple(r) for r in obd.select("rpm", "speed_kmh", F.isnan("speed_kmh")).collect()] == [(None, 3.0, False)]
