"""Sessions, summaries and the rollup: J1-J5, A1-A9, A29, T1-T6, W1, W4, W10, W18."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from roadlake import fixtures as fx
from roadlake.functions import scalars as sc
from roadlake.operators import rollup as ru
from roadlake.operators import sessions as so
from roadlake.operators import summary as sm
from roadlake.plans import intervals as iv
from roadlake.plans import segmented as sg
from roadlake.queries.base import joined, rounded

UTC = dt.timezone.utc
LO, HI = dt.datetime(2024, 1, 1, 0, 1, tzinfo=UTC), dt.datetime(2024, 1, 1, 0, 9, 30, tzinfo=UTC)
RANGE = "BETWEEN TIMESTAMP '2024-01-01 00:01:00' AND TIMESTAMP '2024-01-01 00:09:30'"
SID = "s3"
_ROLL = ("SELECT DATE_TRUNC('minute', time) AS bucket, AVG(speed_kmh) AS avg_speed, MAX(speed_kmh) AS max_speed, AVG(rpm) AS avg_rpm, "
         "AVG(throttle_pct) AS avg_throttle, AVG(engine_load_pct) AS avg_load, MAX(ABS(accel_x)) AS max_accel_x, "
         "MAX(ABS(accel_y)) AS max_accel_y")
_ROLL_R = ("SELECT {k}bucket, ROUND(avg_speed,6) AS avg_speed, max_speed, ROUND(avg_rpm,6) AS avg_rpm, ROUND(avg_throttle,6) AS avg_throttle, "
           "ROUND(avg_load,6) AS avg_load, max_accel_x, max_accel_y FROM r")
_ONE = f"(SELECT * FROM j WHERE session_id = '{SID}')"

# row-order window form of the whole summary, one session at a time
_SUMMARY = f"""WITH {fx.JOINED},
a AS (SELECT *, EPOCH_US(time) AS us, LAG(EPOCH_US(time)) OVER w AS pus, LAG(speed_kmh) OVER w AS pv,
        COALESCE(accel_x / 9.80665 > 0.3, FALSE) AS hi, COALESCE(accel_x / 9.80665 < -0.3, FALSE) AS lo,
        MAX(CASE WHEN speed_kmh IS NOT NULL THEN EPOCH_US(time) END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pst
      FROM j WINDOW w AS (PARTITION BY session_id ORDER BY time, event_id)),
b AS (SELECT *, CASE WHEN us - pus > 0 AND us - pus <= 2000000 THEN (us - pus) / 1000000.0::DOUBLE ELSE 0 END AS dt,
        hi AND NOT COALESCE(LAG(hi) OVER w, FALSE) AS hi_edge, lo AND NOT COALESCE(LAG(lo) OVER w, FALSE) AS lo_edge,
        MAX(CASE WHEN speed_kmh IS NOT NULL AND us - pst > 2000000 THEN us END) OVER (w ROWS UNBOUNDED PRECEDING) AS seg,
        MAX(CASE WHEN speed_kmh <= 2.0 THEN us END) OVER (w ROWS UNBOUNDED PRECEDING) AS start_us
      FROM a WINDOW w AS (PARTITION BY session_id ORDER BY time, event_id)),
s AS (SELECT session_id, COUNT(*) AS row_count, (MAX(us) - MIN(us)) / 1000000.0::DOUBLE AS duration_s,
  AVG(speed_kmh) AS avg_speed_kmh, MAX(speed_kmh) AS max_speed_kmh, AVG(rpm) AS avg_rpm, MAX(rpm) AS max_rpm,
  AVG(throttle_pct) AS avg_throttle_pct, MAX(throttle_pct) AS max_throttle_pct,
  AVG(coolant_temp_c) AS avg_coolant_temp_c, MAX(coolant_temp_c) AS max_coolant_temp_c,
  AVG(engine_load_pct) AS avg_engine_load_pct, MAX(ABS(accel_x)) AS max_abs_accel_x, MAX(ABS(accel_y)) AS max_abs_accel_y,
  COALESCE(SUM((speed_kmh + pv) / 3.6::DOUBLE / 2 * dt), 0) / 1000 AS distance_km,
  SUM(CASE WHEN speed_kmh IS NOT NULL THEN dt END) AS tracked, COALESCE(SUM(CASE WHEN speed_kmh < 1 THEN dt END), 0) AS idle,
  MAX(SQRT(accel_x * accel_x + accel_y * accel_y)) / 9.80665::DOUBLE AS peak_g,
  CAST(SUM(hi_edge::INT) AS BIGINT) AS harsh_accel_count, CAST(SUM(lo_edge::INT) AS BIGINT) AS harsh_brake_count,
  MIN(CASE WHEN speed_kmh >= 60 AND start_us >= COALESCE(seg, 0) THEN us - start_us END) / 1000000.0::DOUBLE AS best_0_60_s
  FROM b GROUP BY session_id)"""
_SUMMARY_COLS = ["avg_speed_kmh", "max_speed_kmh", "avg_rpm", "max_rpm", "avg_throttle_pct", "max_throttle_pct", "avg_coolant_temp_c",
                 "max_coolant_temp_c", "avg_engine_load_pct", "max_abs_accel_x", "max_abs_accel_y", "distance_km", "peak_g",
                 "best_0_60_s", "duration_s"]


def _sum_sql(cols: list[str], where: str = "") -> str:
    parts = []
    for c in cols:
        if c == "idle_pct":
            parts.append("CASE WHEN tracked > 0 THEN ROUND(100 * idle / tracked, 6) END AS idle_pct")
        elif c in _SUMMARY_COLS:
            parts.append(f"ROUND({c}, 6) AS {c}")
        else:
            parts.append(c)
    return f"{_SUMMARY} SELECT session_id, {', '.join(parts)} FROM s {where}"


def spans(spark, d):
    """Crowded minutes are found on the telemetry alone, so the join runs once."""
    return sg.Adaptive(60, counted=fx.telemetry(spark, d).select("time"))


def summary(spark, d):
    return rounded(sm.summarize(joined(spark, d), segment_s=spans(spark, d)))


def _part(*cols):
    return lambda spark, d: rounded(sm.summarize(joined(spark, d), segment_s=spans(spark, d)).select("session_id", *cols))


_ALL = ["row_count", *_SUMMARY_COLS[:12], "idle_pct", "peak_g", "harsh_accel_count", "harsh_brake_count", "best_0_60_s", "duration_s"]
_BASIC = ["row_count", "duration_s", *_SUMMARY_COLS[:11]]


def session_rows(spark, d):
    return joined(spark, d).select("session_id", "event_id", "time", "speed_kmh")


def node_session_rows(spark, d):
    rows = iv.session_rows(fx.telemetry(spark, d), fx.sessions(spark, d), fx.NOW, by=["vehicle_id"])
    return rows.select("session_id", "vehicle_id", "event_id")


def orphan_count(spark, d):
    early = fx.sessions(spark, d).where("ended_at IS NOT NULL AND session_id <> 's10'")
    return iv.orphans(fx.telemetry(spark, d), early, fx.NOW).agg(F.count(F.lit(1)).alias("orphan_count"))


def _sessions_cols(df):
    return df.select("session_id", "name", "driver_id", "started_at", "ended_at")


def rollup(spark, d):
    return rounded(ru.rollup_1min(fx.telemetry(spark, d)))


def rollup_by_session(spark, d):
    return rounded(ru.rollup_1min(joined(spark, d), by=["session_id"]))


def session_rollup(spark, d):
    return rounded(ru.session_rollup(ru.rollup_1min(fx.telemetry(spark, d)), fx.sessions(spark, d), SID, LO, HI, fx.NOW))


def rollup_refresh(spark, d):
    tel = fx.telemetry(spark, d)
    since = dt.datetime(2024, 1, 1, 0, 6, tzinfo=UTC)
    old = ru.rollup_1min(tel.where(F.col("time") < F.lit(since)))
    return rounded(ru.refresh(tel, old, since))


def one_session(spark, d):
    return iv.between(iv.rows_of(fx.telemetry(spark, d), fx.sessions(spark, d), SID, fx.NOW), LO, HI)


def with_dt(spark, d):
    return rounded(sm.with_dt(joined(spark, d), ["session_id"]).select("session_id", "event_id", "dt_s"))


def rising(spark, d):
    j = sg.with_segment(joined(spark, d), "time", sg.Adaptive(60), ["session_id"])
    return sg.rising_edge(j, ["session_id"], ["time", "event_id"], F.col("accel_y") > 2.0).select("session_id", "event_id", "edge")


def trace(spark, d):
    return sm.speed_trace_rows(joined(spark, d)).select("session_id", "pos", "t", "v")


def trace_arrays(spark, d):
    t = sm.speed_trace(joined(spark, d))
    return t.select("session_id", F.size("speed_trace").alias("n"), F.element_at("speed_trace", 1)["v"].alias("first_v"),
                    F.element_at("speed_trace", -1)["t"].alias("last_t"),
                    F.round(F.aggregate("speed_trace", F.lit(0.0), lambda a, x: a + x["v"]), 6).alias("sum_v"))


_TRACE = f"""WITH {fx.JOINED}, p AS (SELECT session_id, time, speed_kmh, ROW_NUMBER() OVER w - 1 AS pos, COUNT(*) OVER (PARTITION BY session_id) AS n
 FROM j WHERE speed_kmh IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY time, event_id)),
 tr AS (SELECT session_id, pos, time AS t, ROUND_EVEN(speed_kmh, 1) AS v FROM p WHERE n <= 60 OR pos IN (SELECT (i * (n - 1)) // 59 FROM RANGE(60) x(i)))"""


def fold(spark, d):
    s, _ = so.fold_sessions(_lifecycle(spark, d))
    return s


def fold_rejects(spark, d):
    return so.fold_sessions(_lifecycle(spark, d))[1].select("session_id", "event_id", "action", "reason")


def _lifecycle(spark, d):
    act = F.when(F.col("event_id") % 3 == 0, "start").otherwise("end")
    return fx.telemetry(spark, d).select(F.concat(F.lit("u"), F.floor(F.col("event_id") / 7).cast("string")).alias("session_id"),
                                         act.alias("action"), F.col("time").alias("at"), "event_id")


_LIFE = f"""WITH {fx.TEL}, ev AS (SELECT CONCAT('u', CAST(event_id // 7 AS VARCHAR)) AS session_id,
 CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'end' END AS action, time AS tm, event_id FROM tel),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, action ORDER BY tm, event_id) AS k,
   MIN(CASE WHEN action = 'start' THEN tm END) OVER (PARTITION BY session_id) AS s_at FROM ev),
 st AS (SELECT session_id, tm AS started_at, event_id AS s_id FROM r WHERE action = 'start' AND k = 1),
 en AS (SELECT session_id, ended_at, e_id FROM (SELECT ev.session_id, ev.tm AS ended_at, ev.event_id AS e_id, ROW_NUMBER() OVER (PARTITION BY ev.session_id ORDER BY ev.tm, ev.event_id) AS k
   FROM ev JOIN st USING (session_id) WHERE action = 'end' AND (ev.tm > started_at OR (ev.tm = started_at AND ev.event_id > s_id))) WHERE k = 1)"""


def feed(spark, d):
    t = fx.telemetry(spark, d).withColumn("sent", F.timestamp_micros(F.unix_micros("time") - 1000 * (F.col("event_id") % 50)))
    return rounded(so.feed_health(t, ["vehicle_id"], "time", "sent").select("vehicle_id", "event_id", "avg_interval_ms", "latency_ms"))


def feed_age(spark, d):
    return rounded(so.last_message_age(fx.telemetry(spark, d), ["vehicle_id"], fx.NOW))


def backfill(spark, d):
    return sm.backfill_sessions(fx.telemetry(spark, d).withColumn("session_id", F.concat(F.lit("u"), F.col("user_id").cast("string"))))


def labels(spark, d):
    s = sm.summarize(joined(spark, d)).select("session_id", "duration_s")
    out = fx.sessions(spark, d).join(s, "session_id", "left")
    return out.select("session_id", sc.fmt_duration(F.col("duration_s") * 37).alias("duration_text"), sc.session_label().alias("label"))


def bands(spark, d):
    t = fx.telemetry(spark, d)
    cols = [sc.band(c, w, g).alias(f"{c}_band") for c, (w, g) in sc.BANDS.items()]
    cols += [sc.gauge_fraction(c, lo, hi).alias(f"{c}_frac") for c, (lo, hi) in sc.GAUGES.items()]
    cols.append(sc.gauge_angle("rpm", *sc.GAUGES["rpm"], -120, 240).alias("rpm_deg"))
    return rounded(t.select("event_id", *cols))


def units(spark, d):
    t = fx.telemetry(spark, d)
    return rounded(t.select(
        "event_id", sc.kmh_to_ms("speed_kmh").alias("speed_ms"), sc.to_g("accel_x").alias("long_g"),
        sc.planar_g("accel_x", "accel_y").alias("planar_g"), sc.counts_to_ms2(F.col("event_id") % 16384).alias("counts_ms2"),
        sc.epoch_to_ts(F.unix_micros("time") / 1e6).alias("from_epoch"), sc.to_display_tz("time", "Asia/Kolkata").alias("local_time"), sc.iso_text("time").alias("iso"),
        sc.null_out_of_range("engine_load_raw").alias("load_clean")))


def around(spark, d):
    anchor = dt.datetime(2024, 1, 1, 0, 5, tzinfo=UTC)
    return iv.around(fx.telemetry(spark, d), anchor, 10, 100).select("event_id", "time", "rpm")


_S5 = "session_id, name, driver_id, started_at, ended_at"
_B = ("CASE WHEN {c} IS NULL THEN 'missing' WHEN {c} >= {g} THEN 'danger' WHEN {c} >= {w} THEN 'warn' ELSE 'ok' END AS {c}_band")

QUERIES = {
    "session_summary": (summary, _sum_sql(_ALL)),
    "summary_basic": (_part(*_BASIC), _sum_sql(_BASIC)),
    "summary_distance": (_part("distance_km"), _sum_sql(["distance_km"])),
    "summary_idle": (_part("idle_pct"), _sum_sql(["idle_pct"])),
    "summary_peak_g": (_part("peak_g"), _sum_sql(["peak_g"])),
    "summary_harsh_events": (_part("harsh_accel_count", "harsh_brake_count"), _sum_sql(["harsh_accel_count", "harsh_brake_count"])),
    "summary_best_0_60": (_part("best_0_60_s"), _sum_sql(["best_0_60_s"])),
    "summary_open_sessions": (
        lambda s, d: rounded(sm.summarize(iv.session_rows(fx.telemetry(s, d), so.open_sessions(fx.sessions(s, d)), fx.NOW))),
        _sum_sql(_ALL, "WHERE session_id IN (SELECT session_id FROM ses WHERE ended_at IS NULL)")),
    "session_rows": (session_rows, f"WITH {fx.JOINED} SELECT session_id, event_id, time, speed_kmh FROM j"),
    "session_rows_by_node": (node_session_rows, f"WITH {fx.JOINED} SELECT j.session_id, j.vehicle_id, j.event_id FROM j JOIN ses USING (session_id) "
                             "WHERE j.vehicle_id = ses.vehicle_id"),
    "list_sessions": (lambda s, d: iv.list_sessions(fx.telemetry(s, d), fx.sessions(s, d), fx.NOW).select("session_id", "driver_id", "started_at", "ended_at", "row_count"),
                      f"WITH {fx.TEL}, {fx.SES} SELECT session_id, driver_id, started_at, ended_at, COUNT(t.time) AS row_count FROM ses s LEFT JOIN tel t "
                      f"ON t.time BETWEEN s.started_at AND COALESCE(s.ended_at, {fx.NOW_SQL}) GROUP BY ALL"),
    "orphan_count": (orphan_count, f"WITH {fx.TEL}, {fx.SES} SELECT COUNT(*) AS orphan_count FROM tel t WHERE NOT EXISTS (SELECT 1 FROM ses s WHERE "
                     "s.ended_at IS NOT NULL AND s.session_id <> 's10' AND t.time BETWEEN s.started_at AND s.ended_at)"),
    "rollup_1min": (rollup, f"WITH {fx.TEL}, r AS ({_ROLL} FROM tel GROUP BY 1) " + _ROLL_R.format(k="")),
    "rollup_1min_by_session": (rollup_by_session, f"WITH {fx.JOINED}, r AS ({_ROLL}, session_id FROM j GROUP BY 1, session_id) " + _ROLL_R.format(k="session_id, ")),
    "rollup_refresh": (rollup_refresh, f"WITH {fx.TEL}, r AS ({_ROLL} FROM tel GROUP BY 1) " + _ROLL_R.format(k="")),
    "session_rollup": (session_rollup, f"WITH {fx.TEL}, {fx.SES}, r0 AS ({_ROLL} FROM tel GROUP BY 1), r AS (SELECT r0.* FROM r0 JOIN ses s ON s.session_id = '{SID}' "
                       f"AND r0.bucket BETWEEN s.started_at AND COALESCE(s.ended_at, {fx.NOW_SQL}) WHERE bucket {RANGE}) " + _ROLL_R.format(k="")),
    "session_extents": (lambda s, d: sm.session_extents(fx.telemetry(s, d), fx.sessions(s, d)).select("session_id", "started_at", "ended_at", "data_min_time", "data_max_time"),
                        f"WITH {fx.TEL}, {fx.SES} SELECT session_id, started_at, ended_at, (SELECT MIN(time) FROM tel) AS data_min_time, (SELECT MAX(time) FROM tel) AS data_max_time FROM ses"),
    "backfill_sessions": (backfill, f"WITH {fx.TEL} SELECT CONCAT('u', CAST(user_id AS VARCHAR)) AS session_id, MIN(time) AS started_at, MAX(time) AS ended_at FROM tel GROUP BY 1"),
    "recent_sessions": (lambda s, d: _sessions_cols(so.recent_sessions(fx.sessions(s, d), 10)), f"WITH {fx.SES} SELECT {_S5} FROM ses ORDER BY started_at DESC LIMIT 10"),
    "latest_rows": (lambda s, d: so.latest_rows(one_session(s, d)).select("time", "event_id", "speed_kmh", "rpm", "throttle_pct", "coolant_temp_c", "engine_load_pct"),
                    f"WITH {fx.JOINED} SELECT time, event_id, speed_kmh, rpm, throttle_pct, coolant_temp_c, engine_load_pct FROM {_ONE} WHERE time {RANGE} ORDER BY time DESC, event_id DESC LIMIT 500"),
    "accel_points": (lambda s, d: so.accel_points(one_session(s, d)), f"WITH {fx.JOINED} SELECT accel_x, accel_y FROM {_ONE} WHERE time {RANGE} ORDER BY time, event_id LIMIT 2000"),
    "open_sessions": (lambda s, d: _sessions_cols(so.open_sessions(fx.sessions(s, d))), f"WITH {fx.SES} SELECT {_S5} FROM ses WHERE ended_at IS NULL"),
    "session_ids": (lambda s, d: so.session_ids(fx.sessions(s, d)), f"WITH {fx.SES} SELECT session_id FROM ses"),
    "get_session": (lambda s, d: _sessions_cols(iv.get_session(fx.sessions(s, d), SID)), f"WITH {fx.SES} SELECT {_S5} FROM ses WHERE session_id = '{SID}'"),
    "range_scan": (lambda s, d: iv.between(fx.telemetry(s, d), LO, HI).select("event_id", "time", "speed_kmh", "accel_z"),
                   f"WITH {fx.TEL} SELECT event_id, time, speed_kmh, accel_z FROM tel WHERE time {RANGE}"),
    "around_anchor": (around, f"WITH {fx.TEL} SELECT event_id, time, rpm FROM tel WHERE time BETWEEN TIMESTAMP '2024-01-01 00:04:50' AND TIMESTAMP '2024-01-01 00:06:40'"),
    "dt_seconds": (with_dt, f"{_SUMMARY} SELECT session_id, event_id, ROUND(dt, 6) AS dt_s FROM b"),
    "rising_edge": (rising, f"WITH {fx.JOINED}, m AS (SELECT *, COALESCE(accel_y > 2.0, FALSE) AS m FROM j) SELECT session_id, event_id, m AND NOT COALESCE(LAG(m) "
                    "OVER (PARTITION BY session_id ORDER BY time, event_id), FALSE) AS edge FROM m"),
    "speed_trace": (trace, _TRACE + " SELECT session_id, pos, t, v FROM tr"),
    "speed_trace_arrays": (trace_arrays, _TRACE + " SELECT session_id, CAST(COUNT(*) AS INT) AS n, ARG_MIN(v, pos) AS first_v, ARG_MAX(t, pos) AS last_t, ROUND(SUM(v), 6) AS sum_v FROM tr GROUP BY 1"),
    "fold_sessions": (fold, _LIFE + " SELECT session_id, started_at, ended_at FROM st LEFT JOIN en USING (session_id)"),
    "fold_session_rejects": (fold_rejects, _LIFE + """ SELECT * FROM (SELECT ev.session_id, event_id, action, CASE
      WHEN action = 'end' AND (started_at IS NULL OR tm < started_at OR (tm = started_at AND event_id < s_id)) THEN 'session not found'
      WHEN action = 'end' AND event_id <> e_id THEN 'session already ended' WHEN action = 'start' AND event_id <> s_id THEN 'session already exists' END AS reason
      FROM ev LEFT JOIN st USING (session_id) LEFT JOIN en USING (session_id)) WHERE reason IS NOT NULL"""),
    "feed_health": (feed, f"""WITH {fx.TEL}, r AS (SELECT vehicle_id, event_id, EPOCH_US(time) AS us, MIN(EPOCH_US(time)) OVER w AS f, COUNT(*) OVER w AS n FROM tel
      WINDOW w AS (PARTITION BY vehicle_id ORDER BY time, event_id ROWS 19 PRECEDING))
      SELECT vehicle_id, event_id, CASE WHEN n > 1 THEN ROUND((us - f) / 1000.0::DOUBLE / (n - 1), 6) END AS avg_interval_ms, CAST(event_id % 50 AS DOUBLE) AS latency_ms FROM r"""),
    "feed_age": (feed_age, f"WITH {fx.TEL} SELECT vehicle_id, MAX(time) AS last_at, ROUND((EPOCH_US({fx.NOW_SQL}) - EPOCH_US(MAX(time))) / 1000.0::DOUBLE, 6) AS age_ms FROM tel GROUP BY 1"),
    "session_labels": (labels, f"""{_SUMMARY}, q AS (SELECT ses.*, duration_s * 37 AS x FROM ses LEFT JOIN s USING (session_id))
      SELECT session_id, CASE WHEN x IS NULL THEN '--' WHEN x >= 3600 THEN CONCAT(CAST(FLOOR(x / 3600) AS INT), 'h ', LPAD(CAST(CAST(FLOOR(x % 3600 / 60) AS INT) AS VARCHAR), 2, '0'), 'm')
        ELSE CONCAT(CAST(FLOOR(x % 3600 / 60) AS INT), 'm ', LPAD(CAST(CAST(FLOOR(x % 60) AS INT) AS VARCHAR), 2, '0'), 's') END AS duration_text,
        CONCAT(name, ' · ', STRFTIME(started_at, '%b %-d, %H:%M'), CASE WHEN ended_at IS NULL THEN ' · live' ELSE '' END) AS label FROM q"""),
    "signal_bands": (bands, f"WITH {fx.TEL} SELECT event_id, " + ", ".join([
        "CASE WHEN throttle_pct IS NULL THEN 'missing' WHEN throttle_pct >= 85 THEN 'warn' ELSE 'ok' END AS throttle_pct_band",
        _B.format(c="engine_load_pct", w=70, g=90), _B.format(c="coolant_temp_c", w=100, g=115),
        "CASE WHEN rpm IS NULL THEN 'missing' WHEN rpm >= 6000 THEN 'danger' ELSE 'ok' END AS rpm_band",
        "ROUND(LEAST(GREATEST(COALESCE(speed_kmh, 0), 0), 220) / 220::DOUBLE, 6) AS speed_kmh_frac",
        "ROUND(LEAST(GREATEST(rpm, 0), 7000) / 7000::DOUBLE, 6) AS rpm_frac", "ROUND(-120 + LEAST(GREATEST(rpm, 0), 7000) / 7000::DOUBLE * 240, 6) AS rpm_deg",
        "ROUND(LEAST(GREATEST(coolant_temp_c, 0), 130) / 130::DOUBLE, 6) AS coolant_temp_c_frac"]) + " FROM tel"),
    "unit_conversions": (units, f"""WITH {fx.TEL} SELECT event_id, ROUND(speed_kmh / 3.6::DOUBLE, 6) AS speed_ms, ROUND(accel_x / 9.80665::DOUBLE, 6) AS long_g,
      ROUND(SQRT(accel_x * accel_x + accel_y * accel_y) / 9.80665::DOUBLE, 6) AS planar_g, ROUND((event_id % 16384) * 9.81::DOUBLE / 16384, 6) AS counts_ms2,
      time AS from_epoch, time + INTERVAL 330 MINUTE AS local_time, STRFTIME(time, '%Y-%m-%dT%H:%M:%S.%f') AS iso, CASE WHEN engine_load_raw BETWEEN 0 AND 100 THEN engine_load_raw END AS load_clean FROM tel"""),
}
