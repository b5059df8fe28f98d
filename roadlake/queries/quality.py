"""Quality and description: A10-A28, W5, W6, W9, F12, F16-F18 on telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlake import fixtures as fx
from roadlake.functions import scalars as sc
from roadlake.operators import quality as q
from roadlake.plans import segmented as sg
from roadlake.plans.selection import percentile_columns, percentiles
from roadlake.queries.base import joined, rounded
from roadlake.session import materialize

V = ["vehicle_id"]
_ON = "rpm > 0"
_COLS = ["speed_kmh", "rpm", "coolant_temp_c", "engine_load_pct", "accel_x", "accel_y", "accel_z"]
_GAPS = (f"WITH {fx.TEL}, g AS (SELECT vehicle_id, event_id, (EPOCH_US(time) - LAG(EPOCH_US(time)) OVER w) / 1000000.0::DOUBLE AS gap_s "
         "FROM tel WINDOW w AS (PARTITION BY vehicle_id ORDER BY time, event_id))")
_RUNS = (fx.TEL + ", r0 AS (SELECT *, rpm > 0 AS st, LAG(rpm > 0) OVER w AS pst FROM tel WINDOW w AS (PARTITION BY vehicle_id ORDER BY time, event_id)),"
         " r1 AS (SELECT *, SUM(CASE WHEN pst IS NULL OR pst <> st THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM r0),"
         " runs AS (SELECT vehicle_id, run_id, ANY_VALUE(st) AS state, MIN(time) AS run_start, COUNT(*) AS n_rows, (EPOCH_US(MAX(time)) - EPOCH_US(MIN(time))) / 1000000.0::DOUBLE AS length_s FROM r1 GROUP BY 1, 2)")
_DESC = ("COUNT({c}) AS n, ROUND(AVG({c}),6) AS mean, ROUND(STDDEV_SAMP({c}),6) AS std, ROUND(MIN({c}),6) AS min, ROUND(QUANTILE_CONT({c},0.25),6) AS q25, "
         "ROUND(QUANTILE_CONT({c},0.5),6) AS q50, ROUND(QUANTILE_CONT({c},0.75),6) AS q75, ROUND(MAX({c}),6) AS max")
_FLAG = "throttle_pct < 20"
_SCORES = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]


def tel(spark, d):
    return fx.telemetry(spark, d)


def line(spark, d):
    return fx.table(spark, d, "lineitem")


def gap_pct(spark, d):
    g = percentile_columns(materialize(q.gaps(tel(spark, d), V), "gaps"), "gap_s", {"p50": .5, "p75": .75, "p90": .9, "p95": .95, "p99": .99})
    return rounded(g, 9)  # interpolated microseconds end within nine digits, so no ties


def pct_by_vehicle(spark, d):
    return rounded(percentiles(tel(spark, d), "rpm", [.01, .05, .1, .5, .9], V))


def flags(spark, d):
    st, off = F.col("speed_kmh") == 0, F.col("rpm") == 0
    return rounded(q.flag_rate_by(tel(spark, d), F.expr(_FLAG), {
        "stationary": st, "moving": F.col("speed_kmh") > 0, "engine_off": off, "engine_on": F.col("rpm") > 0, "driving": ~st & ~off}))


def _state(n, c):
    return (f"SELECT '{n}' AS state, COUNT(*) FILTER ({c}) AS n, ROUND(100 * AVG(CASE WHEN {c} THEN ({_FLAG})::INT END), 6) AS flag_pct, "
            f"ROUND(100 * AVG(COALESCE({c}, FALSE)::INT), 6) AS share_pct FROM tel")


def plaus(spark, d):
    r = tel(spark, d).groupBy("vehicle_id").agg((F.avg(F.expr(_FLAG).cast("double")) * 100).alias("flag_pct"))
    return rounded(r.withColumn("verdict", sc.plausibility("flag_pct", F.lit(10.0))))


def run_ids(spark, d):
    t = sg.with_segment(tel(spark, d), "time", 60)
    return sg.runs(t, V, ["time", "event_id"], F.expr(_ON)).select("vehicle_id", "event_id", "run_id")


def run_age(spark, d):
    r = q.run_position(tel(spark, d).withColumn("flag", F.expr(_FLAG)), V, F.expr(_ON))
    return rounded(q.flag_by_run_age(r, "flag", 3))


def share(spark, d):
    t = tel(spark, d)
    return rounded(q.share_beyond(t.where("vehicle_id = 3"), t.where("vehicle_id <> 3"), "rpm", .95))


def variants(spark, d):
    t = tel(spark, d)
    a = t.select((F.col("throttle_pct") < 20).alias("flag"), "rpm", "accel_x", "accel_y")
    b = t.select((F.col("throttle_pct") < 30).alias("flag"), "rpm", "accel_x", "accel_y")
    return rounded(q.compare_variants({"w60": a, "w30": b}, "flag", F.col("rpm") > 0, ["accel_x", "accel_y"]))


_VAR = ("SELECT '{n}' AS variant, ROUND(100 * AVG(flag::INT), 6) AS flag_pct, ROUND(100 * AVG(CASE WHEN rpm > 0 THEN flag::INT END), 6) AS engine_on_flag_pct, "
        "ROUND(MEDIAN(CASE WHEN rpm > 0 THEN ABS(accel_x) END), 6) AS median_abs_accel_x, ROUND(MEDIAN(CASE WHEN rpm > 0 THEN ABS(accel_y) END), 6) AS median_abs_accel_y "
        "FROM (SELECT *, throttle_pct < {t} AS flag FROM tel)")


def split_rep(spark, d):
    t = tel(spark, d).withColumn("split", F.expr("CASE WHEN user_id % 20 < 14 THEN 'train' WHEN user_id % 20 < 17 THEN 'val' ELSE 'test' END"))
    return rounded(q.split_report(t, "split", "user_id", {"train": .7, "val": .15, "test": .15}))


_HIST = ("WITH {src}, h AS (SELECT {by}LEAST(FLOOR(({c} - {lo}) * {n} / ({hi} - {lo})), {n} - 1)::INT AS bin, COUNT(*) AS n FROM {t} WHERE {c} BETWEEN {lo} AND {hi} GROUP BY ALL) "
         "SELECT {by}bin, ROUND({lo} + bin * ({hi} - {lo})::DOUBLE / {n}, 6) AS bin_lo, n, ROUND(n / (SUM(n) OVER ({pb}) * ({hi} - {lo})::DOUBLE / {n}), 6) AS density FROM h")

QUERIES = {
    "trip_bounds": (lambda s, d: q.trip_bounds(fx.trips(s, d)), f"WITH {fx.trips_sql()} SELECT vehicle_id, trip, MIN(time) AS start_time, MAX(time) AS end_time, COUNT(time) AS n_rows FROM trips GROUP BY 1, 2"),
    "null_fraction": (lambda s, d: rounded(q.null_fraction(tel(s, d), "user_id", "engine_load_pct")),
                      f"WITH {fx.TEL} SELECT user_id, ROUND(AVG((engine_load_pct IS NULL)::INT), 6) AS null_frac FROM tel GROUP BY 1"),
    "describe": (lambda s, d: rounded(q.describe(tel(s, d), _COLS)), f"WITH {fx.TEL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_DESC.format(c=c)} FROM tel" for c in _COLS)),
    "describe_by_vehicle": (lambda s, d: rounded(q.describe(tel(s, d), ["rpm"], V)), f"WITH {fx.TEL} SELECT vehicle_id, 'rpm' AS \"column\", {_DESC.format(c='rpm')} FROM tel GROUP BY 1"),
    "describe_prices": (lambda s, d: rounded(q.describe(line(s, d), ["l_quantity", "l_extendedprice", "l_discount"]), 4), " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_DESC.format(c=c).replace(',6)', ',4)')} FROM lineitem" for c in ["l_quantity", "l_extendedprice", "l_discount"])),
    "corr_matrix": (lambda s, d: rounded(q.corr_matrix(tel(s, d), _COLS)), f"WITH {fx.TEL} " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CORR({a}, {b}), 6) AS r FROM tel" for a in _COLS for b in _COLS)),
    "gap_counts": (lambda s, d: q.gap_counts(tel(s, d), V).withColumnRenamed("count", "n"), f"{_GAPS} SELECT FLOOR(gap_s * 100) / 100::DOUBLE AS gap_s, COUNT(*) AS n FROM g WHERE gap_s IS NOT NULL GROUP BY 1"),
    "gap_quantiles": (gap_pct, f"{_GAPS} SELECT " + ", ".join(f"ROUND(QUANTILE_CONT(gap_s, {p / 100}), 9) AS p{p}" for p in (50, 75, 90, 95, 99)) + " FROM g"),
    "score_percentiles": (lambda s, d: rounded(percentiles(tel(s, d), "rpm", _SCORES)), f"WITH {fx.TEL} " + " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS p, ROUND(QUANTILE_CONT(rpm, {p}), 6) AS value FROM tel" for p in _SCORES)),
    "score_percentiles_by_vehicle": (pct_by_vehicle, f"WITH {fx.TEL} " + " UNION ALL ".join(
        f"SELECT vehicle_id, {p}::DOUBLE AS p, ROUND(QUANTILE_CONT(rpm, {p}), 6) AS value FROM tel GROUP BY 1" for p in (.01, .05, .1, .5, .9))),
    "feature_std": (lambda s, d: rounded(q.feature_std(tel(s, d), ["rpm", "engine_load_pct"], V)), f"WITH {fx.TEL} SELECT vehicle_id, ROUND(STDDEV_SAMP(rpm), 6) AS rpm_std, ROUND(STDDEV_SAMP(engine_load_pct), 6) AS engine_load_pct_std FROM tel GROUP BY 1"),
    "histogram": (lambda s, d: rounded(q.histogram(tel(s, d), "rpm", 0, 5000, 80)), _HIST.format(src=fx.TEL, by="", c="rpm", lo=0, hi=5000, n=80, t="tel", pb="")),
    "histogram_by_state": (lambda s, d: rounded(q.histogram(tel(s, d), "accel_x", -6, 6, 60, ["vehicle_id"])),
                           _HIST.format(src=fx.TEL, by="vehicle_id, ", c="accel_x", lo=-6, hi=6, n=60, t="tel", pb="PARTITION BY vehicle_id")),
    "flag_rate_by_state": (flags, f"WITH {fx.TEL} " + " UNION ALL ".join([
        _state("stationary", "speed_kmh = 0"), _state("moving", "speed_kmh > 0"), _state("engine_off", "rpm = 0"), _state("engine_on", "rpm > 0"),
        _state("driving", "NOT (speed_kmh = 0) AND NOT (rpm = 0)")])),
    "plausibility": (plaus, f"WITH {fx.TEL}, r AS (SELECT vehicle_id, 100 * AVG(({_FLAG})::INT) AS p FROM tel GROUP BY 1) SELECT vehicle_id, ROUND(p, 6) AS flag_pct, "
                     "CASE WHEN p <= 20 THEN 'plausible' ELSE 'elevated' END AS verdict FROM r"),
    "completeness_gap": (lambda s, d: rounded(q.completeness_gap(tel(s, d), V), 7), _GAPS + """, m AS (SELECT vehicle_id, MEDIAN(gap_s) AS e FROM g GROUP BY 1),
      l AS (SELECT vehicle_id, COUNT(*) FILTER (gap_s > 3 * e) AS loss_events, COALESCE(SUM(CASE WHEN gap_s > 3 * e THEN gap_s - e END), 0) AS lost_s FROM g JOIN m USING (vehicle_id) GROUP BY 1),
      t AS (SELECT vehicle_id, (EPOCH_US(MAX(time)) - EPOCH_US(MIN(time))) / 1000000.0::DOUBLE AS dur, COUNT(rpm) AS n1, COUNT(speed_kmh) AS n2, COUNT(coolant_temp_c) AS n3, COUNT(engine_load_pct) AS n4 FROM tel GROUP BY 1),
      x AS (SELECT *, dur / e AS ec, ROUND_EVEN(100 * n1 / (dur / e), 1) AS p1, ROUND_EVEN(100 * n2 / (dur / e), 1) AS p2, ROUND_EVEN(100 * n3 / (dur / e), 1) AS p3, ROUND_EVEN(100 * n4 / (dur / e), 1) AS p4
        FROM t JOIN m USING (vehicle_id) JOIN l USING (vehicle_id))
      SELECT vehicle_id, ROUND(e, 7) AS expected_interval_s, ROUND(dur, 7) AS duration_s, ROUND(ec, 7) AS expected_count, loss_events, ROUND(lost_s, 7) AS lost_s, ROUND(100 * lost_s / dur, 7) AS lost_pct,
        p1 AS rpm_pct, p2 AS speed_kmh_pct, p3 AS coolant_temp_c_pct, p4 AS engine_load_pct_pct, ROUND((p1 + p2 + p3 + p4) / 4, 7) AS overall_pct FROM x"""),
    "completeness_per_second": (lambda s, d: rounded(q.completeness_per_second(tel(s, d), V)), f"""WITH {fx.TEL}, s AS (SELECT *, DATE_TRUNC('second', time) AS sec FROM tel),
      t AS (SELECT vehicle_id, (EPOCH_US(MAX(time)) - EPOCH_US(MIN(time))) // 1000000 + 1 AS e, COUNT(DISTINCT CASE WHEN rpm IS NOT NULL THEN sec END) AS n1, COUNT(DISTINCT CASE WHEN speed_kmh IS NOT NULL THEN sec END) AS n2,
        COUNT(DISTINCT CASE WHEN coolant_temp_c IS NOT NULL THEN sec END) AS n3, COUNT(DISTINCT CASE WHEN engine_load_pct IS NOT NULL THEN sec END) AS n4 FROM s GROUP BY 1),
      x AS (SELECT vehicle_id, e, ROUND_EVEN(100.0::DOUBLE * n1 / e, 1) AS p1, ROUND_EVEN(100.0::DOUBLE * n2 / e, 1) AS p2, ROUND_EVEN(100.0::DOUBLE * n3 / e, 1) AS p3, ROUND_EVEN(100.0::DOUBLE * n4 / e, 1) AS p4 FROM t)
      SELECT vehicle_id, e AS expected_seconds, p1 AS rpm_pct, p2 AS speed_kmh_pct, p3 AS coolant_temp_c_pct, p4 AS engine_load_pct_pct, ROUND((p1 + p2 + p3 + p4) / 4, 6) AS overall_pct FROM x"""),
    "missing_runs": (lambda s, d: q.missing_runs(tel(s, d), ["user_id"]), f"""WITH {fx.TEL}, s AS (SELECT DISTINCT user_id, EPOCH_US(time) // 1000000 AS sec FROM tel),
      g AS (SELECT user_id, sec, LAG(sec) OVER (PARTITION BY user_id ORDER BY sec) AS p FROM s) SELECT user_id, MAKE_TIMESTAMP((p + 1) * 1000000) AS run_start, sec - p - 1 AS run_len FROM g WHERE sec - p - 1 >= 2"""),
    "missing_summary": (lambda s, d: rounded(q.missing_summary(tel(s, d), V)), f"""WITH {fx.TEL}, b AS (SELECT vehicle_id, EPOCH_US(MIN(time)) // 1000000 AS lo, EPOCH_US(MAX(time)) // 1000000 AS hi,
        (EPOCH_US(MAX(time)) - EPOCH_US(MIN(time))) // 1000000 + 1 AS expected_seconds FROM tel GROUP BY 1),
      allsec AS (SELECT vehicle_id, UNNEST(RANGE(lo, hi + 1)) AS sec FROM b), s AS (SELECT DISTINCT vehicle_id, EPOCH_US(time) // 1000000 AS sec FROM tel),
      m AS (SELECT vehicle_id, sec - ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY sec) AS island FROM (SELECT * FROM allsec EXCEPT SELECT * FROM s)),
      r AS (SELECT vehicle_id, island, COUNT(*) AS n FROM m GROUP BY 1, 2 HAVING COUNT(*) >= 2), t AS (SELECT vehicle_id, COUNT(*) AS loss_events, SUM(n)::BIGINT AS lost_s FROM r GROUP BY 1)
      SELECT vehicle_id, expected_seconds, COALESCE(loss_events, 0) AS loss_events, COALESCE(lost_s, 0) AS lost_s, ROUND(100.0::DOUBLE * COALESCE(lost_s, 0) / expected_seconds, 6) AS lost_pct FROM b LEFT JOIN t USING (vehicle_id)"""),
    "null_counts": (lambda s, d: q.null_counts(tel(s, d), _COLS), f"WITH {fx.TEL} SELECT " + ", ".join(f"COUNT(*) FILTER ({c} IS NULL) AS {c}" for c in _COLS) + " FROM tel"),
    "split_report": (split_rep, f"""WITH {fx.TEL}, t AS (SELECT *, CASE WHEN user_id % 20 < 14 THEN 'train' WHEN user_id % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM tel),
      g AS (SELECT split, COUNT(DISTINCT user_id) AS n_keys, COUNT(*) AS n_rows FROM t GROUP BY 1) SELECT split, n_keys, ROUND(100 * n_keys / (SELECT COUNT(DISTINCT user_id) FROM t)::DOUBLE, 6) AS keys_pct,
      n_rows, ROUND(100 * n_rows / (SELECT COUNT(*) FROM t)::DOUBLE, 6) AS rows_pct, CASE split WHEN 'train' THEN 70.0 ELSE 15.0 END::DOUBLE AS target_pct FROM g"""),
    "rows_per_trip": (lambda s, d: rounded(q.rows_per_trip(fx.trips(s, d), ["vehicle_id", "trip"])), f"WITH {fx.trips_sql()}, n AS (SELECT COUNT(*)::DOUBLE AS rows_ FROM trips GROUP BY vehicle_id, trip) "
                      f"SELECT 'rows' AS \"column\", {_DESC.format(c='rows_')} FROM n"),
    "label_counts": (lambda s, d: q.label_counts(fx.trips(s, d).withColumn("label", F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string"))), ["vehicle_id", "trip"], "label", F.struct("time", "event_id")),
                     f"WITH {fx.trips_sql()}, f AS (SELECT 'c' || (event_id % 4) AS label, ROW_NUMBER() OVER (PARTITION BY vehicle_id, trip ORDER BY time, event_id) AS k FROM trips) SELECT label, COUNT(*) AS n_trips FROM f WHERE k = 1 GROUP BY 1"),
    "share_beyond": (share, f"WITH {fx.TEL}, l AS (SELECT QUANTILE_CONT(ABS(rpm), 0.95) AS lim FROM tel WHERE vehicle_id <> 3) SELECT ROUND(lim, 6) AS ref_limit, COUNT(*) AS n, "
                     "ROUND(AVG((ABS(rpm) > lim)::INT), 6) AS share_beyond FROM tel, l WHERE vehicle_id = 3 AND rpm IS NOT NULL GROUP BY lim"),
    "compare_variants": (variants, f"WITH {fx.TEL} " + _VAR.format(n="w60", t=20) + " UNION ALL " + _VAR.format(n="w30", t=30)),
    "liveness": (lambda s, d: rounded(q.liveness(tel(s, d), V, ["rpm", "speed_kmh", "throttle_pct"])), f"WITH {fx.TEL} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT ROUND(MAX(n) / SUM(n)::DOUBLE, 6) FROM (SELECT COUNT(*) AS n FROM tel WHERE {c} IS NOT NULL GROUP BY {c})) AS top_share,
        ROUND(AVG((x <> p)::INT), 6) AS change_share FROM (SELECT {c} AS x, LAG({c}) OVER (PARTITION BY vehicle_id ORDER BY time, event_id) AS p FROM tel)""" for c in ["rpm", "speed_kmh", "throttle_pct"])),
    "run_ids": (run_ids, f"WITH {_RUNS} SELECT vehicle_id, event_id, run_id FROM r1"),
    "stretches": (lambda s, d: rounded(q.stretches(tel(s, d), V, F.expr(_ON))), f"WITH {_RUNS} SELECT vehicle_id, run_id, state, run_start, n_rows, ROUND(length_s, 6) AS length_s FROM runs"),
    "stretch_stats": (lambda s, d: rounded(q.stretch_stats(tel(s, d), V, F.expr(_ON), 2, 5)),
                      f"WITH {_RUNS} SELECT {_DESC.format(c='length_s')}, ROUND(AVG((length_s < 2)::INT), 6) AS share_short, COUNT(*) FILTER (length_s >= 5) AS n_long FROM runs WHERE state"),
    "run_position": (lambda s, d: q.run_position(tel(s, d), V, F.expr(_ON)).select("vehicle_id", "event_id", "run_pos"),
                     f"WITH {_RUNS} SELECT vehicle_id, event_id, ROW_NUMBER() OVER (PARTITION BY vehicle_id, run_id ORDER BY time, event_id) - 1 AS run_pos FROM r1"),
    "flag_by_run_age": (run_age, f"WITH {_RUNS}, p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id, run_id ORDER BY time, event_id) - 1 AS k FROM r1) "
                        f"SELECT CASE WHEN k < 3 THEN 'early' ELSE 'later' END AS phase, COUNT(*) AS n, ROUND(100 * AVG(({_FLAG})::INT), 6) AS flag_pct FROM p WHERE st GROUP BY 1"),
    "session_completeness": (lambda s, d: rounded(q.completeness_per_second(joined(s, d), ["session_id"], ["rpm", "speed_kmh"])), f"""WITH {fx.JOINED}, s AS (SELECT *, DATE_TRUNC('second', time) AS sec FROM j),
      t AS (SELECT session_id, (EPOCH_US(MAX(time)) - EPOCH_US(MIN(time))) // 1000000 + 1 AS e, COUNT(DISTINCT CASE WHEN rpm IS NOT NULL THEN sec END) AS n1, COUNT(DISTINCT CASE WHEN speed_kmh IS NOT NULL THEN sec END) AS n2 FROM s GROUP BY 1),
      x AS (SELECT session_id, e, ROUND_EVEN(100.0::DOUBLE * n1 / e, 1) AS p1, ROUND_EVEN(100.0::DOUBLE * n2 / e, 1) AS p2 FROM t)
      SELECT session_id, e AS expected_seconds, p1 AS rpm_pct, p2 AS speed_kmh_pct, ROUND((p1 + p2) / 2, 6) AS overall_pct FROM x"""),
}
