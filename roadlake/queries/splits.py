"""Splits, selection and volume curves: M3-M5, M17, J9, J10, W11-W17, S13."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlake import fixtures as fx
from roadlake.operators import quality as q
from roadlake.operators import splits as sp
from roadlake.operators import volume as vo
from roadlake.queries.base import rounded

_MIX = "(({c} * 7919) % 10007)"


def mix(c: str):
    return F.expr(_MIX.format(c=c))


def counts(spark, d):
    return sp.row_counts(fx.telemetry(spark, d), "user_id")


def trip_split(spark, d):
    t = fx.telemetry(spark, d).withColumn("trip_id", F.col("user_id") * 10 + F.col("event_id") % 7)
    return sp.trip_split(t, order=mix("trip_id"))


def greedy(spark, d):
    return sp.balanced_split(counts(spark, d), "user_id", tie=mix("user_id"))


# one recursion step per vehicle, largest first
_GREEDY = (f"WITH RECURSIVE {fx.TEL}, c AS (SELECT user_id, COUNT(*) AS n_rows FROM tel GROUP BY 1), o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n_rows DESC, {_MIX.format(c='user_id')}, user_id) AS k, "
           "(SUM(n_rows) OVER ())::DOUBLE AS tot FROM c), "
           "g AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS user_id, 0::BIGINT AS n_rows, '' AS split, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c UNION ALL "
           "SELECT k, user_id, n_rows, split, a + CASE split WHEN 'train' THEN n_rows ELSE 0 END, b + CASE split WHEN 'val' THEN n_rows ELSE 0 END, c + CASE split WHEN 'test' THEN n_rows ELSE 0 END FROM ("
           "SELECT o.k, o.user_id, o.n_rows, a, b, c, CASE WHEN da >= db AND da >= dc THEN 'train' WHEN db >= dc THEN 'val' ELSE 'test' END AS split FROM ("
           "SELECT o.*, g.a, g.b, g.c, (tot * 0.7::DOUBLE - g.a) / (tot * 0.7::DOUBLE) AS da, (tot * 0.15::DOUBLE - g.b) / (tot * 0.15::DOUBLE) AS db, (tot * 0.15::DOUBLE - g.c) / (tot * 0.15::DOUBLE) AS dc "
           "FROM g JOIN o ON o.k = g.k + 1) o)), sp AS (SELECT user_id, n_rows, split FROM g WHERE k > 0)")


def manifest(spark, d):
    return sp.manifest(greedy(spark, d), counts(spark, d), "user_id")


def reuse(spark, d):
    return sp.apply_manifest(fx.telemetry(spark, d), greedy(spark, d), "user_id").select("event_id", "split")


def pools(spark, d):
    """A manifest of two pools: users as vehicles, powertrain from the user's parity."""
    g = greedy(spark, d).withColumn("powertrain", F.when(F.col("user_id") % 3 == 0, "HEV").otherwise("ICE"))
    s = F.when(F.col("user_id") % 2 == 0, F.lit(" Test")).otherwise(F.lit("train"))
    return g.select(F.col("user_id").alias("vehicle_id"), "powertrain", s.alias("split"), F.col("n_rows").alias("row_count"))


_POOLS = (f"WITH {fx.TEL}, p AS (SELECT user_id AS vehicle_id, CASE WHEN user_id % 3 = 0 THEN 'HEV' ELSE 'ICE' END AS powertrain, COUNT(*) AS row_count FROM tel WHERE user_id % 2 = 0 GROUP BY 1, 2), "
          "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY powertrain ORDER BY row_count, vehicle_id) - 1 AS i, COUNT(*) OVER (PARTITION BY powertrain) AS n FROM p), "
          "t AS (SELECT *, CASE WHEN 3 * i < n - 1 THEN 'low' WHEN 3 * i < 2 * (n - 1) THEN 'medium' ELSE 'high' END AS row_count_tercile FROM r)")


def terciles(spark, d):
    p = pools(spark, d).where("TRIM(LOWER(split)) = 'test'")
    return sp.rank_bucket(p, "row_count", "vehicle_id", ["powertrain"]).select("vehicle_id", "powertrain", "row_count", "row_count_tercile")


def select(spark, d):
    return sp.select_vehicles(pools(spark, d), 2, order=mix("vehicle_id"))


def trip_days(spark, d):
    """One trip per vehicle and day, on the uncompressed clock."""
    e = fx.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("time"))
    e = e.withColumn("trip", F.datediff(F.to_date("time"), F.lit("2024-01-01").cast("date")).cast("int"))
    return q.trip_bounds(e, ["user_id", "trip"])


_DAYS = "WITH td AS (SELECT user_id, DATE_DIFF('day', DATE '2024-01-01', CAST(ts AS DATE))::INT AS trip, MIN(ts) AS start_time, MAX(ts) AS end_time, COUNT(*) AS n_rows FROM events GROUP BY 1, 2)"
_HOLD = (_DAYS + ", h0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY start_time, trip) - 1 AS i, COUNT(*) OVER (PARTITION BY user_id) AS n, MIN(start_time) OVER (PARTITION BY user_id) AS first_time FROM td), "
         "h1 AS (SELECT *, GREATEST(3, CEIL(n * 0.2::DOUBLE))::BIGINT AS k FROM h0), h AS (SELECT *, CASE WHEN n - k < 1 THEN 'rejected' WHEN i >= n - k THEN 'test' ELSE 'train' END AS role FROM h1)")


def hold(spark, d):
    return sp.hold_out_last(trip_days(spark, d), "user_id").select("user_id", "trip", "first_time", "role")


def steps(spark, d):
    h = sp.hold_out_last(trip_days(spark, d), "user_id").where("role = 'train'")
    return sp.volume_steps(h).select("user_id", "trip", "day_cutoff")


def curves(spark, d):
    """Detection-like curves from events: share of readings over a limit in the
    first days of each vehicle, for two magnitudes and three limits."""
    e = fx.table(spark, d, "events").select("user_id", F.col("event_type").alias("fault_type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    first = e.groupBy("user_id").agg(F.min("us").alias("f"))
    cut = F.array(*[F.struct(F.lit(str(n)).alias("day_cutoff"), F.lit(n * 86400000000).alias("w")) for n in (1, 3, 7, 14, 30)],
                  F.struct(F.lit("all").alias("day_cutoff"), F.lit(10**17).alias("w")))
    e = e.join(first, "user_id").withColumn("c", F.explode(cut)).where(F.col("us") - F.col("f") <= F.col("c.w"))
    e = e.withColumn("std_multiple", F.explode(F.array(F.lit(3.0), F.lit(5.0))))
    rate = lambda lim: F.avg((F.col("value") * F.col("std_multiple") / 3 > lim).cast("double"))
    g = e.groupBy("user_id", "fault_type", "std_multiple", F.col("c.day_cutoff").alias("day_cutoff")).agg(
        rate(60).alias("detect_rate_at_2pct_fpr"), rate(40).alias("detect_rate_at_5pct_fpr"), rate(20).alias("detect_rate_at_10pct_fpr"),
        F.bround((F.max("us") - F.first("f")) / 86400e6, 2).alias("actual_train_span_days"))
    pt = F.when(F.col("user_id") % 2 == 0, "ICE").otherwise("HEV")
    return vo.check_results(g.select(F.col("user_id").alias("vehicle_id"), pt.alias("powertrain"), *[c for c in g.columns if c != "user_id"]))


_CURVES = """WITH f AS (SELECT user_id, MIN(EPOCH_US(ts)) AS f FROM events GROUP BY 1), cut(day_cutoff, w) AS (VALUES ('1', 86400000000), ('3', 259200000000), ('7', 604800000000), ('14', 1209600000000), ('30', 2592000000000), ('all', 100000000000000000)),
 m(std_multiple) AS (VALUES (3.0::DOUBLE), (5.0::DOUBLE)),
 cv AS (SELECT user_id AS vehicle_id, CASE WHEN user_id % 2 = 0 THEN 'ICE' ELSE 'HEV' END AS powertrain, event_type AS fault_type, std_multiple, day_cutoff, AVG((value * std_multiple / 3 > 60)::INT) AS detect_rate_at_2pct_fpr,
  AVG((value * std_multiple / 3 > 40)::INT) AS detect_rate_at_5pct_fpr, AVG((value * std_multiple / 3 > 20)::INT) AS detect_rate_at_10pct_fpr, ROUND_EVEN((MAX(EPOCH_US(ts)) - ANY_VALUE(f)) / 86400000000.0::DOUBLE, 2) AS actual_train_span_days
  FROM events JOIN f USING (user_id) JOIN cut ON EPOCH_US(ts) - f <= w CROSS JOIN m GROUP BY ALL),
 dd AS (SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id, fault_type, std_multiple, actual_train_span_days ORDER BY day_cutoff DESC) AS k FROM cv) WHERE k = 1)"""
_RATES = "ROUND(detect_rate_at_2pct_fpr, 6) AS detect_rate_at_2pct_fpr, ROUND(detect_rate_at_5pct_fpr, 6) AS detect_rate_at_5pct_fpr, ROUND(detect_rate_at_10pct_fpr, 6) AS detect_rate_at_10pct_fpr"


def deduped(spark, d):
    return vo.dedupe_flat(curves(spark, d))


QUERIES = {
    "trip_split": (trip_split, f"""WITH {fx.TEL}, k AS (SELECT DISTINCT user_id * 10 + event_id % 7 AS trip_id FROM tel), r AS (SELECT trip_id, ROW_NUMBER() OVER (ORDER BY {_MIX.format(c='trip_id')}, trip_id) - 1 AS i, COUNT(*) OVER () AS n FROM k),
      s AS (SELECT *, GREATEST(1, ROUND_EVEN(n * 0.15::DOUBLE, 0)) AS v FROM r) SELECT trip_id, CASE WHEN i < v THEN 'val' WHEN i < 2 * v THEN 'test' ELSE 'train' END AS split FROM s"""),
    "balanced_vehicle_split": (greedy, _GREEDY + " SELECT user_id, n_rows, split FROM sp"),
    "split_manifest": (manifest, _GREEDY + " SELECT user_id, split, n_rows FROM sp"),
    "reuse_split": (reuse, _GREEDY + " SELECT event_id, split FROM tel JOIN sp USING (user_id)"),
    "ensure_row_counts": (lambda s, d: sp.ensure_row_counts(fx.table(s, d, "customer").select(F.col("c_custkey").alias("user_id")), fx.telemetry(s, d), "user_id"),
                          f"WITH {fx.TEL}, n AS (SELECT user_id, COUNT(*) AS row_count FROM tel GROUP BY 1) SELECT c_custkey AS user_id, COALESCE(row_count, 0) AS row_count FROM customer LEFT JOIN n ON c_custkey = user_id"),
    "size_terciles": (terciles, _POOLS + " SELECT vehicle_id, powertrain, row_count, row_count_tercile FROM t"),
    "select_vehicles": (select, _POOLS + f", k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY powertrain, row_count_tercile ORDER BY {_MIX.format(c='vehicle_id')}) AS rn FROM t) SELECT vehicle_id, powertrain, row_count, row_count_tercile FROM k WHERE rn <= 2"),
    "hold_out_last": (hold, _HOLD + " SELECT user_id, trip, first_time, role FROM h"),
    "volume_steps": (steps, _HOLD + ", cut(day_cutoff, days) AS (VALUES ('1', 1), ('3', 3), ('7', 7), ('14', 14), ('30', 30), ('all', 100000)) SELECT user_id, trip, day_cutoff FROM h JOIN cut ON start_time <= first_time + TO_DAYS(days) WHERE role = 'train'"),
    "volume_curves": (lambda s, d: rounded(curves(s, d)), _CURVES + f" SELECT vehicle_id, powertrain, fault_type, std_multiple, day_cutoff, {_RATES}, actual_train_span_days FROM cv"),
    "dedupe_flat_steps": (lambda s, d: rounded(deduped(s, d)), _CURVES + f" SELECT vehicle_id, powertrain, fault_type, std_multiple, day_cutoff, {_RATES}, actual_train_span_days FROM dd"),
    "saturation_days": (lambda s, d: vo.saturation(deduped(s, d)), _CURVES + """, mx AS (SELECT *, MAX(detect_rate_at_2pct_fpr) OVER (PARTITION BY powertrain, vehicle_id, fault_type) AS m FROM dd WHERE std_multiple = 3)
      SELECT powertrain, vehicle_id, fault_type, ROUND_EVEN(ANY_VALUE(m), 3) AS own_max_detect_rate, ROUND_EVEN(MIN(CASE WHEN detect_rate_at_2pct_fpr >= m * 0.95::DOUBLE THEN actual_train_span_days END), 1) AS saturation_days_at_95pct_of_own_max FROM mx GROUP BY 1, 2, 3"""),
    "stabilization_days": (lambda s, d: vo.stabilization(deduped(s, d)), _CURVES + """, x AS (SELECT *, LAST_VALUE(detect_rate_at_2pct_fpr) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin,
      MAX(detect_rate_at_2pct_fpr) OVER (PARTITION BY powertrain, vehicle_id, fault_type) AS m FROM dd WHERE std_multiple = 3 WINDOW w AS (PARTITION BY powertrain, vehicle_id, fault_type ORDER BY actual_train_span_days)),
      y AS (SELECT *, MAX((ABS(detect_rate_at_2pct_fpr - fin) > 0.1::DOUBLE)::INT) OVER (PARTITION BY powertrain, vehicle_id, fault_type ORDER BY actual_train_span_days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bad FROM x)
      SELECT powertrain, vehicle_id, fault_type, ROUND_EVEN(ANY_VALUE(fin), 3) AS final_detect_rate, ROUND_EVEN(ANY_VALUE(m), 3) AS own_max_detect_rate, ROUND_EVEN(ANY_VALUE(m - fin), 3) AS max_minus_final_gap,
      ROUND_EVEN(MIN(CASE WHEN bad = 0 THEN actual_train_span_days END), 1) AS "stabilizes_from_days_within_0.1" FROM y GROUP BY 1, 2, 3"""),
}
