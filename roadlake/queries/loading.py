"""Sources and sinks over files written from the driver's tables: S1-S12, K2-K5, U4."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlake import fixtures as fx
from roadlake.operators import cleaning as cl
from roadlake.operators import faults as fa
from roadlake.operators import forest as fo
from roadlake.operators import splits as sp
from roadlake.operators import volume as vo
from roadlake.queries import anomaly as an
from roadlake.queries import features as qf
from roadlake.queries import splits as qs
from roadlake.queries.base import rounded
from roadlake.schemas import TRIP_HEADER, WEEKLY_HEADER
from roadlake.session import workspace
from roadlake.sources import files as fs
from roadlake.sources import sinks

_LABELS = ["Normal", "Frei", "Stau", "Glatteis"]


def trip_files(spark, d):
    """One file per vehicle; clocks start two minutes before midnight."""
    path = workspace(spark, "trips")
    t = fx.telemetry(spark, d)
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), F.col("vehicle_id") % 4 + 1)
    name = F.concat(F.lit("2018-03-0"), (F.col("vehicle_id") + 1).cast("string"), F.lit("_Car_"), label, F.lit(".csv"))
    clock = F.date_format(F.timestamp_micros(F.unix_micros("time") + F.lit(86280000000)), "HH:mm:ss.SSS")
    vals = {"time_str": clock, "coolant_temp_c": F.col("coolant_temp_c"), "rpm": F.col("rpm"), "speed_kmh": F.col("speed_kmh"), "throttle_pct": F.col("throttle_pct")}
    cols = [vals.get(c, F.col("event_id").cast("double")).alias(h) for h, c in TRIP_HEADER.items()]
    t.withColumn("source_file", name).repartition("source_file").sortWithinPartitions("source_file", "time", "event_id").select(*cols, "source_file").write.partitionBy("source_file").option("header", "true").csv(path)
    return path


def load_trips(spark, d):
    t = fs.load_trips(spark, trip_files(spark, d))
    return t.select("trip_id", "source_file", "condition", "timestamp", "coolant_temp_c", "rpm", "speed_kmh", F.col("map_kpa").cast("long").alias("event_id"))


_TRIPS = f"""WITH {fx.TEL} SELECT vehicle_id AS trip_id, CONCAT('2018-03-0', vehicle_id + 1, '_Car_', ['Normal', 'Frei', 'Stau', 'Glatteis'][vehicle_id % 4 + 1], '.csv') AS source_file,
 ['normal', 'free_flow', 'traffic_jam', 'black_ice'][vehicle_id % 4 + 1] AS condition, MAKE_TIMESTAMP(EPOCH_US(TIMESTAMP '2018-03-01') + (vehicle_id * 86400000000) + ((EPOCH_US(time) - 1704067200000000 + 86280000000) // 1000) * 1000) AS timestamp,
 coolant_temp_c, rpm, speed_kmh, event_id FROM tel"""


def weekly(spark, d):
    path = workspace(spark, "weekly")
    inv = {v: k for k, v in WEEKLY_HEADER.items()}
    raw = qf.raw_pool(spark, d).withColumnRenamed("user_id", "vehicle_id").withColumn("trip", F.col("event_id"))
    out = raw.select(*[F.col(c).alias(inv[c]) for c in WEEKLY_HEADER.values()], F.lit("x").alias("Unused[-]"), (F.col("event_id") % 3).cast("int").alias("week"))
    out.write.partitionBy("week").option("header", "true").csv(path)
    return fs.load_weekly(spark, path, glob="*.csv")


def static(spark, d):
    path = workspace(spark, "static")
    s = qf.static(spark, d)
    for part, kinds, col in (("a", ["ICE", "HEV"], "Vehicle Type"), ("b", ["PHEV", "EV"], "EngineType")):
        s.where(F.col("engine_type").isin(*kinds)).select(F.col("user_id").alias("VehId"), F.col("engine_type").alias(col)).write.option("header", "true").csv(f"{path}/{part}")
    r = spark.read.option("header", "true")
    return fs.load_static((r.csv(f"{path}/a"), "Vehicle Type"), (r.csv(f"{path}/b"), "EngineType"))


def pools(spark, d):
    path = workspace(spark, "pools")
    sinks.write_pools(cl.with_engine_type(qf.raw_pool(spark, d), qf.static(spark, d), "user_id"), path)
    return spark.read.parquet(path).select("event_id", "user_id", "engine_type")


def manifest_file(spark, d):
    path = workspace(spark, "manifest")
    m = qs.manifest(spark, d).select(F.col("user_id").alias("VehId"), F.concat(F.lit(" "), F.upper("split")).alias("split"), "n_rows")
    sinks.write_table_csv(m, path)
    return fs.load_manifest(spark, path)


def results_file(spark, d):
    path = workspace(spark, "results")
    sinks.write_table_csv(qs.curves(spark, d), path)
    return rounded(vo.saturation(vo.dedupe_flat(fs.load_results(spark, path)), 5, 5.0, 0.9))


def split_stage(spark, d):
    path = workspace(spark, "split")
    sinks.write_stage(sp.apply_manifest(fx.telemetry(spark, d), qs.greedy(spark, d), "user_id").select("event_id", "rpm", "split"), path, "split")
    return fs.read_columns(spark, path, ["event_id", "split"]).where("split = 'val'")


def config_file(spark, d):
    path = workspace(spark, "config")
    sinks.write_config(fa.choose(an.tradeoff(spark, d)), path)
    return rounded(spark.read.json(path).select("threshold", "target_fpr_pct", "actual_fpr_pct", F.array_join("feature_cols", ",").alias("features")))


def model_file(spark, d):
    path = workspace(spark, "model")
    fo.Forest(an.probe_nodes(an.POOL), an.POOL).save(spark, path)
    model = fo.Forest.load(spark, path, an.POOL)
    return rounded(model.score(an.pool(spark, d)).select("event_id", F.round("score", 9).alias("score")))


def sql(spark, d):
    return fs.sql_scan(spark, "SELECT event_id, rpm FROM {t} WHERE vehicle_id = :v AND rpm > :r", {"v": 2, "r": 900.0}, t=fx.telemetry(spark, d))


QUERIES = {
    "load_trip_files": (load_trips, _TRIPS),
    "load_weekly_files": (lambda s, d: weekly(s, d).select("vehicle_id", "trip", "offset_ms", "speed_kmh", "rpm", "engine_load_pct"),
                          f"WITH {qf.RAW} SELECT user_id AS vehicle_id, event_id AS trip, offset_ms, speed_kmh, rpm, engine_load_pct FROM raw"),
    "load_static_files": (static, f"WITH {qf.STATIC} SELECT user_id AS vehicle_id, engine_type FROM st"),
    "write_pools": (pools, f"WITH {qf.RAW}, {qf.STATIC} SELECT event_id, user_id, engine_type FROM raw JOIN st USING (user_id) WHERE engine_type IN ('ICE', 'HEV')"),
    "manifest_file": (manifest_file, qs._GREEDY + " SELECT user_id AS vehicle_id, split, n_rows AS row_count FROM sp"),
    "results_file": (results_file, qs._CURVES + """, mx AS (SELECT *, MAX(detect_rate_at_5pct_fpr) OVER (PARTITION BY powertrain, vehicle_id, fault_type) AS m FROM dd WHERE std_multiple = 5)
      SELECT powertrain, vehicle_id, fault_type, ROUND_EVEN(ANY_VALUE(m), 3) AS own_max_detect_rate, ROUND_EVEN(MIN(CASE WHEN detect_rate_at_5pct_fpr >= m * 0.9::DOUBLE THEN actual_train_span_days END), 1) AS saturation_days_at_90pct_of_own_max FROM mx GROUP BY 1, 2, 3"""),
    "split_stage": (split_stage, qs._GREEDY + " SELECT event_id, split FROM tel JOIN sp USING (user_id) WHERE split = 'val'"),
    "threshold_config_file": (config_file, f"WITH {an._TRADE} SELECT ROUND(threshold, 6) AS threshold, target_fpr_pct, ROUND(actual_fpr_pct, 6) AS actual_fpr_pct, 'coolant_temp_c_dev,rpm_dev,speed_kmh' AS features FROM tr WHERE target_fpr_pct = 2"),
    "model_file": (model_file, f"WITH {an.POOL_SQL} SELECT event_id, ROUND(score, 6) AS score FROM ps"),
    "load_vehicle": (lambda s, d: fs.load_vehicle(fx.telemetry(s, d), 5).select("event_id", "time"), f"WITH {fx.TEL} SELECT event_id, time FROM tel WHERE vehicle_id = 5"),
    "sql_scan": (sql, f"WITH {fx.TEL} SELECT event_id, rpm FROM tel WHERE vehicle_id = 2 AND rpm > 900"),
    "read_columns": (lambda s, d: fs.read_columns(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"]).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")),
                     "SELECT l_orderkey, SUM(l_quantity) AS qty FROM lineitem GROUP BY 1"),
}
