"""Pairing and streams: J4, S8, ST1-ST7, ST10, K1, K6, K7.

Streaming queries write the driver's events as message or telemetry files, slice
by slice, run to the end of each slice before the next is written, and return the
stored result.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake import fixtures as fx
from roadlake.operators import forest as fo
from roadlake.operators.merge import merge_nearest
from roadlake.queries import anomaly as an
from roadlake.queries.base import rounded
from roadlake.schemas import ACCELS, PIDS
from roadlake.session import workspace
from roadlake.sources import messages as ms
from roadlake.streaming import feed, pairing, rollup, run, scoring

T1 = dt.datetime(2025, 6, 1, 12, 0, tzinfo=dt.timezone.utc)
_PV = ", ".join(PIDS)
_AV = ", ".join(ACCELS)

# one recursion step per OBD row, all vehicles at once; candidates come nearest first
_MERGE = f"""WITH RECURSIVE {fx.TEL}, ob AS MATERIALIZED (SELECT *, EPOCH_US(time) AS us, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY time, event_id) AS k FROM tel WHERE event_id % 2 = 0),
 im AS MATERIALIZED (SELECT *, EPOCH_US(time) AS us FROM tel WHERE event_id % 2 = 1),
 ca AS (SELECT ob.vehicle_id, ob.k, LIST({{'id': im.event_id, 'us': im.us}} ORDER BY ABS(im.us - ob.us), im.us, im.event_id) AS near FROM ob JOIN im ON ob.vehicle_id = im.vehicle_id AND im.us BETWEEN ob.us - 500000 AND ob.us + 500000 GROUP BY 1, 2),
 oc AS MATERIALIZED (SELECT ob.vehicle_id, ob.k, ob.event_id, ob.us, COALESCE(near, []) AS near FROM ob LEFT JOIN ca USING (vehicle_id, k)),
 w AS (SELECT vehicle_id, 0::BIGINT AS k, NULL::BIGINT AS obd_id, NULL::BIGINT AS imu_id, []::STRUCT(id BIGINT, us BIGINT)[] AS used FROM oc WHERE k = 1
  UNION ALL SELECT vehicle_id, k, obd_id, pick.id, CASE WHEN pick IS NULL THEN used ELSE LIST_APPEND(LIST_FILTER(used, LAMBDA y: y.us >= us - 500000), pick) END FROM
   (SELECT oc.vehicle_id, oc.k, oc.event_id AS obd_id, oc.us, used, LIST_FILTER(near, LAMBDA x: NOT LIST_CONTAINS(used, x))[1] AS pick FROM w JOIN oc ON oc.vehicle_id = w.vehicle_id AND oc.k = w.k + 1)),
 pr AS (SELECT vehicle_id, obd_id, imu_id FROM w WHERE k > 0 UNION ALL SELECT vehicle_id, NULL, event_id FROM im WHERE event_id NOT IN (SELECT imu_id FROM w WHERE imu_id IS NOT NULL)),
 mg AS (SELECT pr.vehicle_id, obd_id, imu_id, COALESCE(ob.time, im.time) AS time, {", ".join("ob." + c for c in PIDS)}, {", ".join("im." + c for c in ACCELS)} FROM pr LEFT JOIN ob ON ob.event_id = obd_id LEFT JOIN im ON im.event_id = imu_id)"""


def merged(spark, d):
    t = fx.telemetry(spark, d)
    return merge_nearest(t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1"), segment_s=120)


def envelopes(spark, d):
    """OBD and IMU messages of the fleet, some of them broken, some advanced."""
    m = ms.to_messages(fx.telemetry(spark, d), "event_id % 2 = 0", "event_id % 2 = 1", "vehicle_id").withColumn("us", F.unix_micros("time"))
    v = F.when(F.col("us") % 97 == 0, F.expr("substring(value, 2)")).when(F.col("us") % 89 == 0, F.regexp_replace("value", '"ts":[0-9.E]+,', ""))
    v = v.when((F.col("us") % 83 == 0) & F.col("value").contains("normal"), F.regexp_replace(
        F.regexp_replace("value", "normal", "advanced"), r"}$", ',"all_pids":{"0C":{"value":812.5,"unit":"rpm","desc":"Engine RPM"},"5E":{"value":null,"unit":null,"desc":""}}}'))
    return m.select("topic", "key", v.otherwise(F.col("value")).alias("value"), "us")


_MSG = fx.TEL + ", ev AS (SELECT *, EPOCH_US(time) AS us FROM tel)"


def dropped(spark, d):
    p = ms.parse(envelopes(spark, d))
    return p.groupBy("topic", F.coalesce("reject", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


SLICES = 4
_SLICE = f"LEAST(CAST(FLOOR((EPOCH_US(time) - lo) * {SLICES} / CAST(hi - lo AS DOUBLE)) AS INT), {SLICES - 1})"
#: Files of a slice: as many as the session's shuffles have partitions, on small tables one for every thousand rows.
_FILE_ROWS = 1000


def _slices(t, time="time"):
    """The rows cut into a few stretches of equal time, as they would arrive one after the other, the number of
    files each is to be dealt over, and the last time (microseconds)."""
    us = F.unix_micros(time)
    lo, hi, n = t.agg(F.min(us), F.max(us), F.count(F.lit(1))).first()
    part = F.least(F.floor((us - lo) * SLICES / F.lit(float(hi - lo))), F.lit(SLICES - 1))
    files = max(1, min(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (SLICES * _FILE_ROWS)))
    return [t.where(part == i) for i in range(SLICES)], files, hi


def _message_files(spark, d, clean=True, late=None):
    """The path of messages in folders of rising time, and an iterator that writes one folder a step: a query that
    takes all there is after each step has a folder in a trigger, however many files it is. Rows that ``late`` selects
    come with the last folder."""
    path = workspace(spark, "messages")
    return f"{path}/*", (_clean_messages(spark, d, path, late) if clean else _all_messages(spark, d, path))


def _all_messages(spark, d, path):
    envelopes(spark, d).select("topic", "key", "value").write.json(f"{path}/a")
    yield


def _clean_messages(spark, d, path, late):
    tel = fx.telemetry(spark, d)
    parts, files, end = _slices(tel)
    if late is not None:
        early = parts[:-2]  # older than any delay by the time the last slice comes
        parts = [p.where(~late) for p in early] + [parts[-2], reduce(DataFrame.unionByName, [p.where(late) for p in early], parts[-1])]
    for i, part in enumerate(parts):
        ms.to_messages(part, "event_id % 2 = 0", "event_id % 2 = 1", "vehicle_id").select("topic", "key", "value").repartition(files).write.json(f"{path}/{i}")
        yield
    # a closing message moves the watermark past everything else
    last = spark.range(1).select(F.lit(-1).alias("vehicle_id"), F.timestamp_micros(F.lit(end + 3_600_000_000)).alias("time"), *[F.lit(None).cast("double").alias(c) for c in PIDS + ACCELS])
    ms.to_messages(last, "true", "false", "vehicle_id").select("topic", "key", "value").write.json(f"{path}/z")
    yield


def merge_stream(spark, d, late=None):
    """The running ingest: messages arrive slice by slice, merged rows are appended by date."""
    path, arrivals = _message_files(spark, d, late=late)
    obd, imu, _ = ms.route(ms.parse(ms.file_messages(spark, path, None)))
    merged = pairing.stored(pairing.merge_stream(obd, imu))
    path, checkpoint = workspace(spark, "merged"), workspace(spark, "merged-ckpt")
    for _ in arrivals:
        run.drain(pairing.append_telemetry(merged, path, checkpoint, "0 seconds"))
    out = spark.read.schema(merged.schema).parquet(path)
    return out.where("node_id <> '-1'").select(F.col("node_id").cast("int").alias("vehicle_id"), "time", *PIDS, *ACCELS, "late")


def late_rows(spark, d):
    """A fifteenth of the messages of the first half comes late, with the last slice: each comes out once, alone."""
    return merge_stream(spark, d, F.col("event_id") % 30 < 2)


def late_metrics(spark, d):
    """The same ingest, as its metrics tell it: rows and late rows of all triggers together."""
    path, arrivals = _message_files(spark, d, late=F.col("event_id") % 30 < 2)
    obd, imu, _ = ms.route(ms.parse(ms.file_messages(spark, path, None)))
    merged = pairing.counted(pairing.merge_stream(obd, imu).where("node_id <> '-1'"))
    path, checkpoint, seen = workspace(spark, "merged"), workspace(spark, "merged-ckpt"), []
    for _ in arrivals:
        q = pairing.append_telemetry(pairing.stored(merged), path, checkpoint, "0 seconds")
        run.drain(q)
        seen += [p.observedMetrics["merge"] for p in q.recentProgress if "merge" in p.observedMetrics]
    return spark.createDataFrame([(sum(m["rows"] for m in seen), sum(m["late"] for m in seen))], "n_rows long, n_late long")


def advanced_stream(spark, d):
    path, arrivals = _message_files(spark, d, False)
    out = run.drain_to_parquet(ms.advanced(ms.parse(ms.file_messages(spark, path, None))), "advanced", arrivals=arrivals)
    return out.select(F.col("node_id").cast("int").alias("vehicle_id"), "time", "pid", "value", "unit")


def routed(spark, d):
    path, arrivals = _message_files(spark, d, False)
    obd, imu, _ = ms.route(ms.parse(ms.file_messages(spark, path, None)))
    o = obd.select(F.lit("obd").alias("kind"), F.col("node_id").cast("int").alias("vehicle_id"), "time", F.col("rpm").alias("x"))
    i = imu.select(F.lit("imu").alias("kind"), F.col("node_id").cast("int").alias("vehicle_id"), "time", F.col("accel_x").alias("x"))
    return run.drain_to_parquet(o.unionByName(i), "routed", arrivals=arrivals)


def _telemetry_files(spark, d, close=False):
    """A stream of trips' telemetry, and an iterator that writes it in folders of rising time, one a step, and a closing
    row if asked."""
    path = workspace(spark, "telemetry")
    t = fx.trips(spark, d).select("vehicle_id", "trip", "event_id", "time", *PIDS, *ACCELS)

    def arrivals():
        parts, files, _ = _slices(t)
        for i, part in enumerate(parts):
            part.repartition(files).write.parquet(f"{path}/{i}")
            yield
        if close:
            t.orderBy(F.desc("time")).limit(1).withColumn("time", F.col("time") + F.expr("INTERVAL 1 HOUR")).withColumn("vehicle_id", F.lit(-1)).write.parquet(f"{path}/z")
            yield

    return spark.readStream.schema(t.schema).parquet(f"{path}/*"), arrivals()


def rollup_stream(spark, d):
    src, arrivals = _telemetry_files(spark, d)
    sink = workspace(spark, "rollup")
    run.drain_each(rollup.rollup_stream(src), rollup.bucket_writer(sink), "rollup", "update", arrivals=arrivals)
    return rounded(rollup.current_rollup(spark, sink))


def score_stream(spark, d):
    src, arrivals = _telemetry_files(spark, d, close=True)
    f = scoring.deviation_stream(src, ["vehicle_id", "trip"], ["rpm", "engine_load_pct"], ["event_id", "speed_kmh"], 30, peers=True)
    model = fo.Forest(an.probe_nodes(an.POOL), an.POOL)
    out = run.drain_to_parquet(scoring.score_stream(f, model, 0.0), "scored", arrivals=arrivals).where("vehicle_id >= 0")
    return rounded(out.select("event_id", "rpm_dev", "engine_load_pct_dev", F.round("score", 9).alias("score")))


def live(spark, d):
    t = fx.telemetry(spark, d).select("event_id", "speed_kmh", "rpm")
    m = feed.live_messages(t)
    return m.select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.data.event_id").cast("long").alias("event_id"),
                    F.col("value").contains('"speed_kmh":null').alias("null_kept"))


def live_stream(spark, d):
    src, arrivals = _telemetry_files(spark, d)
    out, checkpoint = workspace(spark, "live"), workspace(spark, "live-ckpt")
    for _ in arrivals:
        run.drain(feed.publish(src.select("event_id", "speed_kmh", "rpm"), out, checkpoint, "0 seconds"))
    m = spark.read.text(out)
    return m.select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.data.event_id").cast("long").alias("event_id"),
                    F.get_json_object("value", "$.data.rpm").cast("double").alias("rpm"))


def replay(spark, d):
    r = feed.replay(fx.telemetry(spark, d), T1, 4.0)
    return r.select("event_id", "topic", "play_time", F.get_json_object("value", "$.rpm").cast("double").alias("rpm"), F.get_json_object("value", "$.accel_z").cast("double").alias("accel_z"))


def _per_trigger(spark, d, make, label):
    src, arrivals = _telemetry_files(spark, d)
    sink = workspace(spark, label)
    run.drain_each(src, make(sink), label, arrivals=arrivals)
    return spark.read.parquet(sink).withColumn("trigger", F.col("trigger").cast("int"))


def snapshots(spark, d):
    return _per_trigger(spark, d, lambda sink: feed.open_session_snapshots(lambda: fx.sessions(spark, d), sink), "open").select("trigger", "session_id", "started_at", "seen_at")


def open_summaries(spark, d):
    make = lambda sink: feed.open_session_summaries(lambda: fx.sessions(spark, d), lambda: fx.telemetry(spark, d), sink)
    return rounded(_per_trigger(spark, d, make, "open-summaries").select("trigger", "session_id", "row_count", "max_speed_kmh"))


# the same pairing without the rows that are kept back
_ON_TIME = _MERGE.replace(fx.TEL, fx.TEL.replace("tel AS (", "tel0 AS (", 1) + f""", bn AS (SELECT MIN(EPOCH_US(time)) AS lo, MAX(EPOCH_US(time)) AS hi FROM tel0),
 cut AS MATERIALIZED (SELECT tel0.*, event_id % 30 < 2 AND {_SLICE} < {SLICES - 2} AS held FROM tel0, bn), kept_back AS (SELECT * FROM cut WHERE held), tel AS (SELECT * FROM cut WHERE NOT held)""")
_TICKS = (f"WITH {fx.TEL}, {fx.SES}, b AS (SELECT MIN(EPOCH_US(time)) AS lo, MAX(EPOCH_US(time)) AS hi FROM tel), tk AS (SELECT {_SLICE} AS \"trigger\", MAX(time) AS seen_at FROM tel, b GROUP BY 1), "
          "op AS (SELECT \"trigger\", seen_at, session_id, started_at FROM tk JOIN ses ON started_at <= seen_at AND (ended_at IS NULL OR ended_at > seen_at))")
_ROLL = (f"WITH {fx.TEL} SELECT DATE_TRUNC('minute', time) AS bucket, ROUND(AVG(speed_kmh),6) AS avg_speed, MAX(speed_kmh) AS max_speed, ROUND(AVG(rpm),6) AS avg_rpm, ROUND(AVG(throttle_pct),6) AS avg_throttle, "
               "ROUND(AVG(engine_load_pct),6) AS avg_load, MAX(ABS(accel_x)) AS max_accel_x, MAX(ABS(accel_y)) AS max_accel_y FROM tel GROUP BY 1")
_TOPIC = "CASE WHEN event_id % 2 = 0 THEN 'telemetry/vehicle/obd' ELSE 'telemetry/vehicle/imu' END"
_R30 = an._RNG.format(w=29)

QUERIES = {
    "merge_nearest": (lambda s, d: merged(s, d).select("vehicle_id", "obd_id", "imu_id", "time", *PIDS, *ACCELS), f"{_MERGE} SELECT vehicle_id, obd_id, imu_id, time, {_PV}, {_AV} FROM mg"),
    "merge_stream": (lambda s, d: merge_stream(s, d).drop("late"), f"{_MERGE} SELECT vehicle_id, time, {_PV}, {_AV} FROM mg"),
    "late_rows": (late_rows, f"{_ON_TIME} SELECT vehicle_id, time, {_PV}, {_AV}, false AS late FROM mg UNION ALL SELECT vehicle_id, time, {', '.join(f'CASE WHEN event_id % 2 = 0 THEN {c} END' for c in PIDS)}, "
                  f"{', '.join(f'CASE WHEN event_id % 2 = 1 THEN {c} END' for c in ACCELS)}, true FROM kept_back"),
    "late_metrics": (late_metrics, f"{_ON_TIME} SELECT (SELECT COUNT(*) FROM mg) + (SELECT COUNT(*) FROM kept_back) AS n_rows, (SELECT COUNT(*) FROM kept_back) AS n_late"),
    "parse_messages": (dropped, f"WITH {_MSG} SELECT {_TOPIC} AS topic, CASE WHEN us % 97 = 0 THEN 'unparseable' WHEN us % 89 = 0 THEN 'no ts' ELSE 'ok' END AS outcome, COUNT(*) AS n FROM ev GROUP BY 1, 2"),
    "route_stream": (routed, f"WITH {_MSG} SELECT CASE WHEN event_id % 2 = 0 THEN 'obd' ELSE 'imu' END AS kind, vehicle_id, time, CASE WHEN event_id % 2 = 0 THEN rpm ELSE accel_x END AS x FROM ev WHERE us % 97 <> 0 AND us % 89 <> 0"),
    "advanced_stream": (advanced_stream, f"WITH {_MSG}, a AS (SELECT * FROM ev WHERE event_id % 2 = 0 AND us % 83 = 0 AND us % 97 <> 0 AND us % 89 <> 0) SELECT vehicle_id, time, 'Engine RPM' AS pid, 812.5::DOUBLE AS value, 'rpm' AS unit FROM a "
                        "UNION ALL SELECT vehicle_id, time, '5E', NULL, '' FROM a"),
    "rollup_stream": (rollup_stream, _ROLL),
    "score_stream": (score_stream, f"""WITH {fx.trips_sql()}, s0 AS (SELECT *, rpm - MEDIAN(rpm) OVER {_R30} AS rpm_dev, engine_load_pct - MEDIAN(engine_load_pct) OVER {_R30} AS engine_load_pct_dev, MIN(time) OVER (PARTITION BY vehicle_id, trip) AS t0 FROM trips)
      SELECT event_id, ROUND(rpm_dev, 6) AS rpm_dev, ROUND(engine_load_pct_dev, 6) AS engine_load_pct_dev, ROUND({an.SP}, 6) AS score FROM s0 WHERE time >= t0 + INTERVAL 30 SECOND"""),
    "live_messages": (live, f"WITH {fx.TEL} SELECT 'telemetry' AS type, event_id, speed_kmh IS NULL AS null_kept FROM tel"),
    "replay_messages": (replay, f"""WITH {fx.TEL}, p AS (SELECT *, MAKE_TIMESTAMP(EPOCH_US(TIMESTAMP '2025-06-01 12:00:00') + ROUND((EPOCH_US(time) - (SELECT MIN(EPOCH_US(time)) FROM tel)) / 4.0::DOUBLE)::BIGINT) AS play_time FROM tel)
      SELECT event_id, 'telemetry/vehicle/obd' AS topic, play_time, rpm, NULL::DOUBLE AS accel_z FROM p UNION ALL SELECT event_id, 'telemetry/vehicle/imu', play_time, NULL, accel_z FROM p"""),
    "open_session_snapshots": (snapshots, f"{_TICKS} SELECT \"trigger\", session_id, started_at, seen_at FROM op"),
    "open_session_summaries": (open_summaries, f"{_TICKS} SELECT \"trigger\", session_id, COUNT(*) AS row_count, MAX(speed_kmh) AS max_speed_kmh FROM op JOIN tel ON tel.time BETWEEN started_at AND seen_at GROUP BY 1, 2"),
    "live_stream": (live_stream, f"WITH {fx.TEL} SELECT 'telemetry' AS type, event_id, rpm FROM tel"),
}
