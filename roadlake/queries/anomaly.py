"""Anomaly modelling: M1, M2, M6-M20, K4.

Checked queries score with a fixed forest made from a rule, so that DuckDB can
compute the same path lengths; fitted forests are registered beside them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from roadlake import fixtures as fx
from roadlake.operators import faults as fa
from roadlake.operators import features as ft
from roadlake.operators import forest as fo
from roadlake.operators import studies as st
from roadlake.queries.base import rounded
from roadlake.session import materialize

N_PROBE, DEPTH = 8, 3
# Centre and spread of each feature, for the rule-made forest.
_SCALE = {"coolant_temp_c_dev": (0.0, 12.0), "rpm_dev": (100.0, 400.0), "engine_load_pct_dev": (5.0, 25.0), "speed_kmh": (45.0, 30.0)}
CAR, POOL = fa.CAR_FEATURES, fa.POOL_FEATURES


def probe_nodes(features: list[str]) -> pd.DataFrame:
    rows = []
    for t in range(N_PROBE):
        for node in range(2 ** (DEPTH + 1) - 1):
            depth = (node + 1).bit_length() - 1
            f = (t + node) % 3 if depth < DEPTH else -1
            mid, spread = _SCALE[features[f]]
            cut = mid + spread * (((t * 5 + node * 3) % 11) - 5) / 2 if f >= 0 else 0.0
            rows.append((t, node, f, cut, 1 + (t * 7 + node * 13) % 60, depth, 256))
    return pd.DataFrame(rows, columns=[n for n, _ in fo.NODE_FIELDS])


def scorer(features: list[str]):
    model = fo.Forest(probe_nodes(features), features)
    return lambda df: model.score(df).withColumn("score", F.round("score", 9))


def score_sql(features: list[str]) -> str:
    nodes = {(r.tree, r.node): r for r in probe_nodes(features).itertuples()}

    def walk(t, n):
        r = nodes[t, n]
        if r.feature < 0:
            return repr(float(r.depth + fo.mean_path(r.size))) + "::DOUBLE"
        return f"CASE WHEN {features[r.feature]} <= {r.cut!r}::DOUBLE THEN {walk(t, 2 * n + 1)} ELSE {walk(t, 2 * n + 2)} END"

    total = " + ".join(walk(t, 0) for t in range(N_PROBE))
    known = " AND ".join(f"{f} IS NOT NULL" for f in features)
    return f"CASE WHEN {known} THEN ROUND(0.5::DOUBLE - POWER(2.0::DOUBLE, -({total}) / {N_PROBE} / {float(fo.mean_path(256))!r}::DOUBLE), 9) END"


SC, SP = score_sql(CAR), score_sql(POOL)
_U = "((((vehicle_id * 31 + trip * 17) * 7919) % 10007) / CAST(10007 AS DOUBLE))"
TK = ["vehicle_id", "trip"]


def u():
    return F.expr(_U)


def pool(spark, d, w=30):
    return materialize(ft.population_features(fx.solid_trips(spark, d), w, peers=True).drop("rpm"), "features")


_RNG = "(PARTITION BY vehicle_id, trip ORDER BY time RANGE BETWEEN INTERVAL '{w}.999999' SECOND PRECEDING AND CURRENT ROW)"


def _pool_sql(w=30, seconds=120):
    r = _RNG.format(w=w - 1)
    return (f"{fx.solid_sql(seconds)}, p0 AS (SELECT *, rpm - MEDIAN(rpm) OVER {r} AS rpm_dev, engine_load_pct - MEDIAN(engine_load_pct) OVER {r} AS engine_load_pct_dev, MIN(time) OVER k AS t0, MAX(time) OVER k AS t1 "
            "FROM solid WINDOW k AS (PARTITION BY vehicle_id, trip)), pool AS (SELECT vehicle_id, trip, time, event_id, speed_kmh, rpm, rpm_dev, engine_load_pct_dev FROM p0 "
            f"WHERE t1 - t0 >= INTERVAL {w} SECOND AND time >= t0 + INTERVAL {w} SECOND)")


def car(spark, d):
    t = fx.solid_trips(spark, d, 240)
    f = ft.single_car_features(t, 60, peers=True)[0]
    return materialize(ft.resample_last(f, CAR, required=CAR), "features")


_R60 = _RNG.format(w=59)
CAR_SQL = (f"{fx.solid_sql(240)}, c0 AS (SELECT *, coolant_temp_c - MEDIAN(coolant_temp_c) OVER {_R60} AS coolant_temp_c_dev, rpm - MEDIAN(rpm) OVER {_R60} AS rpm_dev, "
           "(EPOCH_US(time) - MIN(EPOCH_US(time)) OVER (PARTITION BY vehicle_id, trip)) AS since FROM solid), "
           "car AS (SELECT vehicle_id, trip, DATE_TRUNC('second', time) AS time, " + ", ".join(f"ARG_MAX({c}, (c0.time, event_id)) AS {c}" for c in CAR) + " FROM c0 WHERE since >= 60000000 GROUP BY 1, 2, 3), "
           f"cs AS (SELECT *, {SC} AS score FROM car)")
CAR_WIN = CAR_SQL + f""", ci AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id, trip ORDER BY time) - 1 AS i, COUNT(*) OVER (PARTITION BY vehicle_id, trip) AS n FROM cs WHERE vehicle_id % 2 = 1),
 cw AS (SELECT * FROM ci WHERE n > 90 AND i >= 30 + FLOOR({_U} * (n - 90)) AND i < 60 + FLOOR({_U} * (n - 90)))"""
_INJ = (", inj AS (SELECT * REPLACE (coolant_temp_c_dev + CASE fault WHEN 'coolant_spike' THEN 20 ELSE 0 END AS coolant_temp_c_dev, rpm_dev + CASE fault WHEN 'rpm_decorrelation' THEN 3000 ELSE 0 END AS rpm_dev) "
        "FROM cw, (SELECT UNNEST(['coolant_spike', 'rpm_decorrelation']) AS fault)), "
        f"pair AS (SELECT vehicle_id, trip, time, fault, score AS original_score, {SC} AS injected_score FROM inj)")
POOL_SQL = _pool_sql() + f", ps AS (SELECT *, {SP} AS score FROM pool)"
_TW = """, tb AS (SELECT vehicle_id, trip, MIN(EPOCH_US(time)) AS a, MAX(EPOCH_US(time)) AS b FROM ps WHERE vehicle_id % 2 = {par} GROUP BY 1, 2 HAVING MAX(EPOCH_US(time)) - MIN(EPOCH_US(time)) >= 30000000),
 ts AS (SELECT *, a + FLOOR({u} * (b - a - 30000000)) AS w FROM tb), tw0 AS (SELECT ps.* FROM ps JOIN ts USING (vehicle_id, trip) WHERE EPOCH_US(time) >= w AND EPOCH_US(time) < w + 30000000),
 tv AS (SELECT vehicle_id, trip FROM tw0 GROUP BY 1, 2 HAVING COUNT(*) >= 3 AND COUNT(rpm_dev) = COUNT(*) AND COUNT(engine_load_pct_dev) = COUNT(*) AND COUNT(speed_kmh) = COUNT(*) ),
 tw AS (SELECT tw0.* FROM tw0 JOIN tv USING (vehicle_id, trip))"""
TW1 = _TW.format(par=1, u=_U)
_SD = ", sd AS (SELECT STDDEV_SAMP(rpm_dev) AS r, STDDEV_SAMP(engine_load_pct_dev) AS l FROM ps WHERE vehicle_id % 2 = 0)"


def car_val(spark, d):
    return car(spark, d).where("vehicle_id % 2 = 1")


def car_windows(spark, d, val=None):
    return fa.row_windows(val if val is not None else car_val(spark, d), u=u())


def halves(spark, d):
    """(train, validation) by vehicle parity, of one stored feature table."""
    p = pool(spark, d)
    return p.where("vehicle_id % 2 = 0"), p.where("vehicle_id % 2 = 1")


def windows_of(part):
    return fa.time_windows(part, u=u())


def pool_windows(spark, d):
    return windows_of(halves(spark, d)[1])


def paired(spark, d, val=None):
    return fa.paired_scores(car_windows(spark, d, val), scorer(CAR), fa.CAR_FAULTS)


def tradeoff(spark, d):
    val = car_val(spark, d)
    return fa.row_tradeoff(scorer(CAR)(val), paired(spark, d, val))


_CAND = "(SELECT UNNEST([0.5::DOUBLE, 1, 2, 5, 10]) AS c)"
_TRADE = CAR_WIN + _INJ + f""", th AS (SELECT c AS target_fpr_pct, (SELECT QUANTILE_CONT(score, [0.005, 0.01, 0.02, 0.05, 0.1]) FROM cs WHERE vehicle_id % 2 = 1)[LIST_POSITION([0.5, 1, 2, 5, 10], c)] AS threshold FROM {_CAND}),
 tr AS (SELECT target_fpr_pct, threshold, (SELECT 100 * AVG((score < threshold)::INT) FROM cs WHERE vehicle_id % 2 = 1) AS actual_fpr_pct,
   (SELECT 100 * AVG((injected_score < threshold)::INT) FROM pair WHERE fault = 'coolant_spike') AS coolant_spike_detection_pct,
   (SELECT 100 * AVG((injected_score < threshold)::INT) FROM pair WHERE fault = 'rpm_decorrelation') AS rpm_decorrelation_detection_pct FROM th)"""


def dense(spark, d):
    return fa.dense_windows(halves(spark, d)[1])


_DENSE = """, db AS (SELECT vehicle_id, trip, MIN(EPOCH_US(time)) AS a, (MAX(EPOCH_US(time)) - MIN(EPOCH_US(time))) // 30000000 AS nc FROM ps WHERE vehicle_id % 2 = 1 GROUP BY 1, 2),
 dc AS (SELECT vehicle_id, trip, UNNEST(RANGE(nc)) AS chunk FROM db),
 dr AS (SELECT ps.*, ((EPOCH_US(time) - a) // 30000000)::INT AS chunk FROM ps JOIN db USING (vehicle_id, trip)), dw AS (SELECT dr.* FROM dr JOIN dc USING (vehicle_id, trip, chunk)),
 dv AS (SELECT vehicle_id, trip, chunk FROM dw GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3 AND COUNT(rpm_dev) = COUNT(*) AND COUNT(engine_load_pct_dev) = COUNT(*) AND COUNT(speed_kmh) = COUNT(*))"""


def sweep(spark, d):
    s, (train, val) = scorer(POOL), halves(spark, d)
    return fa.std_sweep(windows_of(val), s(val), s, train, "load_spike")


_SWEEP = POOL_SQL + TW1 + _SD + f""", lim AS (SELECT QUANTILE_CONT(score, [0.02, 0.05, 0.1]) AS q FROM ps WHERE vehicle_id % 2 = 1),
 x AS (SELECT tw.* REPLACE (engine_load_pct_dev + m * l AS engine_load_pct_dev), m, m * l AS magnitude FROM tw, sd, (SELECT UNNEST([0.5::DOUBLE, 1, 2, 3, 5, 8]) AS m)),
 y AS (SELECT vehicle_id, trip, m, magnitude, MIN({SP}) AS low FROM x GROUP BY 1, 2, 3, 4)
 SELECT m AS std_multiple, ROUND(magnitude, 6) AS magnitude, COUNT(*) AS n_windows, ROUND(AVG((low < q[1])::INT), 6) AS detect_rate_at_2pct_fpr, ROUND(AVG((low < q[2])::INT), 6) AS detect_rate_at_5pct_fpr,
 ROUND(AVG((low < q[3])::INT), 6) AS detect_rate_at_10pct_fpr FROM y, lim GROUP BY 1, 2"""


def wtrade(spark, d):
    s, (train, val) = scorer(POOL), halves(spark, d)
    return fa.window_tradeoff(windows_of(val), s(val), s, train, 5.0)


_PINJ = f""", px AS (SELECT tw.* REPLACE (engine_load_pct_dev + CASE fault WHEN 'load_spike' THEN 5 * l ELSE 0 END AS engine_load_pct_dev, rpm_dev + CASE fault WHEN 'rpm_decorrelation' THEN 5 * r ELSE 0 END AS rpm_dev), fault
   FROM tw, sd, (SELECT UNNEST(['load_spike', 'rpm_decorrelation']) AS fault)), pl AS (SELECT vehicle_id, trip, fault, MIN({SP}) AS low FROM px GROUP BY 1, 2, 3)"""
_WTRADE = POOL_SQL + TW1 + _SD + _PINJ + """, th AS (SELECT UNNEST([0.5::DOUBLE, 1, 2, 3, 4, 5, 7, 10]) AS target_fpr_pct, UNNEST(QUANTILE_CONT(score, [0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1])) AS threshold FROM ps WHERE vehicle_id % 2 = 1)
 SELECT target_fpr_pct, ROUND(threshold, 6) AS threshold, ROUND((SELECT 100 * AVG((score < threshold)::INT) FROM ps WHERE vehicle_id % 2 = 1 AND score IS NOT NULL), 6) AS actual_val_fpr_pct,
 ROUND((SELECT AVG((low < threshold)::INT) FROM pl WHERE fault = 'load_spike'), 6) AS load_spike_detect_rate, ROUND((SELECT AVG((low < threshold)::INT) FROM pl WHERE fault = 'rpm_decorrelation'), 6) AS rpm_decorrelation_detect_rate FROM th"""


def sealed_rows(spark, d):
    val = car_val(spark, d)
    return rounded(fa.sealed_evaluation(val, scorer(CAR), 0.02, car_windows(spark, d, val), fa.CAR_FAULTS, confirm_sealed=True))


def sealed_windows(spark, d):
    train, val = halves(spark, d)
    return rounded(fa.sealed_evaluation(val, scorer(POOL), 0.0, windows_of(val), fa.std_faults(train, 5.0), True, TK))


def session(spark, d):
    m = fo.Forest(probe_nodes(POOL), POOL)
    out = st.score_session(fx.telemetry(spark, d), fx.sessions(spark, d), "s5", m, 0.0, 30, now=fx.NOW, peers=True)
    return rounded(out.select("event_id", "rpm_dev", "engine_load_pct_dev", "speed_kmh", F.round("score", 9).alias("score"), "is_anomalous"))


_RS = _RNG.format(w=29).replace("PARTITION BY vehicle_id, trip ", "")
_SESS = (f"WITH {fx.JOINED}, s0 AS (SELECT *, rpm - MEDIAN(rpm) OVER {_RS} AS rpm_dev, engine_load_pct - MEDIAN(engine_load_pct) OVER {_RS} AS engine_load_pct_dev, MIN(time) OVER () AS t0 FROM j WHERE session_id = 's5'), "
         f"s1 AS (SELECT *, {SP} AS score FROM s0 WHERE time >= t0 + INTERVAL 30 SECOND) SELECT event_id, ROUND(rpm_dev, 6) AS rpm_dev, ROUND(engine_load_pct_dev, 6) AS engine_load_pct_dev, speed_kmh, "
         "ROUND(score, 6) AS score, score < 0 AS is_anomalous FROM s1 WHERE score IS NOT NULL")


def session_car(spark, d):
    """The single-car model: 60 s windows, one row per second."""
    m = fo.Forest(probe_nodes(CAR), CAR)
    out = st.score_session(fx.telemetry(spark, d), fx.sessions(spark, d), "s5", m, 0.0, 60, resample=True, now=fx.NOW, peers=True)
    return rounded(out.select("time", *CAR, F.round("score", 9).alias("score"), "is_anomalous"))


_RS60 = _R60.replace("PARTITION BY vehicle_id, trip ", "")
_SESS_CAR = (f"WITH {fx.JOINED}, s0 AS (SELECT *, coolant_temp_c - MEDIAN(coolant_temp_c) OVER {_RS60} AS coolant_temp_c_dev, rpm - MEDIAN(rpm) OVER {_RS60} AS rpm_dev, MIN(time) OVER () AS t0 FROM j WHERE session_id = 's5'), "
             "s1 AS (SELECT DATE_TRUNC('second', time) AS time, " + ", ".join(f"ARG_MAX({c}, (s0.time, event_id)) FILTER ({c} IS NOT NULL) AS {c}" for c in CAR) + " FROM s0 WHERE time >= t0 + INTERVAL 60 SECOND GROUP BY 1), "
             f"s2 AS (SELECT *, {SC} AS score FROM s1) SELECT time, ROUND(coolant_temp_c_dev, 6) AS coolant_temp_c_dev, ROUND(rpm_dev, 6) AS rpm_dev, speed_kmh, ROUND(score, 6) AS score, score < 0 AS is_anomalous FROM s2 WHERE score IS NOT NULL")


def populations(spark, d):
    p = ft.population_features(fx.solid_trips(spark, d), 30, peers=True)
    return rounded(st.compare_populations({"fleet": p.where("vehicle_id <> 3"), "own": p.where("vehicle_id = 3")}, "rpm_dev", -3000, 5000))


_POPS = (f"WITH {_pool_sql()}, h AS (SELECT CASE WHEN vehicle_id = 3 THEN 'own' ELSE 'fleet' END AS population, LEAST(FLOOR((rpm_dev + 3000) * 80 / 8000), 79)::INT AS bin, COUNT(*) AS n FROM pool WHERE rpm > 0 AND rpm_dev BETWEEN -3000 AND 5000 GROUP BY 1, 2) "
         "SELECT population, bin, (-3000 + bin * 100)::DOUBLE AS bin_lo, n, ROUND(n / (SUM(n) OVER (PARTITION BY population) * 100.0::DOUBLE), 6) AS density FROM h")


def holdouts(spark, d):
    return rounded(st.holdout_report(scorer(CAR)(car(spark, d)).withColumn("condition", F.concat(F.lit("c"), F.col("vehicle_id").cast("string")))))


def fitted(spark, d):
    p = pool(spark, d)
    model = fo.fit(p.where("vehicle_id % 2 = 0"), POOL)
    return model.score(p).select("vehicle_id", "trip", "event_id", "score")


def fitted_nodes(spark, d):
    return fo.fit_forests(pool(spark, d), POOL, ["vehicle_id"])


# The tables hold twelve minutes of driving, so no vehicle has the usual 15 windows held out.
MIN_WINDOWS = 3


def forest_shape(spark, d):
    """What the nodes of every fitted forest must add up to."""
    leaf = F.col("feature") < 0
    return fitted_nodes(spark, d).groupBy("vehicle_id").agg(
        F.count_distinct("tree").alias("n_trees"), F.min("psi").alias("least_sample"), F.max("psi").alias("most_sample"), F.sum(F.when(leaf, F.col("size"))).alias("leaf_rows"),
        F.sum(F.when(leaf, -1).otherwise(1)).alias("inner_less_leaves"), F.max((F.pow(F.lit(2.0), F.col("depth") - 1) < F.col("psi"))).alias("within_depth"),
        F.min(F.when(F.col("node") == 0, F.col("size"))).alias("root_rows"))


_SHAPE = (f"WITH {POOL_SQL}, n AS (SELECT vehicle_id, LEAST(256, COUNT(*)) AS k FROM ps WHERE score IS NOT NULL GROUP BY 1) "
          "SELECT vehicle_id, 100 AS n_trees, k AS least_sample, k AS most_sample, 100 * k AS leaf_rows, -100 AS inner_less_leaves, TRUE AS within_depth, k AS root_rows FROM n")


def _skips_sql(w, windows):
    return f"""WITH {_pool_sql(w, 60)}, tb AS (SELECT vehicle_id, trip, MIN(time) AS st FROM solid GROUP BY 1, 2),
 ri AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY st, trip) - 1 AS i, COUNT(*) OVER (PARTITION BY vehicle_id) AS n FROM tb),
 ro AS (SELECT *, CASE WHEN n - nt < 1 THEN 'rejected' WHEN i >= n - nt THEN 'test' ELSE 'train' END AS role FROM (SELECT *, GREATEST(3, CEIL(n * 0.2)) AS nt FROM ri)),
 te AS (SELECT pool.* FROM pool JOIN ro USING (vehicle_id, trip) WHERE role = 'test'),
 db AS (SELECT vehicle_id, trip, MIN(EPOCH_US(time)) AS a, (MAX(EPOCH_US(time)) - MIN(EPOCH_US(time))) // 30000000 AS nc FROM te GROUP BY 1, 2),
 dv AS (SELECT vehicle_id, trip, (EPOCH_US(time) - a) // 30000000 AS chunk FROM te JOIN db USING (vehicle_id, trip) WHERE (EPOCH_US(time) - a) // 30000000 < nc
   GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3 AND COUNT(rpm_dev) = COUNT(*) AND COUNT(engine_load_pct_dev) = COUNT(*) AND COUNT(speed_kmh) = COUNT(*)),
 nw AS (SELECT vehicle_id, COUNT(*) AS k FROM dv GROUP BY 1)
 SELECT DISTINCT vehicle_id, 'too few trips to hold any out' AS reason FROM ro WHERE role = 'rejected' UNION ALL
 SELECT vehicle_id, 'only ' || COALESCE(k, 0) || ' fault windows' FROM (SELECT DISTINCT vehicle_id FROM ro WHERE role = 'test') LEFT JOIN nw USING (vehicle_id) WHERE COALESCE(k, 0) < {windows}"""


def volume(spark, d):
    t = fx.solid_trips(spark, d, 60)
    return st.volume_sweep(t, CUTOFFS, 15, min_windows=MIN_WINDOWS)


CUTOFFS = [s / 86400 for s in (130, 250, 400)]


def volume_by_rule(spark, d):
    """The study with the rule-made forest for every (vehicle, step), which SQL can score."""
    nodes = probe_nodes(POOL)

    def fit(rows, models, feats, by, row_key, n_trees):
        n = spark.createDataFrame(nodes).select(*[F.col(n).cast(t).alias(n) for n, t in fo.NODE_FIELDS])
        return models.select(*by).withColumn("_all", F.lit(1)).join(n.withColumn("_all", F.lit(1)), "_all").drop("_all")

    def score(df, nodes, feats, by):
        return fo.score_many(df, nodes, feats, by).withColumn("score", F.round("score", 9))

    return rounded(st.volume_sweep(fx.solid_trips(spark, d, 60), CUTOFFS, 15, min_windows=MIN_WINDOWS, fit=fit, score=score))


def _volume_sql():
    head = _skips_sql(15, MIN_WINDOWS)
    head = head[: head.index("\n SELECT DISTINCT vehicle_id, 'too few")]
    steps = " UNION ALL ".join([f"SELECT '{c}' AS day_cutoff, {int(c * 86400e6)} AS most" for c in CUTOFFS] + ["SELECT 'all', NULL"])
    known = "rpm_dev IS NOT NULL AND engine_load_pct_dev IS NOT NULL AND speed_kmh IS NOT NULL"
    return head + f""", fs AS (SELECT vehicle_id, MIN(st) AS first_time FROM tb GROUP BY 1), ready AS (SELECT vehicle_id FROM nw WHERE k >= {MIN_WINDOWS}),
 sp AS (SELECT ro.vehicle_id, ro.trip, ro.st, fs.first_time, c.day_cutoff FROM ro JOIN fs USING (vehicle_id) JOIN ready USING (vehicle_id), ({steps}) c
   WHERE ro.role = 'train' AND (c.most IS NULL OR EPOCH_US(ro.st) - EPOCH_US(fs.first_time) <= c.most)),
 nt AS (SELECT vehicle_id, day_cutoff, COUNT(*) AS n_train_trips, (EPOCH_US(MAX(st)) - EPOCH_US(MIN(first_time))) / 86400000000.0::DOUBLE AS span FROM sp GROUP BY 1, 2),
 sz AS (SELECT sp.vehicle_id, sp.day_cutoff, COUNT(*) AS n_train_rows, STDDEV_SAMP(engine_load_pct_dev) AS sl, STDDEV_SAMP(rpm_dev) AS sr FROM pool JOIN sp USING (vehicle_id, trip) WHERE {known} GROUP BY 1, 2 HAVING COUNT(*) >= 10),
 md AS (SELECT sz.*, nt.n_train_trips, nt.span FROM sz JOIN nt USING (vehicle_id, day_cutoff)),
 lm AS (SELECT vehicle_id, QUANTILE_CONT({SP}, [0.02, 0.05, 0.1]) AS q FROM te WHERE {known} GROUP BY 1),
 wi AS (SELECT te.*, dv.chunk FROM te JOIN db USING (vehicle_id, trip) JOIN dv ON te.vehicle_id = dv.vehicle_id AND te.trip = dv.trip AND (EPOCH_US(te.time) - a) // 30000000 = dv.chunk),
 ca AS (SELECT f.fault_type, m.std_multiple FROM (SELECT UNNEST(['load_spike', 'rpm_decorrelation']) AS fault_type) f, (SELECT UNNEST([0.5::DOUBLE, 1, 2, 3, 5, 8]) AS std_multiple) m),
 hi AS (SELECT wi.vehicle_id, wi.trip, wi.chunk, md.day_cutoff, ca.fault_type, ca.std_multiple, ca.std_multiple * CASE fault_type WHEN 'load_spike' THEN sl ELSE sr END AS magnitude, speed_kmh,
   engine_load_pct_dev + CASE fault_type WHEN 'load_spike' THEN std_multiple * sl ELSE 0 END AS engine_load_pct_dev, rpm_dev + CASE fault_type WHEN 'rpm_decorrelation' THEN std_multiple * sr ELSE 0 END AS rpm_dev
   FROM wi JOIN md USING (vehicle_id), ca WHERE CASE fault_type WHEN 'load_spike' THEN sl ELSE sr END <> 0),
 lo AS (SELECT vehicle_id, day_cutoff, fault_type, std_multiple, magnitude, trip, chunk, MIN({SP}) AS low FROM hi GROUP BY ALL)
 SELECT std_multiple, ROUND(magnitude, 6) AS magnitude, COUNT(*) AS n_windows, ROUND(AVG((low < q[1])::INT), 6) AS detect_rate_at_2pct_fpr, ROUND(AVG((low < q[2])::INT), 6) AS detect_rate_at_5pct_fpr,
  ROUND(AVG((low < q[3])::INT), 6) AS detect_rate_at_10pct_fpr, vehicle_id, 'ICE' AS powertrain, day_cutoff, n_train_trips, n_train_rows, ROUND_EVEN(span, 2) AS actual_train_span_days, fault_type
 FROM lo JOIN lm USING (vehicle_id) JOIN md USING (vehicle_id, day_cutoff) GROUP BY std_multiple, magnitude, vehicle_id, day_cutoff, n_train_trips, n_train_rows, span, fault_type"""


def many(spark, d):
    nodes = probe_nodes(POOL)
    nodes = spark.createDataFrame(pd.concat([nodes.assign(vehicle_id=v) for v in range(8)]))
    nodes = nodes.select(F.col("vehicle_id").cast("int").alias("vehicle_id"), *[F.col(n).cast(t).alias(n) for n, t in fo.NODE_FIELDS])
    p = pool(spark, d).dropna(subset=POOL).select("vehicle_id", "event_id", *POOL)
    return rounded(fo.score_many(p, nodes, POOL, ["vehicle_id"], slice_rows=400).select("vehicle_id", "event_id", F.round("score", 9).alias("score")))


QUERIES = {
    "score_forest": (lambda s, d: rounded(scorer(POOL)(pool(s, d)).select("event_id", "score")), f"WITH {POOL_SQL} SELECT event_id, ROUND(score, 6) AS score FROM ps"),
    "score_forest_per_vehicle": (many, f"WITH {POOL_SQL} SELECT vehicle_id, event_id, ROUND(score, 6) AS score FROM ps WHERE score IS NOT NULL"),
    "fault_row_windows": (lambda s, d: rounded(car_windows(s, d)), f"WITH {CAR_WIN} SELECT vehicle_id, trip, time, ROUND(coolant_temp_c_dev, 6) AS coolant_temp_c_dev, ROUND(rpm_dev, 6) AS rpm_dev, speed_kmh FROM cw"),
    "fault_time_windows": (lambda s, d: pool_windows(s, d).select(*TK, "event_id"), f"WITH {POOL_SQL}{TW1} SELECT vehicle_id, trip, event_id FROM tw"),
    "fault_dense_windows": (lambda s, d: dense(s, d).select(*TK, "event_id", "chunk"), f"WITH {POOL_SQL}{_DENSE} SELECT vehicle_id, trip, event_id, chunk FROM dw JOIN dv USING (vehicle_id, trip, chunk)"),
    "inject_faults": (lambda s, d: rounded(fa.inject(car_windows(s, d), fa.CAR_FAULTS)), f"WITH {CAR_WIN}{_INJ} SELECT vehicle_id, trip, time, fault, ROUND(coolant_temp_c_dev, 6) AS coolant_temp_c_dev, ROUND(rpm_dev, 6) AS rpm_dev, speed_kmh FROM inj"),
    "paired_fault_scores": (lambda s, d: rounded(paired(s, d)), f"WITH {CAR_WIN}{_INJ} SELECT vehicle_id, trip, time, fault, ROUND(original_score, 6) AS original_score, ROUND(injected_score, 6) AS injected_score, "
                            "ROUND(injected_score - original_score, 6) AS delta, original_score > 0 AND injected_score < 0 AS flipped_to_anomalous FROM pair"),
    "paired_fault_summary": (lambda s, d: rounded(fa.paired_summary(paired(s, d))), f"WITH {CAR_WIN}{_INJ} SELECT fault, COUNT(*) AS n_rows, ROUND(AVG(original_score), 6) AS mean_original, ROUND(AVG(injected_score), 6) AS mean_injected, "
                             "ROUND(AVG(injected_score - original_score), 6) AS mean_delta, ROUND(100 * AVG((original_score > 0 AND injected_score < 0)::INT), 6) AS flipped_pct FROM pair GROUP BY 1"),
    "rpm_magnitude_sweep": (lambda s, d: rounded(fa.magnitude_sweep(car_windows(s, d), scorer(CAR), 0.02)), f"WITH {CAR_WIN}, x AS (SELECT * REPLACE (rpm_dev + m AS rpm_dev) FROM (SELECT cw.*, m FROM cw, (SELECT UNNEST([1200.0::DOUBLE, 2000, 3000, 4000, 6000, 8000]) AS m))) "
                            f"SELECT m AS magnitude, ROUND(AVG({SC} - score), 6) AS mean_delta, ROUND(100 * AVG((({SC}) < 0.02)::INT), 6) AS detection_pct_at_threshold FROM x GROUP BY 1"),
    "std_multiple_sweep": (lambda s, d: rounded(sweep(s, d)), f"WITH {_SWEEP}"),
    "threshold_tradeoff_rows": (lambda s, d: rounded(tradeoff(s, d)), f"WITH {_TRADE} SELECT target_fpr_pct, ROUND(threshold, 6) AS threshold, ROUND(actual_fpr_pct, 6) AS actual_fpr_pct, "
                                "ROUND(coolant_spike_detection_pct, 6) AS coolant_spike_detection_pct, ROUND(rpm_decorrelation_detection_pct, 6) AS rpm_decorrelation_detection_pct FROM tr"),
    "threshold_choice": (lambda s, d: rounded(fa.choose(tradeoff(s, d)).drop("feature_cols", "note")), f"WITH {_TRADE} SELECT ROUND(threshold, 6) AS threshold, target_fpr_pct, ROUND(actual_fpr_pct, 6) AS actual_fpr_pct FROM tr WHERE target_fpr_pct = 2"),
    "threshold_tradeoff_windows": (lambda s, d: rounded(wtrade(s, d)), f"WITH {_WTRADE}"),
    "sealed_evaluation_rows": (sealed_rows, f"WITH {CAR_WIN}{_INJ} SELECT fault, COUNT(*) AS n_tested, ROUND(100 * AVG((injected_score < 0.02)::INT), 6) AS detection_pct, "
                               "ROUND((SELECT 100 * AVG((score < 0.02)::INT) FROM cs WHERE vehicle_id % 2 = 1), 6) AS actual_fpr_pct FROM pair GROUP BY 1"),
    "sealed_evaluation_windows": (sealed_windows, f"WITH {POOL_SQL}{TW1}{_SD}{_PINJ} SELECT fault, COUNT(*) AS n_tested, ROUND(100 * AVG((low < 0)::INT), 6) AS detection_pct, "
                                  "ROUND((SELECT 100 * AVG((score < 0)::INT) FROM ps WHERE vehicle_id % 2 = 1 AND score IS NOT NULL), 6) AS actual_fpr_pct FROM pl GROUP BY 1"),
    "score_session": (session, _SESS),
    "score_session_single_car": (session_car, _SESS_CAR),
    "compare_populations": (populations, _POPS),
    "holdout_conditions": (holdouts, f"WITH {CAR_SQL} SELECT 'c' || vehicle_id AS condition, COUNT(*) AS n_rows, ROUND(100 * AVG((score < 0)::INT), 6) AS flag_pct, " + ", ".join(
        f"ROUND(QUANTILE_CONT(score, {p / 100}), 6) AS p{p:02d}" for p in (1, 5, 10, 50, 90)) + " FROM cs GROUP BY 1"),
    "fit_forest_scores": (fitted, None),
    "fit_forests_per_vehicle": (fitted_nodes, None),
    "fit_forest_shape": (forest_shape, _SHAPE),
    "volume_sweep": (volume, None),
    "volume_sweep_by_rule": (volume_by_rule, _volume_sql()),
    "volume_sweep_skips": (lambda s, d: st.volume_skips(fx.solid_trips(s, d, 60), 15, min_windows=MIN_WINDOWS), _skips_sql(15, MIN_WINDOWS)),
}
