"""Studies built from the parts: per-vehicle volume sweep (M16), scoring a stored
session (M18), population comparison (M19), hold-out conditions (M20)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.operators import faults as fa
from roadlake.operators import features as ft
from roadlake.operators import forest as fo
from roadlake.operators import quality as q
from roadlake.operators import splits as sp
from roadlake.plans import intervals as iv
from roadlake.plans.selection import percentiles
from roadlake.session import materialize


def holdout_report(scored: DataFrame, by: str = "condition", ps: Sequence[float] = (0.01, 0.05, 0.10, 0.50, 0.90)) -> DataFrame:
    """Rows, share flagged at the automatic threshold (score < 0) and score
    percentiles of each condition."""
    scored = materialize(scored.select(by, "score"), "scores")
    base = scored.where("score IS NOT NULL").groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), (F.avg((F.col("score") < 0).cast("double")) * 100).alias("flag_pct"))
    p = percentiles(scored, "score", ps, [by]).groupBy(by).agg(*[
        F.max(F.when(F.col("p") == F.lit(float(x)), F.col("value"))).alias(f"p{int(round(x * 100)):02d}") for x in ps])
    return base.join(p, by)


def score_session(tel: DataFrame, sessions: DataFrame, session_id: str, model: fo.Forest, threshold: float, window_s: float = 60, resample: bool = False,
                  now: dt.datetime | None = None, peers: bool = False) -> DataFrame:
    """One stored session through features, optional 1 Hz, score and flag.

    The session is one trip; its bounds reach the scan as literals.  ``peers`` as in :func:`~roadlake.operators.features.rolling_median_dev`.
    """
    rows = iv.rows_of(tel, sessions, session_id, now).withColumn("trip", F.lit(0))
    car = "coolant_temp_c_dev" in model.features
    cols = ["coolant_temp_c", "rpm"] if car else ["rpm", "engine_load_pct"]
    d = ft.rolling_median_dev(rows, cols, window_s, ["trip"], peers=peers)
    d = ft.trim_cold_start(d, window_s)
    if resample:
        keep = [*model.features, *[c for c in ("rpm", "coolant_temp_c") if c not in model.features]]
        d = ft.resample_last(d, keep, ["trip"], required=model.features)
    else:
        d = ft.drop_null_features(d, model.features)[0]
    return model.score(d).withColumn("is_anomalous", F.col("score") < threshold)


def compare_populations(populations: dict[str, DataFrame], col: str, lo: float, hi: float, bins: int = 80, on: str = "rpm > 0") -> DataFrame:
    """Density of one feature in several populations, engine-on rows only."""
    parts = [df.where(on).select(F.lit(n).alias("population"), F.col(col)) for n, df in populations.items()]
    allp = parts[0]
    for x in parts[1:]:
        allp = allp.unionByName(x)
    return q.histogram(allp, col, lo, hi, bins, ["population"])


def _volume_stages(pool: DataFrame, key: str, trip: str, time: str, window_s: float, max_per_trip: int | None, row_key: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored stages of the study: trip roles, features with roles, fault windows
    of the held-out trips."""
    tk = [key, trip]
    roles = materialize(sp.hold_out_last(q.trip_bounds(pool, tk, time), key, trip), "roles")
    fx = ft.population_features(pool, window_s, tk, time=time, peers=True)
    fx = materialize(fx.join(roles.where("role <> 'rejected'").select(*tk, "role"), tk), "features")
    test = fx.where("role = 'test'").select(*tk, time, *row_key, *fa.POOL_FEATURES)
    wins = fa.dense_windows(test, fa.POOL_FEATURES, tk, time, max_per_trip).withColumn("window_id", F.xxhash64(trip, "chunk"))
    return roles, fx, materialize(wins, "windows")


def volume_skips(pool: DataFrame, window_s: float = 30, key: str = "vehicle_id", trip: str = "trip", time: str = "time", max_windows_per_trip: int | None = None,
                 min_windows: int = 15, row_key: Sequence[str] = ("event_id",)) -> DataFrame:
    """Vehicles the sweep leaves out, with the reason."""
    roles, _, wins = _volume_stages(pool, key, trip, time, window_s, max_windows_per_trip, row_key)
    n_win = wins.groupBy(key).agg(F.count_distinct("window_id").alias("n_windows"))
    few = F.concat(F.lit("only "), F.coalesce("n_windows", F.lit(0)).cast("string"), F.lit(" fault windows"))
    rejected = roles.where("role = 'rejected'").select(key).distinct().select(key, F.lit("too few trips to hold any out").alias("reason"))
    tested = roles.where("role = 'test'").select(key).distinct().join(n_win, key, "left").where(F.coalesce("n_windows", F.lit(0)) < min_windows)
    return rejected.unionByName(tested.select(key, few.alias("reason")))


def _nested_sizes(train: DataFrame, key: str, labels: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows and standard deviations of every cumulative step, merged from moments of the rows that each step adds."""
    parts = train.groupBy(key, "step").agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("v", F.var_pop), ("lo", F.min), ("hi", F.max))])
    held = F.explode(F.slice(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(x).alias("day_cutoff")) for i, x in enumerate(labels)]), F.col("step") + 1, F.lit(len(labels))))
    d = parts.withColumn("_s", held).drop("step").select("*", "_s.*")
    whole = Window.partitionBy(key, "step")  # a row per step that adds some
    d = d.select("*", *[(F.sum(F.col("_n") * F.col(f"_m_{c}")).over(whole) / F.sum("_n").over(whole)).alias(f"_mean_{c}") for c in cols])
    n = F.sum("_n")

    def deviation(c: str):
        squares = F.sum(F.col("_n") * (F.col(f"_v_{c}") + F.pow(F.col(f"_m_{c}") - F.col(f"_mean_{c}"), 2)))
        return F.when(n > 1, F.when(F.min(f"_lo_{c}") == F.max(f"_hi_{c}"), 0.0).otherwise(F.sqrt(squares / (n - 1)))).alias(f"_sd_{c}")

    return d.groupBy(key, "day_cutoff", "step").agg(n.alias("n_train_rows"), *[deviation(c) for c in cols])


def volume_sweep(pool: DataFrame, day_cutoffs: Sequence[float] = (1, 3, 7, 14, 30), window_s: float = 30, powertrain: str = "ICE", key: str = "vehicle_id",
                 trip: str = "trip", time: str = "time", n_trees: int = fo.N_TREES, max_windows_per_trip: int | None = None, min_windows: int = 15,
                 min_rows: int = 10, row_key: Sequence[str] = ("event_id",), fit=fo.fit_nested, score=fo.score_many) -> DataFrame:
    """For every vehicle and training step, an own model and its detection
    rates on the vehicle's held-out trips.

    One job over all vehicles.  Features are computed once per trip (they are
    causal and per trip, so a step's features are those of its trips).  Steps hold one
    another, so a training row stands once, with the first step that holds it:
    deviations are merged from moments per step, and only sampled rows are dealt out to models,
    which are keyed (vehicle, step).  ``fit`` and ``score`` may be others than the isolation forest's, with the
    same arguments.
    """
    feats, tk, mk = fa.POOL_FEATURES, [key, trip], [key, "day_cutoff"]
    roles, fx, wins = _volume_stages(pool, key, trip, time, window_s, max_windows_per_trip, row_key)
    ready = wins.groupBy(key).agg(F.count_distinct("window_id").alias("_w")).where(F.col("_w") >= min_windows).select(key)

    steps = sp.volume_steps(roles.where("role = 'train'").join(ready, key, "left_semi"), day_cutoffs)
    n_trips = steps.groupBy(*mk).agg(F.count(F.lit(1)).alias("n_train_trips"), (
        (F.max(F.unix_micros("start_time")) - F.min(F.unix_micros("first_time"))) / 86400e6).alias("_span"))
    firsts = sp.first_step(roles.where("role = 'train'").join(ready, key, "left_semi"), day_cutoffs).select(*tk, "step")
    train = fx.where("role = 'train'").dropna(subset=feats).join(firsts, tk)
    labels = [str(d) for d in sorted(day_cutoffs)] + ["all"]
    sizes = _nested_sizes(train, key, labels, list(fa.POOL_FAULTS.values()))
    sizes = materialize(sizes.where(F.col("n_train_rows") >= min_rows).join(n_trips, mk), "sizes")
    models = sizes.select(*mk, "step", F.col("n_train_rows").alias("n"))
    nodes = materialize(fit(train, models, feats, mk, row_key, n_trees), "forests")
    sizes = sizes.drop("step")

    test = fx.where("role = 'test'").dropna(subset=feats).select(key, *row_key, *feats)
    scored = score(test.join(sizes.select(*mk), key), nodes, feats, mk)
    lim = percentiles(materialize(scored.select(*mk, "score"), "scores"), "score", list(fa.REFERENCE_FPR), mk)
    named = {f"detect_rate_at_{int(round(f * 100))}pct_fpr": f for f in fa.REFERENCE_FPR}
    lim = lim.groupBy(*mk).agg(*[F.max(F.when(F.col("p") == F.lit(float(f)), F.col("value"))).alias(f"_t_{n}") for n, f in named.items()])

    cases = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(float(m)).alias("m")) for f in fa.POOL_FAULTS for m in fa.STD_MULTIPLES]))
    hit = wins.join(sizes, key).withColumn("_c", cases)
    sd = F.coalesce(*[F.when(F.col("_c.f") == f, F.col(f"_sd_{c}")) for f, c in fa.POOL_FAULTS.items()])
    hit = hit.withColumn("_sd", sd).where(F.col("_sd").isNotNull() & (F.col("_sd") != 0))
    hit = hit.withColumn("fault_type", F.col("_c.f")).withColumn("std_multiple", F.col("_c.m")).withColumn("magnitude", F.col("std_multiple") * F.col("_sd"))
    for f, c in fa.POOL_FAULTS.items():
        hit = hit.withColumn(c, F.when(F.col("fault_type") == f, F.col(c) + F.col("magnitude")).otherwise(F.col(c)))
    case = [*mk, "fault_type", "std_multiple", "magnitude"]
    low = score(hit.select(*case, "window_id", *row_key, *feats), nodes, feats, mk).groupBy(*case, "window_id").agg(F.min("score").alias("_low"))
    per = low.join(lim, mk).select(*case, *[(F.col("_low") < F.col(f"_t_{n}")).cast("double").alias(n) for n in named])
    res = per.groupBy(*case).agg(F.count(F.lit(1)).alias("n_windows"), *[F.avg(n).alias(n) for n in named]).join(sizes, mk)
    return res.select("std_multiple", "magnitude", "n_windows", *named, F.col(key).alias("vehicle_id"), F.lit(powertrain).alias("powertrain"), "day_cutoff",
                      "n_train_trips", "n_train_rows", F.bround("_span", 2).alias("actual_train_span_days"), "fault_type")
