"""Rolling features, splits, volume curves, forests and fault studies."""

import datetime as dt
import random
import shutil

import numpy as np
import pandas as pd
import pytest
from parity import compare
from pyspark.sql import functions as F

from roadlake.operators import faults as fa
from roadlake.operators import features as ft
from roadlake.operators import forest as fo
from roadlake.operators import quality as q
from roadlake.operators import splits as sp
from roadlake.operators import studies as st
from roadlake.operators import volume as vo
from roadlake.queries import anomaly, features, streams

T0 = 1_704_067_200_000_000


def test_rolling_median_matches_pandas(spark):
    rng = random.Random(2)
    rows, i = [], 0
    for trip, n in ((0, 500), (1, 90), (2, 1)):
        us = T0
        for _ in range(n):
            us += rng.choice([0, 100_000, 250_000, 1_000_000, 60_000_000] if rng.random() < 0.1 else [500_000])
            rows.append((1, trip, i, us, None if rng.random() < 0.1 else float(rng.randrange(40))))
            i += 1
    df = spark.createDataFrame(rows, "vehicle_id int, trip int, event_id long, us long, rpm double").withColumn("time", F.timestamp_micros("us"))
    got = {r.event_id: r for r in ft.rolling_median_dev(df, ["rpm"], 60, segment_s=75, keep_median=True).collect()}
    assert len(got) == len(rows)
    pdf = pd.DataFrame(rows, columns=["v", "trip", "event_id", "us", "rpm"])
    for _, part in pdf.groupby("trip"):
        part = part.sort_values(["us", "event_id"]).reset_index(drop=True)
        part["rpm"] = part["rpm"].astype(float)
        med = part.set_index(pd.to_datetime(part["us"], unit="us"))["rpm"].rolling("60s").median().to_numpy()
        for e, v, m, us in zip(part["event_id"], part["rpm"], med, part["us"]):
            r = got[e]
            assert (r.rpm_med is None and np.isnan(m)) or r.rpm_med == m
            assert (r.rpm_dev is None) if np.isnan(v) else r.rpm_dev == v - m
            assert r.seconds_since_start == pytest.approx((us - part["us"].iloc[0]) / 1e6)


def test_point_of_window_age_is_outside(spark):
    rows = [(1, 0, 0, T0, 100.0), (1, 0, 1, T0 + 60_000_000, 10.0), (1, 0, 2, T0 + 60_000_000, 20.0)]
    df = spark.createDataFrame(rows, "vehicle_id int, trip int, event_id long, us long, rpm double").withColumn("time", F.timestamp_micros("us"))
    got = {r.event_id: r.rpm_dev for r in ft.rolling_median_dev(df, ["rpm"], 60).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 5.0}


def test_dropped_rows_are_counted(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0), (None, None)], "a double, b double")
    kept, seen = ft.drop_null_features(df, ["a", "b"])
    assert kept.count() == 1 and seen.get == {"n_dropped": 2, "n_rows": 3}


def test_terciles(spark):
    def sizes(n):
        d = spark.createDataFrame([("p", v, 10 + v % 3) for v in range(n)], "powertrain string, vehicle_id long, row_count long")
        c = sp.rank_bucket(d, "row_count", "vehicle_id", ["powertrain"]).groupBy("row_count_tercile").count()
        c = {r[0]: r[1] for r in c.collect()}
        return c.get("low"), c.get("medium"), c.get("high")

    assert sizes(14) == (5, 4, 5) and sizes(13) == (4, 4, 5) and sizes(3) == (1, 1, 1)
    two = spark.createDataFrame([("p", 1, 5, "test"), ("p", 2, 6, " TEST ")], "powertrain string, vehicle_id long, row_count long, split string")
    with pytest.raises(Exception, match="too few test vehicles"):
        sp.select_vehicles(two).collect()


def test_splits(spark, monkeypatch):
    t = spark.range(77).select(F.col("id").alias("trip_id"))
    c = {r[0]: r[1] for r in sp.trip_split(t).groupBy("split").count().collect()}
    assert c == {"train": 53, "val": 12, "test": 12}
    for turns, sizes in ((sp.TURNS, [100, 90, 10, 10, 5, 5]), (7, [40] * 30 + [500, 7, 7] + [3] * 50)):
        monkeypatch.setattr(sp, "TURNS", turns)
        n = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "vehicle_id long, n_rows long")
        got = {r.vehicle_id: r.split for r in sp.balanced_split(n, tie=F.col("vehicle_id")).collect()}
        filled, want, whole = {"train": 0, "val": 0, "test": 0}, {}, sum(sizes)
        for v, size in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
            short = {s: (whole * f - filled[s]) / (whole * f) for s, f in sp.RATIOS.items()}
            want[v] = max(short, key=short.get)
            filled[want[v]] += size
        assert got == want
    with pytest.raises(ValueError, match="without an assignment"):
        sp.apply_manifest(n, sp.balanced_split(n).where("vehicle_id < 3"))


def test_hold_out(spark):
    rows = [(v, i, T0 + i * 3_600_000_000) for v, n in ((1, 20), (2, 4), (3, 3)) for i in range(n)]
    t = spark.createDataFrame(rows, "vehicle_id int, trip int, us long").withColumn("start_time", F.timestamp_micros("us"))
    got = sp.hold_out_last(t).groupBy("vehicle_id", "role").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(1, "train"): 16, (1, "test"): 4, (2, "train"): 1, (2, "test"): 3, (3, "rejected"): 3}


def test_spike_curve(spark):
    rows = [("ICE", 1, "load_spike", 3.0, d, str(int(d)), r, r, r) for d, r in ((0.0, 1.0), (3.0, 0.6), (7.0, 0.62), (30.0, 0.6))] + [("ICE", 1, "load_spike", 3.0, 30.0, "all", 0.6, 0.6, 0.6)]
    d = vo.dedupe_flat(spark.createDataFrame(rows, "powertrain string, vehicle_id long, fault_type string, std_multiple double, actual_train_span_days double, day_cutoff string, "
                                             "detect_rate_at_2pct_fpr double, detect_rate_at_5pct_fpr double, detect_rate_at_10pct_fpr double"))
    assert d.count() == 4 and d.where("actual_train_span_days = 30").first()["day_cutoff"] == "all"
    assert vo.saturation(d).first()["saturation_days_at_95pct_of_own_max"] == 0.0
    s = vo.stabilization(d).first()
    assert s["stabilizes_from_days_within_0.1"] == 3.0 and s["max_minus_final_gap"] == 0.4
    with pytest.raises(ValueError):
        vo.check_results(d.drop("day_cutoff"))


def pool(spark, n=6000):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"event_id": np.arange(n), "vehicle_id": np.where(np.arange(n) % 3, 0, np.arange(n) % 5), "rpm_dev": rng.normal(0, 300, n),
                      "engine_load_pct_dev": rng.normal(0, 10, n), "speed_kmh": rng.uniform(0, 120, n)})
    d["trip"] = d["event_id"] // 500
    d["time"] = pd.to_datetime(T0 + d["event_id"] * 1_000_000, unit="us")
    return spark.createDataFrame(d)


def test_path_lengths():
    assert fo.mean_path(1) == 0 and fo.mean_path(2) == 1
    assert float(fo.mean_path(256)) == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_forest_scores_like_a_walk(spark):
    p = pool(spark)
    model = fo.fit(p, fa.POOL_FEATURES, n_trees=15)
    assert set(model.nodes.groupby("tree")["psi"].first()) == {256} and model.nodes["depth"].max() <= 8
    roots = model.nodes[model.nodes["node"] == 0]
    assert (roots["size"] == 256).all()
    x = p.limit(40).toPandas()
    got = model.score(p.where("event_id < 40")).toPandas().set_index("event_id")["score"]
    nodes = {(r.tree, r.node): r for r in model.nodes.itertuples()}
    for _, row in x[x["event_id"] < 40].iterrows():
        total = 0.0
        for t in range(15):
            at = nodes[t, 0]
            while at.feature >= 0:
                at = nodes[t, 2 * at.node + (1 if row[fa.POOL_FEATURES[at.feature]] <= at.cut else 2)]
            total += at.depth + float(fo.mean_path(at.size))
        assert got[row["event_id"]] == pytest.approx(0.5 - 2 ** (-total / 15 / float(fo.mean_path(256))), abs=1e-12)


def test_forest_finds_outliers_and_is_repeatable(spark):
    p = pool(spark)
    a, b = fo.fit(p, fa.POOL_FEATURES), fo.fit(p.repartition(3), fa.POOL_FEATURES)
    assert a.nodes.equals(b.nodes)
    far = spark.createDataFrame([(1, 0.0, 0.0, 60.0), (2, 4000.0, 90.0, 60.0), (3, None, 1.0, 2.0)], "event_id long, rpm_dev double, engine_load_pct_dev double, speed_kmh double")
    s = {r.event_id: r.score for r in a.score(far).collect()}
    assert s[2] < -0.1 < 0.05 < s[1] and s[3] is None


def test_forest_samples_stay_bounded_on_a_hot_group(spark):
    p = pool(spark)
    s = fo.tree_samples(p, fa.POOL_FEATURES, ["vehicle_id"], ["event_id"], n_trees=5, psi=64).groupBy("vehicle_id", "tree").count().collect()
    assert all(r["count"] == 64 for r in s) and len(s) == 25


def test_many_models_score_like_each_alone(spark):
    p = pool(spark).dropna()
    nodes = fo.fit_forests(p, fa.POOL_FEATURES, ["vehicle_id"], n_trees=10).cache()
    got = fo.score_many(p.select("vehicle_id", "event_id", *fa.POOL_FEATURES), nodes, fa.POOL_FEATURES, ["vehicle_id"], slice_rows=300).toPandas()
    assert len(got) == 6000
    one = fo.Forest(nodes.where("vehicle_id = 0").toPandas(), fa.POOL_FEATURES)
    g = got[got["vehicle_id"] == 0]
    assert np.allclose(g["score"], one.decide(g[fa.POOL_FEATURES].to_numpy()))


def test_model_round_trip(spark, tmp_path):
    model = fo.fit(pool(spark), fa.POOL_FEATURES, n_trees=5)
    model.save(spark, str(tmp_path / "m"))
    again = fo.Forest.load(spark, str(tmp_path / "m"), fa.POOL_FEATURES)
    assert again.nodes.equals(model.nodes)
    with pytest.raises(ValueError):
        fo.Forest.load(spark, str(tmp_path / "m"), fa.CAR_FEATURES)


def test_detection_grows_with_size(spark):
    p = pool(spark)
    model = fo.fit(p, fa.POOL_FEATURES)
    w = fa.time_windows(p, n_trips=10)
    r = fa.std_sweep(w, model.score(p), model.score, p, "load_spike").orderBy("std_multiple").collect()
    for c in ("detect_rate_at_2pct_fpr", "detect_rate_at_5pct_fpr", "detect_rate_at_10pct_fpr"):
        rates = [x[c] for x in r]
        assert all(b >= a - 0.11 for a, b in zip(rates, rates[1:])) and rates[-1] == 1.0
    th = fa.thresholds(model.score(p), [2.0]).first()["threshold"]
    t = fa.row_tradeoff(model.score(p), fa.paired_scores(w, model.score, {"load_spike": ("engine_load_pct_dev", 80.0)}), [2.0, 10.0], ["load_spike"]).orderBy("target_fpr_pct").collect()
    assert t[0]["threshold"] == th and abs(t[0]["actual_fpr_pct"] - 2) < 0.1 and 90 > t[0]["load_spike_detection_pct"] > 30 and t[1]["load_spike_detection_pct"] > t[0]["load_spike_detection_pct"]
    with pytest.raises(PermissionError):
        fa.sealed_evaluation(p, model.score, th, w, fa.std_faults(p, 5.0))
    done = fa.sealed_evaluation(p, model.score, th, w, fa.std_faults(p, 8.0), True, ["vehicle_id", "trip"]).collect()
    assert {r.fault for r in done} == set(fa.POOL_FAULTS) and all(r.detection_pct > 80 for r in done)


def test_fault_windows_are_clean(spark):
    p = pool(spark).withColumn("rpm_dev", F.when(F.col("event_id") % 101 == 0, None).otherwise(F.col("rpm_dev")))
    d = fa.dense_windows(p, keys=["trip"], max_per_trip=3).groupBy("trip", "chunk").agg(F.count("*").alias("n"), F.count("rpm_dev").alias("m"), F.min("time").alias("a"), F.max("time").alias("b")).collect()
    assert d and all(r.n == r.m >= 3 and (r.b - r.a) < dt.timedelta(seconds=30) for r in d)
    rows = fa.row_windows(pool(spark), ["trip"]).groupBy("trip").agg(F.count("*").alias("n"), F.min("event_id").alias("lo")).collect()
    assert len(rows) == 12 and all(r.n == 30 and 30 <= r.lo - r.trip * 500 < 440 for r in rows)


def test_histogram_edges(spark):
    d = spark.createDataFrame([(0.0,), (0.99,), (1.0,), (10.0,), (10.01,), (-0.01,)], "v double")
    assert {r.bin: r.n for r in q.histogram(d, "v", 0, 10, 10).collect()} == {0: 2, 1: 1, 9: 1}


def test_nested_samples_are_those_of_copied_rows(spark):
    """Models that hold one another: the same samples and deviations as from a copy of the rows for each."""
    rng = np.random.default_rng(11)
    labels, last = ["1", "3", "all"], {0: 2, 1: 2, 2: 0}
    rows = [(v, int(s), i, float(rng.normal(100, 5)), 7.0 if v == 1 else float(rng.random())) for v, n in ((0, 4000), (1, 60), (2, 400)) for i, s in enumerate(rng.integers(0, last[v] + 1, n))]
    train = spark.createDataFrame(rows, "vehicle_id int, step int, event_id long, a double, b double").repartition(3)
    by = ["vehicle_id", "day_cutoff"]
    copied = train.withColumn("day_cutoff", F.explode(F.slice(F.array(*[F.lit(x) for x in labels]), F.col("step") + 1, F.lit(3))))
    sizes = st._nested_sizes(train, "vehicle_id", labels, ["a", "b"])
    plain = {tuple(r[:2]): r[2:] for r in copied.groupBy(*by).agg(F.count(F.lit(1)), F.stddev_samp("a"), F.stddev_samp("b")).collect()}
    got = {(r["vehicle_id"], r["day_cutoff"]): (r["n_train_rows"], r["_sd_a"], r["_sd_b"]) for r in sizes.collect()}
    assert set(got) == set(plain) and all(got[k] == pytest.approx(plain[k], rel=1e-12) for k in got)
    assert all(got[1, x][2] == 0 for x in labels)
    models = sizes.select(*by, "step", F.col("n_train_rows").alias("n"))
    small = {"n_trees": 4, "psi": 64}  # a pool of 256 rows: both thresholds bite
    key = lambda d: sorted(tuple(r) for r in d.select(*by, "tree", "_r", "a", "b").collect())
    assert key(fo.nested_samples(train, models, ["a", "b"], by, **small)) == key(fo.tree_samples(copied, ["a", "b"], by, ["event_id"], **small))


@pytest.mark.parametrize(("n_trees", "psi", "feats"), [(100, 256, 3), (3, 3, 2), (4, 1, 1), (5, 1500, 4)])
def test_bit_vectors_find_the_leaves_of_a_walk(n_trees, psi, feats):
    """Values on cuts, ties, trees without a test, more slots than a word has bits."""
    rng, frames = np.random.default_rng(psi), []
    for t in range(n_trees):
        x = np.round(rng.normal(size=(psi, feats)), 1 + t % 4)
        f = pd.DataFrame(fo._grow(x, rng, max(1, int(np.ceil(np.log2(max(psi, 2)))))), columns=["node", "feature", "cut", "size", "depth"])
        frames.append(f.assign(tree=t, psi=psi))
    nodes = pd.concat(frames)
    cuts = nodes.loc[nodes["feature"] >= 0, "cut"].to_numpy()
    x = rng.normal(size=(300, feats))
    if len(cuts):
        x[::3, 0] = rng.choice(cuts, len(x[::3]))
    want = np.zeros(len(x))
    for _, tree in nodes.groupby("tree"):
        at = {r.node: r for r in tree.itertuples()}
        for i, row in enumerate(x):
            r = at[0]
            while r.feature >= 0:
                r = at[2 * r.node + (1 if row[r.feature] <= r.cut else 2)]
            want[i] += r.depth + float(fo.mean_path(r.size))
    norm = float(fo.mean_path(np.array([psi])).mean()) or 1.0
    got = fo.Forest(nodes, [str(i) for i in range(feats)]).decide(x, rows=64)
    assert np.allclose(got, 0.5 - np.exp2(-want / n_trees / norm), atol=1e-12)


@pytest.mark.parametrize("peers", [False, True])
@pytest.mark.parametrize("segment_s", [None, 90, 60, 45, 7.3, 7.5])
def test_rolling_median_of_dense_windows(spark, segment_s, peers):
    """Segments shorter than the window, ties of time, nulls, a value that makes up a third, quiet stretches: equal to a plain walk."""
    rng = random.Random(7)
    rows, i = [], 0
    for trip, n in ((0, 1500), (1, 40)):
        us = T0 + 1_234_567
        for _ in range(n):
            us += rng.choice([0, 0, 100_000, 333_333]) if rng.random() < 0.99 else 50_000_000
            v = None if rng.random() < 0.1 else 0.0 if rng.random() < 0.3 else rng.gauss(1000, 300)
            rows.append((1, trip, i, us, v, None if trip else float(rng.randrange(5))))
            i += 1
    df = spark.createDataFrame(rows, "vehicle_id int, trip int, event_id long, us long, rpm double, load double").withColumn("time", F.timestamp_micros("us"))
    got = ft.rolling_median_dev(df, ["rpm", "load"], 60, segment_s=segment_s, keep_median=True, peers=peers, group_rows=400).collect()
    got = {r.event_id: (r.rpm_med, r.load_med) for r in got}
    assert len(got) == len(rows)
    for trip in (0, 1):
        part = [r for r in rows if r[1] == trip]
        for r in part:
            seen = [x for x in part if r[3] - 60_000_000 < x[3] <= r[3] and (peers or (x[3], x[2]) <= (r[3], r[2]))]
            want = tuple(float(np.median(v)) if (v := [x[c] for x in seen if x[c] is not None]) else None for c in (4, 5))
            assert got[r[2]] == pytest.approx(want, abs=1e-9)


def test_query_windows_hold_all_rows_of_a_time(spark, tmp_path):
    """The registered queries follow the RANGE frame of their SQL where times repeat."""
    n = np.arange(4000)
    events = pd.DataFrame({"event_id": n, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(n % 700 * 3600, unit="s"), "user_id": n % 3, "event_type": np.where(n % 9 == 0, "error", "view"),
                           "value": n * 7919 % 1009 / 7, "props": [f'{{"k": {i % 100}}}' for i in n]})
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    shutil.copy("/root/testdata/sf0.001/nation.parquet", tmp_path)
    found = {**features.QUERIES, **anomaly.QUERIES, **streams.QUERIES}
    names = ["rolling_median", "rolling_median_sql", "population_features_60s", "population_features_30s", "single_car_features", "score_session", "compare_populations", "score_stream"]
    bad = [r for n in names if "ok" not in (r := compare(spark, n, *found[n], str(tmp_path)))]
    assert not bad, bad
