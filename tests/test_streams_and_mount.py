"""Pairing (batch and stream), mount calibration, file sources."""

import bisect
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parity import compare
from roadlake.functions import rotation as ro
from roadlake.operators import cleaning as cl
from roadlake.operators import mount as mo
from roadlake.operators.merge import merge_nearest
from roadlake.operators.rollup import rollup_1min
from roadlake.queries import streams
from roadlake.schemas import ACCELS, PIDS
from roadlake.sources import files as fs
from roadlake.sources import messages as ms
from roadlake.streaming import pairing, rollup, run, scoring, slots

T0 = 1_704_067_200_000_000
OBD = "vehicle_id int, event_id long, us long, " + ", ".join(f"{c} double" for c in PIDS)
IMU = "vehicle_id int, event_id long, us long, " + ", ".join(f"{c} double" for c in ACCELS)


def sides(spark, obd, imu):
    at = lambda d: d.withColumn("time", F.timestamp_micros("us"))
    o = spark.createDataFrame([(v, i, T0 + t, *[float(i)] * len(PIDS)) for v, i, t in obd], OBD)
    m = spark.createDataFrame([(v, i, T0 + t, *[float(i)] * len(ACCELS)) for v, i, t in imu], IMU)
    return at(o), at(m)


def greedy(obd, imu, window=500_000):
    out = set()
    for v in {x[0] for x in obd + imu}:
        mine = sorted((t, i) for w, i, t in imu if w == v)
        times, used = [t for t, _ in mine], set()
        for t, i in sorted((t, i) for w, i, t in obd if w == v):
            near = [j for j in range(bisect.bisect_left(times, t - window), bisect.bisect_right(times, t + window)) if j not in used]
            j = min(near, key=lambda j: (abs(times[j] - t), j), default=None)
            out.add((v, i, None if j is None else mine[j][1]))
            used.add(j)
        out |= {(v, None, mine[j][1]) for j in range(len(mine)) if j not in used}
    return out


def pairs(df):
    rows = [(r.vehicle_id, r.obd_id, r.imu_id) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_merge_cases(spark):
    obd = [(1, 10, 0), (1, 11, 100_000), (1, 12, 200_000), (2, 20, 1_000_000), (3, 30, 0), (4, 40, 5_000_000)]
    imu = [(1, 50, 50_000), (1, 51, 150_000), (1, 52, 900_000), (2, 60, 500_000), (2, 61, 1_500_000), (3, 70, 500_001), (4, 80, 5_000_000)]
    got = pairs(merge_nearest(*sides(spark, obd, imu)))
    assert got == greedy(obd, imu)
    assert (2, 20, 60) in got and (3, 30, None) in got and (3, None, 70) in got and (4, 40, 80) in got


@pytest.mark.parametrize("warmup", [0.5, 3])
def test_merge_matches_sequential_walk(spark, warmup):
    rng = random.Random(4)
    obd, imu, i = [], [], 0
    for v, n in ((1, 900), (2, 60)):
        for side, step in ((obd, 90_000), (imu, 140_000)):  # scarce partners: long dependency chains
            t = 0
            for _ in range(n):
                t += rng.choice([step, step // 3, step * 2])
                side.append((v, i, t))
                i += 1
    assert pairs(merge_nearest(*sides(spark, obd, imu), segment_s=4, warmup_s=warmup)) == greedy(obd, imu)


def test_stream_agrees_with_batch_over_many_batches(spark, tmp_path):
    rng = random.Random(9)
    obd = sorted({(v, 0, rng.randrange(0, 20_000_000)) for v in (1, 2) for _ in range(60)}, key=lambda x: x[2])
    imu = sorted({(v, 0, rng.randrange(0, 20_000_000)) for v in (1, 2) for _ in range(60)}, key=lambda x: x[2])
    obd, imu = [(v, i, t) for i, (v, _, t) in enumerate(obd)], [(v, 1000 + i, t) for i, (v, _, t) in enumerate(imu)]
    o, m = sides(spark, obd, imu)
    both = ms.to_messages(o.unionByName(m, allowMissingColumns=True), "event_id < 1000", "event_id >= 1000", "vehicle_id")
    for n, (a, b) in enumerate([(0, 7), (7, 14), (14, 21)]):
        lo, hi = (F.timestamp_micros(F.lit(T0 + x * 1_000_000)) for x in (a, b))
        both.where((F.col("time") >= lo) & (F.col("time") < hi)).select("topic", "key", "value").coalesce(1).write.json(str(tmp_path / f"in{n}"))
    end = sides(spark, [(-1, 0, 10_000_000_000)], [])[0].unionByName(sides(spark, [], [])[1], allowMissingColumns=True)
    ms.to_messages(end, "true", "false", "vehicle_id").select("topic", "key", "value").coalesce(1).write.json(str(tmp_path / "in9"))
    so, si, _ = ms.route(ms.parse(ms.file_messages(spark, str(tmp_path / "in*"), 1)))
    got = run.drain_to_parquet(pairing.merge_stream(so, si), "t-merge").where("node_id <> '-1'")
    key = lambda d, k: sorted(tuple((x is None, x or 0) for x in (r[k] if isinstance(r[k], int) else int(r[k]), r.rpm, r.accel_x)) for r in d.collect())
    assert key(got, "node_id") == key(merge_nearest(o, m), "vehicle_id")


class Store:
    """A state variable of a processor under test; counts what is read."""

    def __init__(self):
        self.held, self.reads = {}, 0

    def getValue(self, key):
        self.reads += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def exists(self):
        return None in self.held

    def get(self):
        return self.held.get(None)

    def update(self, value):
        self.held[None] = value

    def clear(self):
        self.held.clear()


class Handle:
    def __init__(self):
        self.timers, self.stores = [], {}

    def getMapState(self, name, *_):
        return self.stores.setdefault(name, Store())

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.append(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def frame(rows):
    """Rows (kind, second) as the processor gets them."""
    d = pd.DataFrame([(k, int(t * 1e6), int(t * 1e6)) for k, t in rows], columns=["kind", "us", "rid"])
    return d.assign(**{c: float("nan") for c in [*PIDS, *ACCELS]}).assign(rpm=[t if k == "obd" else None for k, t in rows], accel_x=[t if k == "imu" else None for k, t in rows])


def test_pairing_reads_closed_slots_only():
    """What a timer reads does not depend on what waits for later; every row comes out once."""
    rows = [(k, t / 10 + (0.03 if k == "imu" else 0)) for t in range(0, 3000) for k in ("obd", "imu") if not (k == "imu" and t % 7 == 0)]
    reads = {}
    for waiting in (3000, 30_000):
        h, p = Handle(), pairing.PairingProcessor("node_id", 500_000, 8_000_000)
        p.init(h)
        later = [("obd", 1000.0 + t / 10) for t in range(waiting)]
        got = list(p.handleInputRows(("1",), iter([frame(rows), frame(later)]), Clock(0)))
        h.stores["slots"].reads = 0
        for end in (20, 100, 290, 500):
            got += list(p.handleExpiredTimer(("1",), Clock(end * 1000), None))
        reads[waiting] = h.stores["slots"].reads
        out = pd.concat(got)
        both = [t for k, t in rows if k == "obd"], [t for k, t in rows if k == "imu"]
        assert sorted(out["rpm"].dropna()) == both[0] and sorted(out["accel_x"].dropna()) == both[1] and not out["late"].any()
        pairs_ = out[out["rpm"].notna() & out["accel_x"].notna()]
        assert len(pairs_) == len(both[1]) and (abs(pairs_["rpm"] - pairs_["accel_x"]) <= 0.5).all()
    assert reads[3000] == reads[30_000] < 60


def test_late_rows_come_out_at_once_and_alone():
    h, p = Handle(), pairing.PairingProcessor("node_id", 500_000, 8_000_000)
    p.init(h)
    list(p.handleInputRows(("1",), iter([frame([("obd", 10.0), ("imu", 10.1), ("obd", 50.0)])]), Clock(0)))
    assert len(pd.concat(p.handleExpiredTimer(("1",), Clock(48_000), None))) == 1
    late = pd.concat(p.handleInputRows(("1",), iter([frame([("obd", 10.2), ("imu", 9.9), ("imu", 50.2)])]), Clock(48_000)))
    assert [tuple(r) for r in late[["rpm", "accel_x"]].fillna(0).to_numpy()] == [(10.2, 0), (0, 9.9)] and late["late"].all()
    rest = pd.concat(p.handleExpiredTimer(("1",), Clock(60_000), None))
    assert rest[["rpm", "accel_x", "late"]].to_numpy().tolist() == [[50.0, 50.2, False]]
    assert not h.stores["slots"].held and not h.stores["waiting"].held


def test_ordered_pages_match_a_sorted_list():
    rng, plain, kept = random.Random(3), [], {}
    pages = slots.OrderedPages([], None)
    for step in range(6000):
        if plain and rng.random() < (0.3 if step < 4000 else 0.7):
            v = plain.pop(rng.randrange(len(plain)))
            pages.remove(v)
        else:
            v = rng.choice([float(rng.randrange(40)), rng.random() * 1000, 7.0])
            bisect.insort(plain, v)
            pages.insert(v)
        n = len(plain)
        assert not plain or pages.median() == (plain[(n - 1) // 2] + plain[n // 2]) / 2
        if step % 500 == 499:  # stored and read back
            kept = {**{k: v for k, v in kept.items() if k not in pages.gone}, **{k: np.array(v).tobytes() for k, v in pages.pages.items()}}
            pages = slots.OrderedPages(pages.directory, kept.__getitem__)
            assert sum(pages.counts) == n and len(pages.ids) <= n // 64 + 2


def test_online_medians_follow_new_rows():
    """Equal to rolling medians over whole trips; what a trigger reads does not depend on how much the window holds."""
    rng, reads = np.random.default_rng(4), {}
    for rate in (20, 200):
        n = 60 * rate
        t = np.sort(rng.integers(0, 60 * 100, n)) * 10_000
        d = pd.DataFrame({"us": t, "rid": np.arange(n), "rpm": np.round(rng.normal(2000, 300, n)), "load": np.where(rng.random(n) < 0.2, np.nan, rng.random(n))})
        h, p = Handle(), scoring.DeviationProcessor(["trip"], ["rpm", "load"], ["event_id", "rpm"], 30_000_000, 1_000_000)
        p.init(h)
        got = []
        for a in range(0, 60, 2):
            part = d[(d["us"] >= a * 1_000_000) & (d["us"] < (a + 2) * 1_000_000)]
            list(p.handleInputRows((7,), iter([part.sample(frac=1, random_state=a)]), Clock(0)))
            for s in h.stores.values():
                s.reads = 0
            got += list(p.handleExpiredTimer((7,), Clock((a + 2) * 1000 - 500), None))
            reads[rate] = h.stores["slots"].reads
        got += list(p.handleExpiredTimer((7,), Clock(100_000), None))
        out = pd.concat(got).set_index("event_id").sort_index()
        rolled = d.set_index(pd.to_datetime(d["us"], unit="us"))[["rpm", "load"]].rolling("30s").median().reset_index(drop=True)
        late = d["us"] >= d["us"].iloc[0] + 30_000_000
        for c in ("rpm", "load"):
            np.testing.assert_allclose(out[f"{c}_dev"], (d[c] - rolled[c])[late].to_numpy(), atol=1e-12)
        assert len(h.stores["slots"].held) <= 32
    assert reads[20] == reads[200] <= 8


def buckets(spark, *rows):
    return spark.createDataFrame([(f"2025-06-0{d} 10:{m:02}:00", float(v)) for d, m, v in rows], "t string, v double").selectExpr("CAST(t AS TIMESTAMP) AS bucket", "v")


def stored(spark, path):
    return sorted((r.bucket.day, r.bucket.minute, r.v) for r in rollup.current_rollup(spark, path).collect())


def test_rollup_survives_a_new_checkpoint(spark, tmp_path):
    path = str(tmp_path)
    one, two = rollup.bucket_writer(path, "one"), rollup.bucket_writer(path, "two")
    one(buckets(spark, (1, 1, 1), (1, 2, 2)), 5)
    one(buckets(spark, (1, 1, 10), (2, 1, 5)), 6)
    two(buckets(spark, (1, 3, 7), (1, 2, 20)), 0)
    want = [(1, 1, 10), (1, 2, 20), (1, 3, 7), (2, 1, 5)]
    assert stored(spark, path) == want
    two(buckets(spark, (1, 3, 7), (1, 2, 20)), 0)  # retried
    one(buckets(spark, (1, 1, 10), (2, 1, 5)), 6)
    assert stored(spark, path) == want
    assert rollup.RollupTable(spark, path).manifest("2025-06-01")["epochs"] == {"one": 6, "two": 0}
    assert [r.v for r in rollup.current_rollup(spark, path, ["2025-06-02"]).collect()] == [5.0]


def test_rollup_batch_that_failed_between_dates(spark, tmp_path, monkeypatch):
    path, w = str(tmp_path), rollup.bucket_writer(str(tmp_path), "s")
    w(buckets(spark, (1, 1, 1), (2, 1, 1)), 0)
    swap = rollup.RollupTable._swap

    def failing(self, date, manifest):
        if date.endswith("02"):
            raise OSError("lost")
        swap(self, date, manifest)

    monkeypatch.setattr(rollup.RollupTable, "_swap", failing)
    with pytest.raises(OSError):
        w(buckets(spark, (1, 1, 2), (2, 1, 2)), 1)
    assert stored(spark, path) == [(1, 1, 2), (2, 1, 1)]
    monkeypatch.undo()
    w(buckets(spark, (1, 1, 2), (2, 1, 2)), 1)
    assert stored(spark, path) == [(1, 1, 2), (2, 1, 2)] and len(rollup.RollupTable(spark, path).manifest("2025-06-01")["parts"]) == 2


def test_rollup_folds_its_parts(spark, tmp_path):
    path, w, want = str(tmp_path), rollup.bucket_writer(str(tmp_path), "s", 3), {}
    for i in range(11):
        rows = [(1 + i % 2, i % 5, i), (1, 30, 100 + i)]
        w(buckets(spark, *rows), i)
        want |= {(d, m): float(v) for d, m, v in rows}
        assert stored(spark, path) == sorted((d, m, v) for (d, m), v in want.items())
    t = rollup.RollupTable(spark, path)
    live = {p for d in ("2025-06-01", "2025-06-02") for k in ("parts", "retired") for p in t.manifest(d)[k]}
    assert len(t.manifest("2025-06-01")["parts"]) < 3
    assert {f"data/{h}/date={d}" for h in t._names("data") for d in t._dates(f"data/{h}")} == live  # nothing else is kept
    w(buckets(spark), 11)
    assert not any(h.endswith("s-11") for h in t._names("data"))


def test_rollup_stream_after_a_restart(spark, tmp_path):
    """A second checkpoint over grown input: the stored rollup is that of all rows."""
    tel = sides(spark, [(1, i, i * 500_000) for i in range(700)], [])[0].select("time", *PIDS).withColumns({c: F.lit(0.5) for c in ACCELS})
    path, src = str(tmp_path / "r"), str(tmp_path / "in")
    stream = lambda: rollup.rollup_stream(spark.readStream.schema(tel.schema).parquet(src))
    minute = F.minute("time")
    for part in (tel.where(minute <= 2), tel.where(minute > 2)):
        part.write.mode("append").parquet(src)
        run.drain_each(stream(), rollup.bucket_writer(path), "restarted", "update")
    want = rollup_1min(tel)
    key = lambda d: sorted(tuple(r) for r in d.select(want.columns).collect())
    assert key(rollup.current_rollup(spark, path)) == key(want)


def test_bad_messages(spark):
    rows = [("telemetry/vehicle/obd", "1", '{"ts": 1719123456.789, "mode": "normal", "speed_kmh": 65.7, "rpm": null}'), ("telemetry/vehicle/obd", "1", "not json"),
            ("telemetry/vehicle/imu", "1", '{"accel_x": 1.0}'), ("telemetry/vehicle/obd", "1", '{"ts": 1719123456.0, "speed_kmh": "fast", "rpm": 800}'), ("other", "1", '{"ts": 1.0}')]
    p = ms.parse(spark.createDataFrame(rows, ms.ENVELOPE)).cache()
    assert [r.reject for r in p.collect()] == [None, "unparseable", "no ts", None, "unknown topic"]
    obd, imu, bad = ms.route(p)
    got = {r.speed_kmh: (r.rpm, r.time.microsecond) for r in obd.collect()}
    assert got == {65.7: (None, 789000), None: (800.0, 0)} and imu.count() == 0 and bad.count() == 3


def test_tilt_cases(spark):
    cases = [(0.0, 0.0, 9.81), (6.936, 0.0, 6.936), (0.0, 0.0, -9.81), (1.0, -2.0, 9.0), (-7.9, 0.4, 5.4)]
    d = spark.createDataFrame(cases, "x double, y double, z double").withColumn("m", ro.tilt_matrix(F.col("x"), F.col("y"), F.col("z")))
    for r in d.select("x", "y", "z", "m", F.array(*ro.apply_matrix(F.col("m"), F.col("x"), F.col("y"), F.col("z"))).alias("u"), F.array(*ro.apply_matrix(F.col("m"), F.lit(6.936), F.lit(3.0), F.lit(6.936))).alias("p")).collect():
        g = np.array([r.x, r.y, r.z])
        assert np.allclose(r.u, [0, 0, np.linalg.norm(g)], atol=1e-9) and np.allclose(np.array(r.m).reshape(3, 3), ro.tilt_array(g))
        if r.x == 6.936:
            assert np.allclose(r.p, [0, 3.0, math.hypot(6.936, 6.936)], atol=1e-9)
    zero = spark.range(1).select(ro.tilt_matrix(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("m")).first()["m"]
    assert zero == [1, 0, 0, 0, 1, 0, 0, 0, 1]


# A drive cycle of our own: a decaying swing.
REF = [round(2.1 * math.sin(0.8 * i + 0.3) * (1 - 0.06 * i), 3) for i in range(9)]


def test_heading_cases(spark):
    rows = []
    for deg in (0, 90, 180, 30, 45, -120):
        c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
        for i, r in enumerate(REF):
            n = (i % 3 - 1) * 0.05
            rows.append((deg, 7, c * r - s * n, s * r + c * n, r))
    d = mo.window_stats(spark.createDataFrame(rows, "vehicle_id int, window_id long, ax double, ay double, ref_accel double")).collect()
    assert len(d) == 6
    for r in d:
        assert abs((r.heading_deg - r.vehicle_id + 540) % 360 - 180) < 5 and r.projected_corr > 0.95
    assert {r.vehicle_id: r.axis for r in d}[45] == "undetermined" and {r.vehicle_id: (r.axis, r.forward_sign) for r in d}[180] == ("x", -1)


def fresh(spark, runs):
    rows = [(v, i, T0 + i * 1_000_000, r * 0.95, 0.02, 9.81, r) for v, refs in runs.items() for i, r in enumerate(refs)]
    return spark.createDataFrame(rows, "vehicle_id int, event_id long, us long, ax double, ay double, az double, ref_accel double").withColumn("time", F.timestamp_micros("us"))


def test_event_window_cases(spark):
    event = [1.55 + 0.35 * min(i, 8 - i) for i in range(9)] + [0.1]
    d = fresh(spark, {1: [0.2] * 30, 2: event, 3: [1.6, 0.1, 0.2] + [0.0] * 5, 4: [2.0] * 25})
    got = mo.event_windows(d, trigger=1.5, end=0.5, min_samples=5, max_samples=10, segment_s=4, warmup_s=2)
    n = {r[0]: r[1] for r in got.groupBy("vehicle_id").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.col("event_id").cast("int")))).alias("e")).collect()}
    assert set(n) == {2, 4} and len(n[2].split(",")) == 10 and n[4] == ",".join(map(str, range(20)))  # two full windows, an open rest


def test_axis_streaks(spark):
    x, y, u = ("x", 1), ("y", 1), ("undetermined", 0)
    rows = [(v, T0 + i, a, s) for v, seq in {1: [x, u, x, x], 2: [x, x, y, y, y]}.items() for i, (a, s) in enumerate(seq)]
    d = spark.createDataFrame(rows, "vehicle_id int, window_id long, axis string, forward_sign int")
    locks = sorted((r.vehicle_id, r.axis, r.streak) for r in mo.axis_lock(d).where("locked").collect())
    assert locks == [(1, "x", 3), (2, "y", 3)]


def test_stage_machine():
    ident = np.eye(3)
    m = mo.StageMachine(tilt=ident, yaw=0.0)
    parked = np.array([-7.9, 0.4, 5.4])
    assert m.stage == "ready" and m.gravity(parked) and m.resets == 1 and m.stage == "needs_yaw"
    assert np.allclose(m.tilt @ parked, [0, 0, np.linalg.norm(parked)]) and not m.gravity(parked)
    calm = mo.StageMachine(tilt=ident, yaw=0.0)
    assert not calm.gravity(np.array([0.85, 0, 9.77])) and not calm.gravity(np.array([0, 0, 3.0])) and calm.stage == "ready"
    m = mo.StageMachine(min_windows=2, trigger=1.5, end=0.5, min_samples=5, max_samples=20, min_corr=0.4, tolerance=12)
    tipped = np.array([6.936, 0.0, 6.936])
    assert m.stage == "needs_tilt" and m.gravity(tipped)
    locked = any(m.sample(np.array([6.936, r, 6.936]), r) for _ in range(6) for r in [1.7 + 0.4 * min(i, 6 - i) for i in range(7)] + [0.1])
    assert locked and m.stage == "ready" and abs(m.yaw - 90) < 5


def test_pooled_heading_through_noise():
    deg, rng = 70.0, np.random.default_rng(2026)
    c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
    refs = [3.2 * math.sin(1.1 * i) * (0.4 + (i % 5) / 4) for i in range(1, 27)]
    m = mo.StageMachine(min_windows=5, trigger=0.15, end=0.05, min_samples=6, max_samples=8, min_corr=0.4, tolerance=12, tilt=np.eye(3))
    for _ in range(4):
        for r in refs:
            f, n = rng.uniform(-.5, .5, 2)
            m.sample(np.array([c * (r + f) - s * n, s * (r + f) + c * n, 9.81]), r)
    assert m.stage == "ready" and abs((m.yaw - deg + 540) % 360 - 180) < 15


def test_calibration_matches_a_plain_walk(spark):
    from roadlake import fixtures as fx

    log = fx.mount_log(spark, "/root/testdata/sf0.01").where("vehicle_id < 2").cache()
    cfg = {"min_windows": 3, "min_corr": 0.4, "tolerance": 20.0, "min_samples": 4, "max_samples": 6}
    got = sorted((r.vehicle_id, r.from_us, r.stage, round(r.yaw_deg or 0, 6)) for r in mo.calibrate(mo.calibration_events(log), **cfg).collect())
    want = []
    for v in (0, 1):
        m, at, speed, acc, still = mo.StageMachine(**cfg), None, 0.0, [], []
        for r in sorted((r for r in log.collect() if r.vehicle_id == v), key=lambda r: (r.time, r.event_id)):
            us = (r.time.replace(tzinfo=None) - __import__("datetime").datetime(1970, 1, 1)) // __import__("datetime").timedelta(microseconds=1)
            at = us if at is None else at
            a, ref, is_fresh = np.array([r.ax, r.ay, r.az]), 0.0, False
            acc.append(a)
            if r.speed_kmh != speed and us - at >= 1_000_000:
                if us - at < 3_000_000:
                    ref, is_fresh = (r.speed_kmh - speed) / 3.6 / ((us - at) / 1e6), True
                    a = np.mean(acc, axis=0)
                at, speed, acc = us, r.speed_kmh, []
            changed = False
            still = [*still, a] if r.speed_kmh < 1 else []
            if len(still) == 20:
                changed, still = m.gravity(np.mean(still, axis=0)), []
            if not changed and is_fresh:
                changed = m.sample(a, ref)
            if changed:
                want.append((v, us, m.stage, round(m.yaw or 0, 6)))
    assert got == want and any(w[2] == "ready" for w in want)


def plain_marks(rows):
    """Accepted speed changes of one node's rows (us, tie, speed or None), one row after the other."""
    at, speed, out = rows[0][0], 0.0, []
    for us, tie, v in rows:
        dt = (us - at) / 1e6
        if v is None or v == speed or dt < 1:
            continue
        out.append((tie, us, "fresh" if dt < 3 else "anchor", (v - speed) / 3.6 / dt if dt < 3 else None, at))
        at, speed = us, v
    return out


def test_speed_marks_match_a_plain_walk(spark):
    """Plateaus, missing speeds, equal times and quick changes; short segments, so that states cross many borders."""
    rng, rows = random.Random(12), []
    for node in (1, 2, 3):
        us, v = T0 + node * 777_000, 0.0
        for i in range(500 if node == 1 else 100):
            us += rng.choice([0, 100_000, 300_000, 1_000_000, 1_000_001, 2_999_999, 3_000_000]) if i % 97 else 400_000_000
            v = rng.choice([v, v, v, v + 1, 0.0, float(rng.randrange(60))])
            rows.append((node, i, us, None if rng.random() < 0.1 else v))
    d = spark.createDataFrame(rows, "vehicle_id int, event_id long, us long, speed_kmh double").withColumn("time", F.timestamp_micros("us")).repartition(4)
    got = {(r.vehicle_id, r.event_id): r for r in mo.fresh_samples(d, segment_s=60, warmup_s=4).collect()}
    assert len(got) == len(rows)
    for node in (1, 2, 3):
        mine = sorted((us, i, v) for n, i, us, v in rows if n == node)
        marks = {tie: m for tie, *m in plain_marks(mine)}
        opened = mine[0][0]
        for us, i, _ in mine:
            r = got[node, i]
            _, mark, ref, before = marks.get(i, (None, None, None, opened))
            assert (r.mark, r.interval_us) == (mark, before) and (r.ref_accel == pytest.approx(ref) if ref is not None else r.ref_accel is None)
            opened = us if mark else opened


def plain_windows(rows, trigger, end, least, most):
    opened, kept, out = None, [], {}
    for us, tie, ref in rows:
        if opened is None:
            if abs(ref) >= trigger:
                opened, kept = us, [tie]
            continue
        kept.append(tie)
        if len(kept) >= most or abs(ref) < end:
            out |= dict.fromkeys(kept, opened) if len(kept) >= least else {}
            opened = None
    return out


@pytest.mark.parametrize(("least", "most"), [(3, 5), (1, 1), (2, 40)])
def test_event_windows_match_a_plain_walk(spark, least, most):
    rng, rows = random.Random(most), []
    for node in (1, 2):
        us = T0
        for i in range(250):
            us += rng.choice([1_000_000, 2_500_000, 30_000_000])
            rows.append((node, i, us, rng.choice([0.01, 0.1, 0.1, 0.3, -0.4]), 0.0, 0.0))
    d = spark.createDataFrame(rows, "vehicle_id int, event_id long, us long, ref_accel double, ax double, ay double").withColumn("time", F.timestamp_micros("us"))
    got = {(r.vehicle_id, r.event_id): r.window_id for r in mo.event_windows(d, trigger=0.25, end=0.05, min_samples=least, max_samples=most, segment_s=30, warmup_s=6).collect()}
    want = {(n, i): w for n in (1, 2) for i, w in plain_windows([(us, i, ref) for m, i, us, ref, *_ in rows if m == n], 0.25, 0.05, least, most).items()}
    assert got == want and want


def test_calibration_over_many_turned_mounts(spark):
    """Mounts that are turned again and again or never, a crowded node, changes in the tick of a sample: the states of
    segments agree with one walk of the whole node."""
    rng, rows = np.random.default_rng(7), []
    for node, n, turn in ((1, 1500, 300), (2, 500, 10**9), (3, 600, 40)):
        us, g, head = T0, np.array([0.0, 0.0, 9.81]), 0.0
        for i in range(n):
            us += int(rng.integers(1_000_000, 2_900_000))
            if i % turn == turn - 1:
                tip, head = rng.uniform(0.4, 1.2), rng.uniform(-3, 3)
                g = 9.81 * np.array([math.sin(tip), 0.0, math.cos(tip)])
            ref = 1.5 * math.sin(i / 3) + 0.1 * rng.normal()
            a = g + ref * np.array([math.cos(head), math.sin(head), 0.0]) + 0.1 * rng.normal(size=3)
            if i % 9 == 0:
                x = g + 0.05 * rng.normal(size=3) if i % 45 else 2 * g
                rows.append((node, us, i, 0, *map(float, x), 0.0))
            if i % 9 or i % 2:
                rows.append((node, us, i, 1, *map(float, a), float(ref)))
    cfg = {"min_windows": 3, "min_corr": 0.4, "tolerance": 20.0, "min_samples": 3, "max_samples": 6, "trigger": 0.3, "end": 0.05}
    d = spark.createDataFrame(rows, "vehicle_id int, us long, event_id long, kind int, x double, y double, z double, ref double").repartition(6)
    got = sorted((r.vehicle_id, r.from_us, r.tilt_resets, r.stage, round(r.yaw_deg or 0, 5), tuple(round(x, 6) for x in r.tilt)) for r in mo.calibrate(d, segment_s=100, **cfg).collect())
    want = []
    for node in (1, 2, 3):
        m, reset = mo.StageMachine(**cfg), None
        for _, us, tie, kind, x, y, z, ref in sorted((r for r in rows if r[0] == node), key=lambda r: r[1:4]):
            if kind == 0:
                changed = m.gravity(np.array([x, y, z]))
                reset = (us, tie) if changed else reset
            else:
                changed = (us, tie) != reset and m.sample(np.array([x, y, z]), ref)
            if changed:
                want.append((node, us, m.resets, m.stage, round(m.yaw or 0, 5), tuple(round(v, 6) for v in m.tilt.ravel().tolist())))
    assert got == sorted(want) and sum(w[3] == "ready" for w in want) > 5 and max(w[2] for w in want) > 5


HEAD = ("Time,Engine Coolant Temperature [°C],Intake Manifold Absolute Pressure [kPa],Engine RPM [RPM],Vehicle Speed Sensor [km/h],Intake Air Temperature [°C],"
        "Air Flow Rate from Mass Flow Sensor [g/s],Absolute Throttle Position [%],Ambient Air Temperature [°C],Accelerator Pedal Position D [%],Accelerator Pedal Position E [%]")


def test_trip_files(spark, tmp_path):
    body = lambda clocks: "".join(f"{c},80,100,{900 + i},10,20,3,83.5,15,14,14\n" for i, c in enumerate(clocks))
    (tmp_path / "2018-03-21_Car_A_B_Normal.csv").write_text(HEAD + "\n" + body(["23:59:59.900", "00:00:00.100", "23:59:00.000", "00:00:01.000"]), encoding="utf-8")
    (tmp_path / "2017-07-05_Car_Stau.csv").write_bytes((HEAD.replace(",", ", ") + "\n").encode("utf-8").decode("latin-1").encode("utf-8") + body(["10:00:00.000"]).encode())
    rows = sorted(fs.load_trips(spark, str(tmp_path)).collect(), key=lambda r: (r.trip_id, r.rpm))
    assert [(r.trip_id, r.condition, r.timestamp.strftime("%m-%d %H:%M:%S.%f")[:-3]) for r in rows] == [
        (0, "traffic_jam", "07-05 10:00:00.000"), (1, "normal", "03-21 23:59:59.900"), (1, "normal", "03-22 00:00:00.100"), (1, "normal", "03-22 23:59:00.000"), (1, "normal", "03-23 00:00:01.000")]
    (tmp_path / "2019-01-01_x_Frei.csv").write_text(HEAD.replace("RPM]", "rpm]") + "\n" + body(["10:00:00.000"]), encoding="utf-8")
    with pytest.raises(ValueError, match="Engine RPM"):
        fs.load_trips(spark, str(tmp_path))


def test_trip_columns_go_by_name(spark, tmp_path):
    """Files of another column order, with a column more, next to an ordinary one; an unknown header fails."""
    names = HEAD.split(",")
    turned = [names[0], *names[:0:-1], "Extra"]
    values = dict(zip(names, ["10:00:00.000", "80", "100", "900", "10", "20", "3", "83.5", "15", "14", "13"], strict=True))
    (tmp_path / "2018-03-21_Car_Normal.csv").write_text(HEAD + "\n" + ",".join(values[n] for n in names) + "\n", encoding="utf-8")
    (tmp_path / "2018-03-22_Car_Normal.csv").write_text(",".join(turned) + "\n" + ",".join(values.get(n, "x") for n in turned) + "\n", encoding="utf-8")
    a, b = (r.asDict() for r in fs.load_trips(spark, str(tmp_path)).orderBy("trip_id").collect())
    same = [c for c in a if c not in ("trip_id", "timestamp", "source_file")]
    assert {c: a[c] for c in same} == {c: b[c] for c in same} and (a["rpm"], a["coolant_temp_c"], a["pedal_e_pct"]) == (900.0, 80.0, 13.0)
    (tmp_path / "2018-03-23_Car_Normal.csv").write_text(HEAD.replace("Time", "Zeit") + "\n", encoding="utf-8")
    with pytest.raises(ValueError, match="Time"):
        fs.load_trips(spark, str(tmp_path))


def test_weekly_columns_go_by_name(spark, tmp_path):
    cols = ["VehId", "Trip", "DayNum", "Timestamp(ms)", "Vehicle Speed[km/h]", "Engine RPM[RPM]", "Absolute Load[%]"]
    row = dict(zip(cols, "1,2,3.5,400,50,1500,20".split(","), strict=True))
    for i, order in enumerate((cols, [*cols[::-1], "More"])):
        (tmp_path / f"{i}_week.csv").write_text(",".join(order) + "\n" + ",".join(row.get(c, "9") for c in order) + "\n", encoding="utf-8")
    got = {tuple(r) for r in fs.load_weekly(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 3.5, 400.0, 50.0, 1500.0, 20.0)}
    (tmp_path / "3_week.csv").write_text(",".join(c for c in cols if "RPM" not in c) + "\n", encoding="utf-8")
    with pytest.raises(ValueError, match="RPM"):
        fs.load_weekly(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        fs.load_weekly(spark, str(tmp_path), "nothing*")


def test_damaged_text_beside_other_letters(spark):
    rows = [("Â° 東", "° 東"), ("Ã¼ Â°", "ü °"), ("é Â°", "é °"), ("plain é", "plain é"), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select(cl.fix_double_encoding("a"), "b").collect()
    assert all(r[0] == r[1] for r in got)


def test_names_and_keys(spark):
    bad = spark.createDataFrame([("trip_Normal.csv",)], "f string")
    with pytest.raises(Exception, match="no date in file name"):
        cl.parse_trip_name(bad, "f").collect()
    a = spark.createDataFrame([(1, "ICE"), (2, "HEV")], "VehId long, `Vehicle Type` string")
    b = spark.createDataFrame([(2, "EV")], "VehId long, EngineType string")
    with pytest.raises(ValueError, match="duplicate"):
        fs.load_static((a, "Vehicle Type"), (b, "EngineType"))
    with pytest.raises(LookupError):
        fs.load_vehicle(a, 9, "VehId")


def test_streams_lose_no_row_to_the_number_of_files(spark, monkeypatch):
    """A slice of the input is one trigger, also where it is written in more files than were asked for."""
    frame_type = type(spark.range(1))
    deal = frame_type.repartition
    monkeypatch.setattr(frame_type, "repartition", lambda d, n, *by: deal(d, n if by else n + 4, *by))
    bad = [r for n in ("score_stream", "late_metrics") if "ok" not in (r := compare(spark, n, *streams.QUERIES[n], "/root/testdata/sf0.001"))]
    assert not bad, bad


def test_stream_state_is_handed_pieces_not_rows(spark):
    """Rows go to the processor in few pieces; none is lost, whatever is null."""
    rows = [(None if i % 7 == 0 else str(i % 3), "obd" if i % 2 else "imu", i * 1000, i, *[None if i % 5 == 0 else float(i)] * len(PIDS + ACCELS)) for i in range(20_000)]
    frame_ = pd.DataFrame(rows, columns=["node_id", "kind", "us", "rid", *PIDS, *ACCELS])
    batches = pa.Table.from_pandas(frame_, preserve_index=False).to_batches(2000)
    pieces = pa.Table.from_batches(list(pairing._pack("node_id", 8_000_000)(iter(batches)))).to_pandas()
    assert len(pieces) < 50
    got = []
    for key, kind, packed in pieces.itertuples(index=False):
        r = slots.Rows.packed(pairing._COLUMNS[kind], packed)
        assert len(set(r.us // 8_000_000)) == 1
        got += [(key, kind, int(us), int(rid), *[None if x != x else x for x in v]) for us, rid, v in zip(r.us, r.words[:, 1], r.values.tolist(), strict=True)]
    want = [(*r[:4], *r[4 : 4 + len(pairing._COLUMNS[r[1]])]) for r in rows]
    assert sorted(got, key=lambda r: r[3]) == want
