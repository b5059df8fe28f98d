"""Two-level windows, exact percentiles, interval joins and chunked folds on skewed data."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake.plans import intervals as iv
from roadlake.plans import segmented as sg
from roadlake.plans.chunkfold import chunked_fold
from roadlake.plans.selection import percentiles

UTC = dt.timezone.utc


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds more than half of the rows, with long silences and tied times."""
    rng = random.Random(5)
    rows, i = [], 0
    for key, n in ((0, 900), (1, 300), (2, 40), (3, 1)):
        t = 1_704_067_200_000_000
        for _ in range(n):
            t += rng.choice([0, 100_000, 700_000, 5_000_000, 90_000_000] if rng.random() < 0.2 else [200_000])
            rows.append((key, i, t, rng.choice([True, True, True, False, None]), rng.choice([None, 1.0, 2.0, 2.0, 2.0])))
            i += 1
    df = spark.createDataFrame(rows, "k int, event_id long, us long, st boolean, v double")
    return sg.with_segment(df.withColumn("time", F.timestamp_micros("us")), "time", 10).cache()


def win():
    return Window.partitionBy("k").orderBy("time", "event_id")


ORDER = ["time", "event_id"]


def same(a, b, *cols):
    pick = lambda d: sorted(tuple(r) for r in d.select("event_id", *cols).collect())
    assert pick(a) == pick(b)


def test_lag_matches_plain_window(skewed):
    got = sg.lag_rows(skewed, ["k"], ORDER, {"p": F.col("v"), "q": F.col("us")})
    same(got, skewed.select("event_id", F.lag("v").over(win()).alias("p"), F.lag("us").over(win()).alias("q")), "p", "q")
    same(sg.lag_time(skewed, ["k"], "time", "event_id", "q"), skewed.select("event_id", F.lag("us").over(win()).alias("q")), "q")


def test_crowded_spans_are_cut(skewed):
    plain = skewed.drop(sg.SEG)
    d = sg.with_segment(plain, "time", sg.Adaptive(300, target=60), ["k"])
    biggest = lambda x: x.groupBy("k", sg.SEG).count().agg(F.max("count")).first()[0]
    assert biggest(d) < biggest(sg.with_segment(plain, "time", 300)) / 2
    same(sg.lag_rows(d, ["k"], ORDER, {"p": F.col("v")}), skewed.select("event_id", F.lag("v").over(win()).alias("p")), "p")
    calm = sg.with_segment(plain, "time", sg.Adaptive(300, target=10_000), ["k"])
    same(sg.lag_time(calm, ["k"], "time", "event_id", "q"), skewed.select("event_id", F.lag("us").over(win()).alias("q")), "q")


def test_running_sum_and_index_match(skewed):
    got = sg.running_sum(skewed, ["k"], ORDER, {"s": F.col("v")})
    want = skewed.select("event_id", F.coalesce(F.sum("v").over(win().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias("s"))
    same(got, want, "s")
    got = sg.row_index(skewed, ["k"], ORDER, "i", total="n")
    want = skewed.select("event_id", (F.row_number().over(win()) - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy("k")).alias("n"))
    same(got, want, "i", "n")


def test_runs_match(skewed):
    got = sg.runs(skewed, ["k"], ORDER, F.col("st"))
    d = skewed.withColumn("c", (F.row_number().over(win()) == 1) | ~F.col("st").eqNullSafe(F.lag("st").over(win())))
    d = d.withColumn("run_id", F.sum(F.col("c").cast("long")).over(win().rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("run_pos", (F.row_number().over(Window.partitionBy("k", "run_id").orderBy("time", "event_id")) - 1).cast("long"))
    same(got, d, "run_id", "run_pos")


def test_runs_longer_than_segments(spark):
    rows = [(0, i, 1_704_067_200_000_000 + i * 1_000_000, i < 95 or i > 130) for i in range(200)]
    df = sg.with_segment(spark.createDataFrame(rows, "k int, event_id long, us long, st boolean").withColumn("time", F.timestamp_micros("us")), "time", 7)
    got = {r.event_id: (r.run_id, r.run_pos) for r in sg.runs(df, ["k"], ORDER, F.col("st")).collect()}
    assert got[94] == (1, 94) and got[95] == (2, 0) and got[130] == (2, 35) and got[131] == (3, 0) and got[199] == (3, 68)


def test_suggested_segment_is_bounded(skewed):
    s = sg.suggest_seconds(skewed, ["k"], "time", 3600, target=50)
    assert s < 3600


def test_value_segments_keep_order(spark):
    vals = sorted([-1e9, -3.5, -3.4999, -1e-12, 0.0, 1e-300, 0.1, 0.2, 1.0, 2.0, 2.0000001, 7e8, 1e300])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").select("v", sg.value_segment("v").alias("b"))
    bins = [r.b for r in df.orderBy("v").collect()]
    assert bins == sorted(bins)


def test_percentiles_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    data = {0: np.concatenate([np.zeros(700), rng.normal(0, 5, 500)]), 1: rng.integers(-3, 4, 77).astype(float), 2: np.array([4.25])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [(0, None), (3, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    ps = [0.0, 0.02, 0.25, 0.5, 0.905, 1.0]
    for r in percentiles(df, "v", ps, ["g"]).collect():
        assert r.value == pytest.approx(np.percentile(data[r.g], r.p * 100), abs=1e-12)
    whole = {r.p: r.value for r in percentiles(df, "v", ps).collect()}
    allv = np.concatenate(list(data.values()))
    assert whole == pytest.approx({p: np.percentile(allv, p * 100) for p in ps})


@pytest.mark.parametrize("limit", [0, 200_000])
def test_interval_join_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(iv, "BROADCAST_SLOTS", limit)
    rng = random.Random(1)
    t0 = dt.datetime(2024, 1, 1, tzinfo=UTC)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    ses = [(f"s{i}", a, a + rng.choice([0, 1, 30, 4000])) for i, a in enumerate(rng.choices(range(5000), k=60))] + [("open", 4000, None), ("back", 50, 20)]
    tel = [(i, rng.choice([10.0, rng.uniform(0, 6000), float(rng.randrange(5000))])) for i in range(400)]
    s = spark.createDataFrame([(n, at(a), None if b is None else at(b)) for n, a, b in ses], "session_id string, started_at timestamp, ended_at timestamp")
    t = spark.createDataFrame([(i, at(x)) for i, x in tel], "event_id long, time timestamp")
    now = at(5500)
    us = lambda x: round(x * 1e6)
    want = {(n, i) for n, a, b in ses for i, x in tel if us(a) <= us(x) <= us(5500 if b is None else b)}
    got = iv.session_rows(t, s, now).select("session_id", "event_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    inside = {i for _, i in want}
    assert {r.event_id for r in iv.orphans(t, s, now).collect()} == {i for i, _ in tel} - inside
    counts = {r.session_id: r.row_count for r in iv.list_sessions(t, s, now).collect()}
    assert counts == {n: sum(1 for m, _ in want if m == n) for n, _, _ in ses}
    assert {r.event_id for r in iv.rows_of(t, s, "open", now).collect()} == {i for n, i in want if n == "open"}
    with pytest.raises(LookupError):
        iv.get_session(s, "nobody")


def test_chunked_fold_repairs_wrong_guesses(spark):
    """A counter that never forgets: every warm-up guess is wrong at first."""
    rows = [(k, 1_000_000 * i, i) for k, n in ((0, 60), (1, 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, us long, rid long")
    out = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("rid", T.LongType()), T.StructField("n", T.LongType())])

    def fold(pdf, state, start, end):
        n, before, rows = int(state) if state else 0, None, []
        for us, rid in zip(pdf["us"], pdf["rid"]):
            if us >= end or (us < start and state is not None):
                continue
            if us >= start and before is None:
                before = str(n)
            n += 1
            if us >= start:
                rows.append((rid, n))
        return pd.DataFrame(rows, columns=["rid", "n"]), str(n) if before is None else before, str(n)

    got = chunked_fold(df, ["k"], "us", ["us"], fold, out, segment_s=10, warmup_s=3)
    assert sorted((r.k, r.rid, r.n) for r in got.collect()) == sorted((k, rid, rid + 1) for k, _, rid in rows)


def test_percentiles_of_close_values(spark):
    """Large values that share few bins are cut finer, and stay exact."""
    import numpy as np
    from pyspark.sql import functions as F

    from roadlake.plans.selection import percentiles

    d = spark.range(30_000).select((F.col("id") % 3).alias("g"), (F.lit(1.7e9) + F.pmod(F.xxhash64("id"), F.lit(20_011)) / 7).alias("x"))
    ps = [0.0, 0.01, 0.5, 0.77, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in percentiles(d, "x", ps, ["g"], crowded=100).collect()}
    for g in range(3):
        x = [r["x"] for r in d.where(f"g = {g}").collect()]
        assert all(abs(got[g, p] - v) < 1e-6 for p, v in zip(ps, np.quantile(x, ps), strict=True))


def test_counts_in_intervals_match_a_full_search(spark):
    """Edges on rows and between them, in one minute and days apart, ends before starts, missing ends, repeated names; by key."""
    rng = random.Random(5)
    base = dt.datetime(2025, 6, 1)
    at = lambda: base + dt.timedelta(seconds=rng.choice([rng.randrange(200), rng.randrange(90_000), 60 * rng.randrange(1500)]), microseconds=rng.choice([0, 0, 500_000]))
    rows = [(rng.choice(["a", "b", None]), at()) for _ in range(1500)]
    ivs = [(i % 70, rng.choice(["a", "b", "c", None]), at(), at() if i % 11 else None) for i in range(90)]
    t = spark.createDataFrame(rows, "node string, time timestamp").repartition(5)
    s = spark.createDataFrame(ivs, "name int, node string, lo timestamp, hi timestamp")
    for by in ([], ["node"]):
        want = {}
        for name, node, lo, hi in ivs:
            if hi is not None and hi >= lo:
                want[name] = want.get(name, 0) + sum(lo <= x <= hi for n, x in rows if not by or (n is not None and n == node))
        got = {r["name"]: r["n"] for r in iv.count_in_intervals(t, s, "name", "lo", "hi", by).collect()}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert iv.count_in_intervals(t.limit(0), s, "name", "lo", "hi").where("n <> 0").collect() == []
    assert iv.count_in_intervals(t, s.limit(0), "name", "lo", "hi").collect() == []


def test_pairing_links_match_a_full_search():
    import numpy as np

    from roadlake.operators.merge import match_nearest

    rng = np.random.default_rng(8)
    for n, span in ((40, 30), (200, 60), (300, 5000)):
        obd, imu = (np.sort(rng.integers(0, span, n)) for _ in range(2))
        used = rng.random(n) < 0.2
        want, mine = [], used.copy()
        for t in obd:
            near = [(abs(u - t), u, j) for j, u in enumerate(imu) if not mine[j] and abs(u - t) <= 7]
            want.append(min(near)[2] if near else -1)
            if near:
                mine[min(near)[2]] = True
        got = match_nearest(obd, imu, used, 7)
        assert got.tolist() == want and (used == mine).all()


def test_parked_log_settles_in_two_rounds(spark, monkeypatch):
    """A log of many parked segments: a guess is right although the last change is long ago."""
    from pyspark.sql import functions as F

    from roadlake.operators import mount as mo
    from roadlake.plans import chunkfold

    written = []
    monkeypatch.setattr(chunkfold, "materialize", lambda df, label, real=chunkfold.materialize: written.append(label) or real(df, label))
    speed = F.when(F.col("id") < 8, F.col("id") * 3).when(F.col("id") > 2990, F.col("id") % 7).otherwise(21).cast("double")
    d = spark.range(3000).select(F.lit(1).alias("vehicle_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 1 + 1_700_000_000).alias("time"), speed.alias("speed_kmh"))
    got = mo.fresh_samples(d, segment_s=30, warmup_s=10).collect()
    at, last, first = 1_700_000_000, 0.0, None
    for r in sorted(got, key=lambda r: r["event_id"]):
        us, opened = 1_700_000_000 + r["event_id"], at
        mark = None
        if r["speed_kmh"] != last and us - at >= 1:
            mark = "fresh" if us - at < 3 else "anchor"
            at, last = us, r["speed_kmh"]
        assert (r["mark"], r["interval_us"]) == (mark, opened * 1_000_000), r
    assert len(got) == 3000 and written.count("fold") <= 2


def test_trail_of_a_dense_key_in_short_segments(spark):
    """No long gap anywhere: the chain of segments still ends on the points that one walk keeps."""
    from pyspark.sql import functions as F

    from roadlake.operators import features as ft

    base = 1_700_000_000_000_000
    step = F.pmod(F.xxhash64("id"), F.lit(9_000)) + F.col("id") * 11_000
    d = spark.range(3000).select((F.col("id") % 2).alias("vehicle_id"), F.col("id").alias("event_id"), F.timestamp_micros(F.lit(base) + step).alias("time"), F.lit(1.0).alias("accel_x"), F.lit(2.0).alias("accel_y"))
    got = {(r["vehicle_id"], r["event_id"]) for r in ft.trail(d, ["vehicle_id"], 7, 80, segment_s=1).collect()}
    want = set()
    for v in (0, 1):
        rows = sorted((r["us"], r["event_id"]) for r in d.where(f"vehicle_id = {v}").select(F.unix_micros("time").alias("us"), "event_id").collect())
        kept = []
        for us, e in rows:
            if not kept or us - kept[-1][0] >= 80_000:
                kept.append((us, e))
        want |= {(v, e) for _, e in kept[-7:]}
    assert got == want


def test_chunked_fold_keeps_states_off_the_rows(spark):
    """A state is as long as it likes: in a repair round it comes once for a segment, not with each of its rows."""
    df = spark.createDataFrame([(1, i * 1_000_000) for i in range(40)], "k int, us long")
    out = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("us", T.LongType()), T.StructField("total", T.LongType())])

    def fold(pdf, state, start, end):
        assert "_state" not in pdf.columns
        own = pdf[(pdf["us"] >= start) & (pdf["us"] < end)]
        before = len(state) if state is not None else 0
        rows = own[["us"]].assign(total=before + np.arange(1, len(own) + 1))
        return rows, "x" * before, "x" * (before + len(own))

    got = chunked_fold(df, ["k"], "us", ["us"], fold, out, segment_s=10, warmup_s=3)
    assert sorted((r.us // 1_000_000, r.total) for r in got.collect()) == [(i, i + 1) for i in range(40)]
