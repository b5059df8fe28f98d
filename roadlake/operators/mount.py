"""Sensor-mount calibration over logged samples.

Spark reduces the log first: fresh speed changes (one per second at most) with
the mean acceleration of their interval, and gravity means of 20 standing
samples.  Only those reduced events reach the stage machine, which streams each
node's events in time order and puts out validity intervals; the correction of
every raw sample is a range join and column arithmetic again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake.functions import rotation as ro
from roadlake.operators import quality as q
from roadlake.operators.cleaning import sized
from roadlake.plans import segmented as sg
from roadlake.plans.chunkfold import chunked_fold, fitting
from roadlake.session import materialize

STATIONARY_KMH = 1.0
MIN_REF_S, MAX_REF_S = 1.0, 3.0
# Gravity, how far a parked reading may be from it, and what counts as no covariance.
STANDARD_G, G_TOLERANCE, NO_SIGNAL = 9.81, 1.5, 1e-9
N_STATIONARY = 20
MIN_CORR, MIN_GAP = 0.5, 0.15
NODE = ("vehicle_id",)


def speed_accel(df: DataFrame, keys: Sequence[str] = NODE, time: str = "time", tie: str = "event_id", segment_s: float | sg.Adaptive = q.SPAN) -> DataFrame:
    """C4: backward-difference acceleration from speed; 0 for the first sample."""
    d = sg.lag_rows(sg.with_segment(df, time, segment_s, keys), keys, [time, tie], {"_pv": F.col("speed_kmh"), "_pt": F.unix_micros(time)})
    dt = (F.unix_micros(time) - F.col("_pt")) / 1e6
    acc = F.when(dt > 1e-3, (F.col("speed_kmh") - F.col("_pv")) / 3.6 / dt).otherwise(0.0)
    return d.select(*df.columns, acc.alias("ref_accel"))


def _chain(nxt: np.ndarray, first: int, n: int) -> np.ndarray:
    """The places reached from ``first`` by following next-pointers, up to the end ``n``."""
    out, links = [], nxt.tolist()
    while first < n:
        out.append(first)
        first = links[first]
    return np.array(out, dtype=np.int64)


def speed_marks(df: DataFrame, keys: Sequence[str] = NODE, time: str = "time", tie: str = "event_id", segment_s: float = 600, warmup_s: float = 30, fits: bool = False) -> DataFrame:
    """The accepted speed changes alone: (keys, us, tie, ``mark``, ``ref_accel``).

    The change accepted after another is the first row at least a second later
    with another speed, which depends on that other one only.  So every row of a
    segment gets a pointer to its successor, by one search for all, and the
    walk steps from change to change.
    """
    keys = list(keys)
    src = df.select(*keys, F.unix_micros(time).alias("us"), F.col(tie).alias("rid"), F.col("speed_kmh").cast("double").alias("v"))
    fields = [T.StructField("rid", T.LongType()), T.StructField("us", T.LongType()), T.StructField("mark", T.StringType()), T.StructField("ref_accel", T.DoubleType())]
    out = T.StructType([src.schema[k] for k in keys] + fields)
    least, longest = int(MIN_REF_S * 1e6), int(MAX_REF_S * 1e6)

    def carry(state: str, start: int) -> str:
        """A change so long ago that any other is a plateau's end has no exact time."""
        at, speed = state.split("|")
        return f"{max(int(at), start - longest)}|{speed}"

    def fold(pdf: pd.DataFrame, state: str | None, start: int, end: int):
        all_us = pdf["us"].to_numpy(dtype=np.int64)
        rows = pdf[pdf["v"].notna() & (pdf["us"] < end)]
        us, v, rid = rows["us"].to_numpy(dtype=np.int64), rows["v"].to_numpy(dtype=float), rows["rid"].to_numpy()
        n = len(us)
        turns = np.append(np.flatnonzero(v[1:] != v[:-1]) + 1, n)
        run_end = np.append(turns[np.searchsorted(turns, np.arange(n), side="right")] if n else [], n).astype(np.int64)  # the first row of another speed

        def successor(at: np.ndarray, speed: np.ndarray, low: int = 0) -> np.ndarray:
            p = np.maximum(np.searchsorted(us, at + least), low)
            same = np.append(v, np.nan)[p] == speed
            return np.where(same, run_end[p], p)

        if state is None:
            at, speed, low = (int(all_us[0]) if len(all_us) else start), 0.0, 0
        else:
            at, speed, low = int(state.split("|")[0]), float(state.split("|")[1]), int(np.searchsorted(us, start))
        path = _chain(successor(us, v), int(successor(np.array([at]), np.array([speed]), low)[0]), n)
        at_all, speed_all = np.append(at, us[path]), np.append(speed, v[path])
        own = int(np.searchsorted(us[path], start))  # changes before the segment's start only lead to its state
        dt = (at_all[1:] - at_all[:-1]) / 1e6
        is_fresh = dt < MAX_REF_S
        ref = np.where(is_fresh, (speed_all[1:] - speed_all[:-1]) / 3.6 / np.where(dt > 0, dt, 1), np.nan)
        marks = pd.DataFrame({"rid": rid[path], "us": us[path], "mark": np.where(is_fresh, "fresh", "anchor"), "ref_accel": ref}).iloc[own:]
        marks = marks.astype({"ref_accel": object}).where(marks.notna(), None)
        return marks, carry(f"{at_all[own]}|{speed_all[own]}", start), f"{at_all[-1]}|{speed_all[-1]}"

    marks = chunked_fold(src, keys, "us", ["us", "rid"], fold, out, segment_s, warmup_s, carry=carry, fits=fits)
    return marks.select(*keys, "us", F.col("rid").alias(tie), "mark", "ref_accel")


def fresh_samples(df: DataFrame, keys: Sequence[str] = NODE, time: str = "time", tie: str = "event_id", segment_s: float = 600, warmup_s: float = 30) -> DataFrame:
    """Every row with ``mark``: 'fresh' (an accepted speed change, with
    ``ref_accel``), 'anchor' (a change after a plateau, only re-anchors) or null;
    ``interval_us`` is the time of the mark that opened the row's interval.

    The marks, at most one per second and node, run among the log's rows in
    their order, each right before its row; a row reads the last one before it. Nothing is joined to the log.
    """
    keys = list(keys)
    seconds = max(fitting(df, keys, time, segment_s), 2 * warmup_s, 1)
    marks = speed_marks(df, keys, time, tie, seconds, warmup_s, fits=True)
    among = marks.select(*keys, F.timestamp_micros("us").alias(time), tie, F.col("mark").alias("_mark"), F.col("ref_accel").alias("_ref"))
    d = df.withColumns({"_mark": F.lit(None).cast("string"), "_ref": F.lit(None).cast("double")}).unionByName(among, allowMissingColumns=True)
    d = sg.with_segment(d.withColumn("_own", F.col("_mark").isNull()), time, seconds)
    us, order = F.unix_micros(time), [time, tie, "_own"]
    d = sg.maxima_before(d, keys, order, {"_open": F.when(~F.col("_own"), us), "_first": -us})
    # a mark and its row are neighbours: what opened the mark's interval opened the row's
    before = sg.next_to(keys, order)
    mine = F.coalesce(~F.lag("_own").over(before), F.lit(False))
    d = d.withColumns({"_mine": mine, "mark": F.when(mine, F.lag("_mark").over(before)), "ref_accel": F.when(mine, F.lag("_ref").over(before)),
                       "_open": F.when(mine, F.lag("_open").over(before)).otherwise(F.col("_open"))}).where("_own")
    return d.select(*df.columns, "mark", "ref_accel", F.coalesce("_open", -F.col("_first"), us).alias("interval_us"))


def interval_means(fresh: DataFrame, keys: Sequence[str] = NODE) -> DataFrame:
    """On a fresh row ``ax/ay/az`` become their mean over the interval since
    the last fresh or anchor row; other rows keep their own values."""
    axes = ["ax", "ay", "az"]
    fresh = materialize(fresh, "marked-log")
    is_fresh = F.coalesce(F.col("mark") == "fresh", F.lit(False))
    m = fresh.groupBy(*keys, "interval_us").agg(*[F.avg(c).alias(f"_m_{c}") for c in axes], F.max("mark").alias("_end")).where(F.col("_end") == "fresh")
    means = fresh.where(is_fresh).join(m, [*keys, "interval_us"])  # at most one row per second on either side
    return fresh.where(~is_fresh).unionByName(means.select(*[F.col(f"_m_{c}").alias(c) if c in axes else F.col(c) for c in fresh.columns]))


def gravity_blocks(df: DataFrame, keys: Sequence[str] = NODE, time: str = "time", tie: str = "event_id", n: int = N_STATIONARY, segment_s: float | sg.Adaptive = q.SPAN) -> DataFrame:
    """Mean gravity of every full block of ``n`` consecutive standing samples."""
    standing = F.coalesce(F.col("speed_kmh") < STATIONARY_KMH, F.lit(False))
    slim = df.select(*keys, time, tie, "ax", "ay", "az", standing.alias("_st"))
    d = q.run_position(slim, keys, F.col("_st"), time, tie, segment_s).where("state")
    d = d.groupBy(*keys, "run_id", F.floor(F.col("run_pos") / n).alias("block")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct(time, tie)).alias("_e"), F.avg("ax").alias("gx"), F.avg("ay").alias("gy"), F.avg("az").alias("gz"))
    return d.where(F.col("_n") == n).select(*keys, F.col(f"_e.{time}").alias(time), F.col(f"_e.{tie}").alias(tie), "gx", "gy", "gz")


def event_windows(fresh: DataFrame, keys: Sequence[str] = NODE, time: str = "time", tie: str = "event_id", trigger: float = 0.15, end: float = 0.05,
                  min_samples: int = 6, max_samples: int = 8, segment_s: float = 3600, warmup_s: float = 120) -> DataFrame:
    """Fresh samples with the ``window_id`` (start in microseconds) of the
    completed event window they lie in.  A window opens at ``trigger``, closes
    below ``end`` or when full, and counts from ``min_samples`` on."""
    keys = list(keys)
    fresh = materialize(fresh, "fresh")  # at most one row per second and node
    src = fresh.select(*keys, F.unix_micros(time).alias("us"), F.col(tie).alias("rid"), "ref_accel")
    fields = [T.StructField("rid", T.LongType()), T.StructField("window_id", T.LongType()), T.StructField("closes", T.BooleanType())]
    out = T.StructType([src.schema[k] for k in keys] + fields)

    most = max(max_samples, 2)  # a window is open for one more sample at least

    def fold(pdf: pd.DataFrame, state: str | None, start: int, stop: int):
        rows = pdf[(pdf["us"] < stop) & (pdf["us"] >= (start if state is not None else -(2**62)))]
        us, ref, rid = rows["us"].to_numpy(dtype=np.int64), np.abs(rows["ref_accel"].to_numpy(dtype=float)), rows["rid"].to_numpy()
        n, place = len(us), np.arange(len(us))
        hot, calm = np.append(np.flatnonzero(ref >= trigger), n), np.append(np.flatnonzero(ref < end), n)
        next_hot = lambda i: hot[np.searchsorted(hot, i)]
        close = np.minimum(place + most - 1, calm[np.searchsorted(calm, place + 1)])  # of a window that opens here; n or more: not here
        opened, count = (int(state.split("|")[0]), int(state.split("|")[1])) if state else (None, 0)
        begins, ends, names = [], [], []
        if opened is not None:  # what is left of a window from before
            last = min(max(most - count - 1, 0), int(calm[0])) if n else 0
            begins, ends, names = [0], [last], [opened]
        at = int(next_hot(min(ends[0] + 1, n))) if begins else int(next_hot(0))
        chain = _chain(next_hot(np.minimum(close + 1, n)), at, n)
        begins, ends, names = np.append(begins, chain).astype(np.int64), np.append(ends, close[chain]).astype(np.int64), np.append(names, us[chain]).astype(np.int64)

        def tell(upto: int) -> str:
            """The state before the row at a place."""
            w = int(np.searchsorted(begins, upto)) - 1
            if w < 0 or ends[w] < upto:
                return "" if opened is None or w >= 0 or upto > 0 else state
            return f"{names[w]}|{upto - begins[w] + (count if opened is not None and w == 0 else 0)}"

        length = np.minimum(ends, n - 1) - begins + 1
        at = np.repeat(begins, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out_rows = pd.DataFrame({"rid": rid[at], "window_id": np.repeat(names, length), "closes": at == np.repeat(ends, length)})
        own = int(np.searchsorted(us, start))
        return out_rows[at >= own], tell(own) if state is None else state, tell(n)

    d = chunked_fold(src, keys, "us", ["us", "rid"], fold, out, segment_s, warmup_s)
    full = d.groupBy(*keys, "window_id").agg(F.count(F.lit(1)).alias("_n"), F.max("closes").alias("_c")).where(F.col("_c") & (F.col("_n") >= min_samples))
    d = d.join(full.select(*keys, "window_id"), [*keys, "window_id"], "left_semi")
    return fresh.join(d.select(*keys, F.col("rid").alias(tie), "window_id"), [*keys, tie])


def _corr(a: str, b: str) -> Column:
    return F.when(F.var_pop(a) * F.var_pop(b) > 1e-12 / (F.count(F.lit(1)) ** 2), F.corr(a, b)).otherwise(0.0)


def window_stats(windows: DataFrame, keys: Sequence[str] = NODE) -> DataFrame:
    """C8, C10, C11 of each window: centred sums, axis choice, heading."""
    n = F.count(F.lit(1))
    s = windows.groupBy(*keys, "window_id").agg(
        n.alias("n"), _corr("ax", "ref_accel").alias("corr_x"), _corr("ay", "ref_accel").alias("corr_y"),
        *[(f * n).alias(a) for a, f in (
            ("cov_xr", F.covar_pop("ax", "ref_accel")), ("cov_yr", F.covar_pop("ay", "ref_accel")), ("sxx", F.var_pop("ax")),
            ("syy", F.var_pop("ay")), ("sxy", F.covar_pop("ax", "ay")), ("srr", F.var_pop("ref_accel")))])
    ax, ay = F.abs("corr_x"), F.abs("corr_y")
    sure = (F.greatest(ax, ay) >= MIN_CORR) & (F.abs(ax - ay) >= MIN_GAP)
    sign = lambda c: F.when(F.col(c) >= 0, 1).otherwise(-1)
    s = s.withColumn("axis", F.when(~sure, "undetermined").when(ax > ay, "x").otherwise("y"))
    s = s.withColumn("forward_sign", F.when(F.col("axis") == "x", sign("corr_x")).when(F.col("axis") == "y", sign("corr_y")).otherwise(0))
    return _heading(s, "heading_deg", "projected_corr")


def _heading(d: DataFrame, angle: str, corr: str) -> DataFrame:
    """Angle of the covariance with the reference, and how well it projects."""
    none = (F.abs("cov_xr") < 1e-9) & (F.abs("cov_yr") < 1e-9)
    th = F.atan2("cov_yr", "cov_xr")
    c, s = F.cos(th), F.sin(th)
    num = c * F.col("cov_xr") + s * F.col("cov_yr")
    den = F.sqrt((c * c * F.col("sxx") + c * s * F.col("sxy") * 2 + s * s * F.col("syy")) * F.col("srr"))
    return d.withColumn(angle, F.when(none, F.lit(None)).otherwise(F.degrees(th))).withColumn(corr, F.when(none, F.lit(None)).when(den > 1e-9, num / den).otherwise(0.0))


def axis_lock(stats: DataFrame, keys: Sequence[str] = NODE, need: int = 3) -> DataFrame:
    """Determined windows with their streak of equal choices and ``locked``."""
    d = materialize(stats.where(F.col("axis") != "undetermined"), "windows")
    d = d.withColumn("_t", F.timestamp_micros("window_id"))
    state = F.concat_ws("/", "axis", F.col("forward_sign").cast("string"))
    d = q.run_position(d, keys, state, "_t", "window_id", 86400)
    return d.select(*stats.columns, (F.col("run_pos") + 1).alias("streak"), (F.col("run_pos") + 1 >= need).alias("locked"))


def pooled_heading(stats: DataFrame, keys: Sequence[str] = NODE, min_windows: int = 6, min_corr: float = 0.50, tolerance: float = 10.0, segment_s: float = 86400) -> DataFrame:
    """Heading from all windows so far, and whether it may lock there: enough
    windows, well correlated, and the last three estimates close together."""
    keys = list(keys)
    d = materialize(stats, "windows").select(*keys, "window_id", "cov_xr", "cov_yr", "sxx", "syy", "sxy", "srr").withColumn("_t", F.timestamp_micros("window_id"))
    sums = ["cov_xr", "cov_yr", "sxx", "syy", "sxy", "srr"]
    d = sg.running_sum(sg.with_segment(d, "_t", segment_s), keys, ["window_id"], {**{f"_p_{c}": F.col(c) for c in sums}, "n_windows": F.lit(1)})
    d = _heading(d.select(*keys, "window_id", "_t", "n_windows", *[F.col(f"_p_{c}").alias(c) for c in sums]), "pooled_deg", "pooled_corr")
    # history holds estimates only, so windows before any signal are passed over
    known = sg.with_segment(d.where(F.col("pooled_deg").isNotNull()), "_t", segment_s)
    h = sg.lag_rows(known, keys, ["window_id"], {"_a": F.col("pooled_deg")})
    h = sg.lag_rows(h, keys, ["window_id"], {"_b": F.col("_a")})
    ok = (F.col("n_windows") >= min_windows) & (F.col("pooled_corr") >= min_corr)
    near = (ro.wrapped_diff(F.col("_a"), F.col("pooled_deg")) <= tolerance) & (ro.wrapped_diff(F.col("_b"), F.col("pooled_deg")) <= tolerance)
    return h.select(*keys, "window_id", "n_windows", "pooled_deg", "pooled_corr", (ok & F.coalesce(near, F.lit(False))).alias("lockable"))


def heading_lock(pooled: DataFrame, keys: Sequence[str] = NODE) -> DataFrame:
    """The estimate at which each node locks, one row per node that does."""
    d = pooled.where("lockable")
    return d.groupBy(*keys).agg(*[F.min_by(c, "window_id").alias(c) for c in ("n_windows", "pooled_deg", "pooled_corr")], F.min("window_id").alias("window_id"))


STATE_FIELDS = [("from_us", T.LongType()), ("stage", T.StringType()), ("tilt", T.ArrayType(T.DoubleType())), ("yaw_deg", T.DoubleType()),
                ("tilt_valid", T.BooleanType()), ("yaw_valid", T.BooleanType()), ("tilt_resets", T.IntegerType())]


class StageMachine:
    """C13/C14 for one node and one tick at a time: tilt, then yaw, then ready; a parked
    reading far off vertical starts over.  Fed with gravity means and fresh samples in
    time order, from nothing or from a stored calibration; :func:`calibrate` gives the same for whole logs."""

    def __init__(self, min_windows=6, trigger=0.15, end=0.05, min_samples=6, max_samples=8, stale_deg=15.0, min_corr=0.5, tolerance=10.0,
                 tilt: np.ndarray | None = None, yaw: float | None = None):
        self.cfg = (min_windows, trigger, end, min_samples, max_samples, stale_deg, min_corr, tolerance)
        self.tilt, self.yaw, self.resets = tilt, yaw, 0
        self._relearn()

    def _relearn(self) -> None:
        self.buffer: list[tuple[float, float, float]] = []
        self.pool, self.windows, self.angles = np.zeros(6), 0, []

    @property
    def stage(self) -> str:
        return "needs_tilt" if self.tilt is None else "needs_yaw" if self.yaw is None else "ready"

    def gravity(self, g: np.ndarray) -> bool:
        """A mean of standing samples; true when the calibration changed."""
        if self.tilt is not None:
            size = float(np.linalg.norm(g))
            if abs(size - STANDARD_G) > G_TOLERANCE:
                return False
            off = np.degrees(np.arccos(np.clip((self.tilt @ g)[2] / size, -1, 1)))
            if off <= self.cfg[5]:
                return False
            self.yaw = None
            self.resets += 1
            self._relearn()
        self.tilt = ro.tilt_array(g)
        return True

    def sample(self, a: np.ndarray, ref: float) -> bool:
        """A fresh reference with its mean acceleration; true when yaw locks."""
        if self.stage != "needs_yaw":
            return False
        min_windows, trigger, end, least, most, _, min_corr, tol = self.cfg
        x, y, _ = self.tilt @ a
        if not self.buffer:
            if abs(ref) >= trigger:
                self.buffer = [(x, y, ref)]
            return False
        self.buffer.append((x, y, ref))
        if len(self.buffer) < most and abs(ref) >= end:
            return False
        w, self.buffer = np.array(self.buffer), []
        if len(w) < least:
            return False
        c = w - w.mean(axis=0)
        self.pool += [c[:, 0] @ c[:, 2], c[:, 1] @ c[:, 2], c[:, 0] @ c[:, 0], c[:, 1] @ c[:, 1], c[:, 0] @ c[:, 1], c[:, 2] @ c[:, 2]]
        self.windows += 1
        xr, yr, xx, yy, xy, rr = self.pool
        if abs(xr) < NO_SIGNAL and abs(yr) < NO_SIGNAL:
            return False
        th = np.arctan2(yr, xr)
        co, si = np.cos(th), np.sin(th)
        den = np.sqrt((co * co * xx + 2 * co * si * xy + si * si * yy) * rr)
        corr = (co * xr + si * yr) / den if den > NO_SIGNAL else 0.0
        deg = float(np.degrees(th))
        self.angles = [*self.angles, deg][-3:]
        settled = len(self.angles) == 3 and all(abs((p - deg + 180) % 360 - 180) <= tol for p in self.angles)
        if self.windows >= min_windows and corr >= min_corr and settled:
            self.yaw = deg
            return True
        return False


def calibration_events(log: DataFrame, keys: Sequence[str] = NODE, time: str = "time", tie: str = "event_id", n: int = N_STATIONARY) -> DataFrame:
    """C1 + C5 + C6: the reduced events of each node, in the machine's terms."""
    ticks = materialize(interval_means(fresh_samples(log, keys, time, tie), keys), "ticks")
    g = gravity_blocks(ticks, keys, time, tie, n).select(*keys, time, tie, F.lit(0).alias("kind"), F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"), F.lit(0.0).alias("ref"))
    f = ticks.where(F.col("mark") == "fresh").select(*keys, time, tie, F.lit(1).alias("kind"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"), F.col("ref_accel").alias("ref"))
    return g.unionByName(f).withColumn("us", F.unix_micros(time))


def tilt_changes(gravity: DataFrame, keys: Sequence[str] = NODE, tie: str = "event_id", stale_deg: float = 15.0, segment_s: float = 3600) -> DataFrame:
    """The gravity means that set a node's tilt: its first, and after each the
    next plausible one that points more than ``stale_deg`` away from it.

    Which one comes next depends on the one in force alone, not on the heading
    stage.  Segments start from no tilt and are repaired; quiet ones, the
    rule, hand the tilt in force on (see ``chunkfold``).
    """
    keys = list(keys)
    src = gravity.select(*keys, "us", F.col(tie).alias("rid"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    out = T.StructType([src.schema[k] for k in keys] + [T.StructField(n, T.LongType()) for n in ("us", "rid")] + [T.StructField(c, T.DoubleType()) for c in "xyz"])

    def fold(pdf: pd.DataFrame, state: str | None, start: int, end: int):
        rows = pdf[pdf["us"] < end]
        g, us = rows[["x", "y", "z"]].to_numpy(dtype=float), rows["us"].to_numpy(dtype=np.int64)
        size = np.linalg.norm(g, axis=1)
        plausible = np.abs(size - STANDARD_G) <= G_TOLERANCE
        told = lambda v: json.dumps([float(c) for c in v])
        at, now, changes = -1, json.loads(state) if state else None, []
        while at + 1 < len(us):
            if now is None:
                at += 1
            else:
                up, step = ro.tilt_array(np.array(now))[2], 64
                low = at + 1
                while low < len(us):  # in blocks that grow, so that frequent changes cost no whole scan each
                    off = np.degrees(np.arccos(np.clip(g[low : low + step] @ up / np.maximum(size[low : low + step], NO_SIGNAL), -1, 1)))
                    hits = np.flatnonzero(plausible[low : low + step] & (off > stale_deg))
                    if len(hits):
                        break
                    low, step = low + step, 2 * step
                else:
                    break
                at = low + int(hits[0])
            now = g[at].tolist()
            changes.append(at)
        return rows.iloc[changes][["us", "rid", "x", "y", "z"]], state or "", told(now)

    d = chunked_fold(src, keys, "us", ["us", "rid"], fold, out, segment_s, 0)
    return d.select(*keys, "us", F.col("rid").alias(tie), "x", "y", "z")


def in_epochs(samples: DataFrame, changes: DataFrame, keys: Sequence[str] = NODE, tie: str = "event_id") -> DataFrame:
    """Fresh samples under the tilt in force: levelled, with the ``epoch`` (time and
    tie of the change) they belong to.  Samples before any tilt, and the one of
    the change's own tick, belong to none."""
    keys = list(keys)
    tilt = F.struct("us", F.col(tie).cast("long").alias("tie"), ro.tilt_matrix(F.col("x"), F.col("y"), F.col("z")).alias("m")).alias("_tilt")
    d = samples.select(*keys, "us", tie, "x", "y", "z", "ref", F.lit(1).alias("_kind"))
    d = d.unionByName(changes.select(*keys, "us", tie, tilt, F.lit(0).alias("_kind")), allowMissingColumns=True).withColumn("time", F.timestamp_micros("us"))
    d = sg.max_before(sg.with_segment(d, "time", sg.Adaptive(3600), keys), keys, ["us", tie, "_kind"], F.col("_tilt"), "_now")
    d = d.where((F.col("_kind") == 1) & F.col("_now").isNotNull()).where((F.col("_now.us") != F.col("us")) | (F.col("_now.tie") != F.col(tie)))
    x, y, _ = ro.apply_matrix(F.col("_now.m"), F.col("x"), F.col("y"), F.col("z"))
    return d.select(*keys, F.col("_now.us").alias("epoch"), F.col("_now.tie").alias("epoch_tie"), "time", tie, x.alias("ax"), y.alias("ay"), F.col("ref").alias("ref_accel"))


def calibrate(events: DataFrame, keys: Sequence[str] = NODE, tie: str = "event_id", min_windows: int = 6, trigger: float = 0.15, end: float = 0.05, min_samples: int = 6,
              max_samples: int = 8, stale_deg: float = 15.0, min_corr: float = 0.5, tolerance: float = 10.0, segment_s: float = 3600) -> DataFrame:
    """C14: validity intervals of every node's calibration.

    The tilt never looks at the heading, so the changes of tilt come first (C13).
    Between two of them lies an epoch in which the heading is learned
    from nothing: event windows (C7), their sums (C11), the pooled estimate (C12) up to
    where it locks.  Every step works on segments of a node; the states, a few per
    epoch, are what is left.  :class:`StageMachine` is the same rule for one node, tick by tick.
    """
    keys = list(keys)
    by = [*keys, "epoch", "epoch_tie"]
    gravity = materialize(events.where(F.col("kind") == 0).select(*keys, "us", tie, "x", "y", "z"), "gravity")
    changes = materialize(tilt_changes(gravity, keys, tie, stale_deg, segment_s), "tilt-changes")
    samples = in_epochs(events.where(F.col("kind") == 1), changes, keys, tie)
    windows = materialize(event_windows(samples, by, "time", tie, trigger, end, min_samples, max_samples, segment_s), "windows")
    locks = heading_lock(pooled_heading(window_stats(windows, by), by, min_windows, min_corr, tolerance), by)
    closed = windows.groupBy(*by, "window_id").agg(F.max(F.unix_micros("time")).alias("from_us"))
    locks = locks.join(closed, [*by, "window_id"]).select(*by, "from_us", F.col("pooled_deg").alias("yaw_deg"))

    order = Window.partitionBy(*keys).orderBy("us", tie)  # a handful of changes per node, as of transitions below
    tilts = changes.select(*keys, F.col("us").alias("epoch"), F.col(tie).cast("long").alias("epoch_tie"), ro.tilt_matrix(F.col("x"), F.col("y"), F.col("z")).alias("tilt"),
                           (F.row_number().over(order) - 1).cast("int").alias("tilt_resets"))
    begun = tilts.select(*by, "tilt", "tilt_resets", F.col("epoch").alias("from_us"), F.lit(None).cast("double").alias("yaw_deg"))
    d = begun.unionByName(locks.join(tilts, by).select(*begun.columns)).withColumn("yaw_valid", F.col("yaw_deg").isNotNull())
    d = d.withColumns({"stage": F.when(F.col("yaw_valid"), "ready").otherwise("needs_yaw"), "tilt_valid": F.lit(True)})
    nxt = Window.partitionBy(*keys).orderBy("from_us", "tilt_resets", "yaw_valid")
    return d.select(*keys, *[F.col(n).cast(kind).alias(n) for n, kind in STATE_FIELDS]).withColumn("to_us", F.lead("from_us").over(nxt))


def correct(log: DataFrame, states: DataFrame, keys: Sequence[str] = NODE, time: str = "time") -> DataFrame:
    """C3 + C14: every raw sample as forward, lateral, up with what was known then."""
    keys = list(keys)
    s = sized(states.select(*[F.col(k).alias(f"_{k}") for k in keys], "from_us", "to_us", "tilt", "yaw_deg", "yaw_valid"))
    us = F.unix_micros(time)
    cond = (us >= F.col("from_us")) & (F.col("to_us").isNull() | (us < F.col("to_us")))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    d = log.join(s, cond, "left")
    x, y, z = ro.apply_matrix(F.col("tilt"), F.col("ax"), F.col("ay"), F.col("az"))
    d = d.withColumn("_x", F.coalesce(x, "ax")).withColumn("_y", F.coalesce(y, "ay")).withColumn("up", F.coalesce(z, "az"))
    fw, lat = ro.to_forward(F.col("_x"), F.col("_y"), F.col("yaw_deg"))
    turned = F.coalesce(F.col("yaw_valid"), F.lit(False))
    stage = F.when(F.col("tilt").isNull(), "raw").when(turned, "full").otherwise("tilt")
    return d.select(*log.columns, F.when(turned, fw).otherwise(F.col("_x")).alias("forward"), F.when(turned, lat).otherwise(F.col("_y")).alias("lateral"), "up", stage.alias("corrected"))
