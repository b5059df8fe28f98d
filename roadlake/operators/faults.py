"""Synthetic faults and what detects them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.operators import quality as q
from roadlake.plans import segmented as sg
from roadlake.plans.selection import percentiles
from roadlake.session import materialize

WINDOW_S = 30
STD_MULTIPLES = (0.5, 1.0, 2.0, 3.0, 5.0, 8.0)
REFERENCE_FPR = (0.02, 0.05, 0.10)
# Fault -> (feature it shifts, fixed offset).
CAR_FAULTS = {"coolant_spike": ("coolant_temp_c_dev", 20.0), "rpm_decorrelation": ("rpm_dev", 3000.0)}
POOL_FAULTS = {"load_spike": "engine_load_pct_dev", "rpm_decorrelation": "rpm_dev"}
CAR_FEATURES = ["coolant_temp_c_dev", "rpm_dev", "speed_kmh"]
POOL_FEATURES = ["rpm_dev", "engine_load_pct_dev", "speed_kmh"]
RPM_MAGNITUDES = (1200, 2000, 3000, 4000, 6000, 8000)
CAR_CANDIDATES = (0.5, 1, 2, 5, 10)
POOL_CANDIDATES = (0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 7.0, 10.0)
TEST_SEED = 1337

Scorer = Callable[[DataFrame], DataFrame]


def trip_unit(keys: Sequence[str], seed: int) -> Column:
    """A trip's own random number in [0, 1)."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))


def row_windows(df: DataFrame, keys: Sequence[str] = ("vehicle_id", "trip"), time: str = "time", size: int = WINDOW_S, u: Column | None = None,
                seed: int = 42, segment_s: float = 600) -> DataFrame:
    """M6: ``size`` consecutive rows per trip, away from its first ``size`` and
    last ``2 * size`` rows; trips too short to leave a choice are skipped."""
    keys = list(keys)
    d = sg.row_index(sg.with_segment(df, time, segment_s), keys, [time], "_i", total="_n").where(F.col("_n") > 3 * size)
    start = F.lit(size) + F.floor((u if u is not None else trip_unit(keys, seed)) * (F.col("_n") - 3 * size))
    return d.where((F.col("_i") >= start) & (F.col("_i") < start + size)).select(*df.columns)


def _valid(d: DataFrame, wkeys: list[str], features: Sequence[str]) -> DataFrame:
    """Windows with at least three rows and no missing feature."""
    ok = d.groupBy(*wkeys).agg(F.count(F.lit(1)).alias("_c"), *[F.count(f).alias(f"_c_{f}") for f in features])
    cond = F.col("_c") >= 3
    for f in features:
        cond = cond & (F.col(f"_c_{f}") == F.col("_c"))
    return ok.where(cond).select(*wkeys)


def time_windows(df: DataFrame, features: Sequence[str] = POOL_FEATURES, keys: Sequence[str] = ("vehicle_id", "trip"), time: str = "time",
                 n_trips: int | None = None, u: Column | None = None, order: Column | None = None, seed: int = 42, size_s: int = WINDOW_S) -> DataFrame:
    """M7: one random window of ``size_s`` seconds per trip, from every trip whose
    window is valid; with ``n_trips``, from the first so many in shuffled order."""
    keys, us = list(keys), F.unix_micros(time)
    b = df.groupBy(*keys).agg(F.min(us).alias("_a"), F.max(us).alias("_b"))
    b = b.where(F.col("_b") - F.col("_a") >= size_s * 1_000_000)
    off = F.floor((u if u is not None else trip_unit(keys, seed)) * (F.col("_b") - F.col("_a") - size_s * 1_000_000))
    b = b.select(*keys, (F.col("_a") + off).alias("_w"))
    d = df.join(b, keys).where((us >= F.col("_w")) & (us < F.col("_w") + size_s * 1_000_000)).drop("_w")
    pick = _valid(d, keys, features)
    if n_trips is not None:
        pick = pick.orderBy(order if order is not None else trip_unit(keys, seed + 7), *keys).limit(n_trips)
    return d.join(pick, keys, "left_semi").select(*df.columns)


def dense_windows(df: DataFrame, features: Sequence[str] = POOL_FEATURES, keys: Sequence[str] = ("vehicle_id", "trip"), time: str = "time",
                  max_per_trip: int | None = None, order: Column | None = None, seed: int = 42, size_s: int = WINDOW_S) -> DataFrame:
    """M8: the whole, non-overlapping windows of each trip that are valid; with
    ``max_per_trip``, of so many drawn before their validity is looked at; adds ``chunk``."""
    keys, us, w = list(keys), F.unix_micros(time), size_s * 1_000_000
    b = df.groupBy(*keys).agg(F.min(us).alias("_a"), F.max(us).alias("_b"))
    b = b.select(*keys, "_a", F.floor((F.col("_b") - F.col("_a")) / w).cast("int").alias("_nc")).where("_nc >= 1")
    d = df.join(b, keys).withColumn("chunk", F.floor((us - F.col("_a")) / w).cast("int")).where(F.col("chunk") < F.col("_nc")).drop("_a", "_nc")
    if max_per_trip is not None:
        chunks = b.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)).alias("chunk"))
        o = order if order is not None else F.xxhash64(*[F.col(k) for k in keys], F.col("chunk"), F.lit(seed))
        win = Window.partitionBy(*keys).orderBy(o, "chunk")
        drawn = chunks.withColumn("_r", F.row_number().over(win)).where(F.col("_r") <= max_per_trip).drop("_r")
        d = d.join(drawn, [*keys, "chunk"])
    return d.join(_valid(d, [*keys, "chunk"], features), [*keys, "chunk"], "left_semi").select(*df.columns, "chunk")


def inject(df: DataFrame, faults: dict[str, tuple[str, Column | float]], fault: str = "fault") -> DataFrame:
    """M9: every row once per fault, with one feature shifted and the rest left."""
    d = df.withColumn(fault, F.explode(F.array(*[F.lit(f) for f in faults])))
    for name, (col, mag) in faults.items():
        m = mag if isinstance(mag, Column) else F.lit(float(mag))
        d = d.withColumn(col, F.when(F.col(fault) == name, F.col(col) + m).otherwise(F.col(col)))
    return d


def paired_scores(windows: DataFrame, score: Scorer, faults: dict[str, tuple[str, Column | float]], keep: Sequence[str] = ("vehicle_id", "trip", "time")) -> DataFrame:
    """Each window row before and after every fault."""
    before = score(windows).withColumnRenamed("score", "original_score")
    after = score(inject(before, faults)).withColumnRenamed("score", "injected_score")
    return after.select(*keep, "fault", "original_score", "injected_score", (F.col("injected_score") - F.col("original_score")).alias("delta"),
                        ((F.col("original_score") > 0) & (F.col("injected_score") < 0)).alias("flipped_to_anomalous"))


def paired_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("fault").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("original_score").alias("mean_original"), F.avg("injected_score").alias("mean_injected"),
        F.avg("delta").alias("mean_delta"), (F.avg(F.col("flipped_to_anomalous").cast("double")) * 100).alias("flipped_pct"))


def magnitude_sweep(windows: DataFrame, score: Scorer, threshold: float, magnitudes: Sequence[float] = RPM_MAGNITUDES, col: str = "rpm_dev") -> DataFrame:
    """Absolute shifts of one feature over the same windows, row level."""
    base = score(windows).withColumnRenamed("score", "_o")
    d = base.withColumn("magnitude", F.explode(F.array(*[F.lit(float(m)) for m in magnitudes])))
    d = score(d.withColumn(col, F.col(col) + F.col("magnitude")))
    return d.groupBy("magnitude").agg(F.avg(F.col("score") - F.col("_o")).alias("mean_delta"),
                                      (F.avg((F.col("score") < threshold).cast("double")) * 100).alias("detection_pct_at_threshold"))


def thresholds(scored: DataFrame, pcts: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Score percentiles (in percent) of ordinary rows: target_fpr_pct, threshold."""
    p = percentiles(scored, "score", [x / 100 for x in pcts], by)
    return p.select(*by, F.round(F.col("p") * 100, 6).alias("target_fpr_pct"), F.col("value").alias("threshold"))


def _shares(scores: DataFrame, score: str, limits: list[tuple[float, float]], named: dict[str, Column], scale: float) -> DataFrame:
    """(target_fpr_pct, threshold, one column per name): the share of scores strictly below each
    threshold under each condition, all thresholds in one aggregate over the rows."""
    below = [[F.avg(F.when(cond & F.col(score).isNotNull(), (F.col(score) < F.lit(t)).cast("double"))) * scale for cond in named.values()] for _, t in limits]
    rows = F.array(*[F.struct(F.lit(p).alias("target_fpr_pct"), F.lit(t).alias("threshold"), *[c.alias(n) for n, c in zip(named, b, strict=True)]) for (p, t), b in zip(limits, below, strict=True)])
    return scores.agg(rows.alias("_t")).select(F.inline("_t"))


def _limits(scored: DataFrame, candidates: Sequence[float]) -> list[tuple[float, float]]:
    """The thresholds as numbers: one for each candidate."""
    return sorted((r["target_fpr_pct"], r["threshold"]) for r in thresholds(scored, candidates).collect())


def row_tradeoff(scored: DataFrame, paired: DataFrame, candidates: Sequence[float] = CAR_CANDIDATES, faults: Sequence[str] = tuple(CAR_FAULTS)) -> DataFrame:
    """Threshold candidates with their real false-positive rate and the
    share of fault rows each detects."""
    scored = materialize(scored.select("score"), "scores")  # read three times below
    limits = _limits(scored, candidates)
    det = _shares(paired, "injected_score", limits, {f"{f}_detection_pct": F.col("fault") == f for f in faults}, 100)
    return _shares(scored, "score", limits, {"actual_fpr_pct": F.lit(True)}, 100).join(F.broadcast(det), ["target_fpr_pct", "threshold"])


def choose(table: DataFrame, target: float = 2.0, features: Sequence[str] = CAR_FEATURES) -> DataFrame:
    """K4: the chosen row as a one-row configuration."""
    return table.where(F.col("target_fpr_pct") == target).select(
        "threshold", "target_fpr_pct", "actual_fpr_pct", F.array(*[F.lit(f) for f in features]).alias("feature_cols"),
        F.lit("score < threshold means anomalous; chosen from the validation trade-off table").alias("note"))


def std_faults(train: DataFrame, multiple: float, faults: dict[str, str] | None = None) -> dict[str, tuple[str, float]]:
    """Fault sizes as multiples of each feature's own train deviation."""
    faults = faults or POOL_FAULTS
    std = q.feature_std(train, list(faults.values())).first()
    return {f: (c, multiple * std[f"{c}_std"]) for f, c in faults.items()}


def std_sweep(windows: DataFrame, scored: DataFrame, score: Scorer, train: DataFrame, fault: str, wkeys: Sequence[str] = ("vehicle_id", "trip"),
              multiples: Sequence[float] = STD_MULTIPLES, fprs: Sequence[float] = REFERENCE_FPR) -> DataFrame:
    """Detection of one fault by size, per window (any row below)."""
    col = POOL_FAULTS[fault]
    std = q.feature_std(train, [col]).select(F.col(f"{col}_std").alias("_sd"))
    named = {f"detect_rate_at_{int(round(f * 100))}pct_fpr": f for f in fprs}
    p = percentiles(materialize(scored.select("score"), "scores"), "score", list(fprs))
    lim = p.agg(*[F.max(F.when(F.col("p") == F.lit(float(f)), F.col("value"))).alias(f"_t_{n}") for n, f in named.items()])
    d = windows.crossJoin(F.broadcast(std)).withColumn("std_multiple", F.explode(F.array(*[F.lit(float(m)) for m in multiples])))
    d = d.withColumn("magnitude", F.col("std_multiple") * F.col("_sd")).withColumn(col, F.col(col) + F.col("magnitude"))
    d = score(d).crossJoin(F.broadcast(lim))
    w = d.groupBy(*wkeys, "std_multiple", "magnitude").agg(*[F.max((F.col("score") < F.col(f"_t_{n}")).cast("double")).alias(n) for n in named])
    return w.groupBy("std_multiple", "magnitude").agg(F.count(F.lit(1)).alias("n_windows"), *[F.avg(n).alias(n) for n in named])


def window_tradeoff(windows: DataFrame, scored: DataFrame, score: Scorer, train: DataFrame, multiple: float = 5.0, wkeys: Sequence[str] = ("vehicle_id", "trip"),
                    candidates: Sequence[float] = POOL_CANDIDATES) -> DataFrame:
    """Candidates with real FPR and per-window detection of each fault."""
    faults = std_faults(train, multiple)
    scored = materialize(scored.select("score"), "scores")
    limits = _limits(scored, candidates)
    low = score(inject(windows, faults)).groupBy(*wkeys, "fault").agg(F.min("score").alias("_low"))
    det = _shares(low, "_low", limits, {f"{f}_detect_rate": F.col("fault") == f for f in faults}, 1)
    return _shares(scored, "score", limits, {"actual_val_fpr_pct": F.lit(True)}, 100).join(F.broadcast(det), ["target_fpr_pct", "threshold"])


def sealed_evaluation(test: DataFrame, score: Scorer, threshold: float, windows: DataFrame, faults: dict[str, tuple[str, Column | float]], confirm_sealed: bool = False,
                      wkeys: Sequence[str] | None = None) -> DataFrame:
    """False-positive rate at a fixed threshold and detection per fault,
    per row or, with ``wkeys``, per window; refused without the explicit flag.
    ``windows`` are to be drawn with TEST_SEED, not with the seed of the calibration."""
    if not confirm_sealed:
        raise PermissionError("the test set is sealed: pass confirm_sealed=True for the one evaluation")
    s = score(test).where("score IS NOT NULL")
    fpr = s.agg((F.avg((F.col("score") < threshold).cast("double")) * 100).alias("actual_fpr_pct"))
    hit = score(inject(windows, faults)).withColumn("_h", (F.col("score") < threshold).cast("double"))
    if wkeys:
        hit = hit.groupBy(*wkeys, "fault").agg(F.max("_h").alias("_h"))
    det = hit.groupBy("fault").agg(F.count(F.lit(1)).alias("n_tested"), (F.avg("_h") * 100).alias("detection_pct"))
    return det.crossJoin(F.broadcast(fpr))
