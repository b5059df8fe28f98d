"""Reading a training-volume study: flat steps, saturation, stabilisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.schemas import SWEEP_RESULTS

CURVE = ["powertrain", "vehicle_id", "fault_type"]
# What the readers below use of a result table: all but its rates, sizes and counts.
REQUIRED = [f.name for f in SWEEP_RESULTS.fields if not f.name.startswith(("detect_", "n_", "magnitude"))]
FPR_TARGETS = (2, 5, 10)


def check_results(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"not a sweep result: {', '.join(missing)} not among {', '.join(df.columns)}")
    return df


def _rate(fpr: int) -> str:
    if fpr not in FPR_TARGETS:
        raise ValueError(f"fpr must be one of {FPR_TARGETS}")
    return f"detect_rate_at_{fpr}pct_fpr"


def dedupe_flat(results: DataFrame) -> DataFrame:
    """Of steps with the same span the one with the greatest cut-off text stays."""
    keys = ["vehicle_id", "fault_type", "std_multiple", "actual_train_span_days"]
    rest = [c for c in results.columns if c not in keys]
    pay = F.struct(*[F.col(c) for c in rest])
    best = results.groupBy(*keys).agg(F.max_by(pay, F.col("day_cutoff").cast("string")).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in results.columns])


def saturation(results: DataFrame, fpr: int = 2, std_multiple: float = 3.0, frac: float = 0.95) -> DataFrame:
    """First day at which a curve reaches ``frac`` of its own maximum."""
    c, day = F.col(_rate(fpr)), F.col("actual_train_span_days")
    d = results.where(F.col("std_multiple") == std_multiple)
    top = d.groupBy(*CURVE).agg(F.max(c).alias("_m"))
    d = d.join(top, CURVE)
    return d.groupBy(*CURVE).agg(
        F.bround(F.max("_m"), 3).alias("own_max_detect_rate"),
        F.bround(F.min(F.when(c >= F.col("_m") * frac, day)), 1).alias(f"saturation_days_at_{int(frac * 100)}pct_of_own_max"))


def stabilization(results: DataFrame, fpr: int = 2, std_multiple: float = 3.0, tol: float = 0.10) -> DataFrame:
    """Start of the closing stretch that stays within ``tol`` of the final value.

    A curve has one row per training step (a handful), so the window is small.
    """
    c, day = F.col(_rate(fpr)), F.col("actual_train_span_days")
    d = results.where(F.col("std_multiple") == std_multiple)
    fin = d.groupBy(*CURVE).agg(F.max_by(c, day).alias("_f"), F.max(c).alias("_m"))
    d = d.join(fin, CURVE).withColumn("_bad", F.abs(c - F.col("_f")) > tol)
    ahead = Window.partitionBy(*CURVE).orderBy(day).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = d.withColumn("_any", F.max("_bad").over(ahead))
    return d.groupBy(*CURVE).agg(
        F.bround(F.first("_f"), 3).alias("final_detect_rate"), F.bround(F.first("_m"), 3).alias("own_max_detect_rate"),
        F.bround(F.first(F.col("_m") - F.col("_f")), 3).alias("max_minus_final_gap"),
        F.bround(F.min(F.when(~F.col("_any"), day)), 1).alias(f"stabilizes_from_days_within_{tol}"))
