"""Exact order statistics without gathering a group anywhere.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.
Here one pass counts values per order-keeping bin, the bins that hold the asked
ranks are found from those counts, and a second pass looks only inside them.
Both passes combine before they shuffle, so a value that makes up a third of
all rows travels as one (value, count) row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.plans.segmented import value_segment
from roadlake.session import materialize

_SMALL = 200_000
#: Rows of a bin beyond which it is cut into so many equal stretches of its own range.
_CROWDED, _FINER = 1_000_000, 8192


def percentiles(df: DataFrame, col: str, ps: Sequence[float], by: Sequence[str] = (), crowded: int = _CROWDED) -> DataFrame:
    """Linear-interpolated percentiles: one row per (group, p) with ``value``.

    Nulls are skipped; groups without values give no row.  ``df`` is read twice,
    the first time at once: hand in a stored or cheap input.  Where close values
    crowd a bin (over ``crowded`` rows), a pass more cuts it finer.
    """
    by = list(by)
    v = F.col(col).cast("double")
    base = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    base = base.withColumn("_b", value_segment("_v", 16384))

    bins = base.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = part.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.select(*by, "_b", "_n", "_mn", "_mx", (F.sum("_n").over(upto) - F.col("_n")).alias("_lo"), F.sum("_n").over(part).alias("_tot"))

    asks = F.explode(F.array(*[F.lit(float(p)) for p in ps]))
    wanted = bins.withColumn("p", asks).withColumn("_pos", F.col("p") * (F.col("_tot") - 1))
    wanted = wanted.withColumn("_k", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))))
    wanted = wanted.where((F.col("_k") >= F.col("_lo")) & (F.col("_k") < F.col("_lo") + F.col("_n")))
    # at most two rows per group and percentile; stored, so the first pass runs once
    wanted = materialize(wanted.select(*by, "_b", "_lo", "p", "_pos", "_k", "_n", "_mn", "_mx").distinct(), "ranks")
    if (wanted.agg(F.max("_n")).first()[0] or 0) > crowded:
        base, wanted = _refined(base, wanted, by)

    hit_bins = wanted.select(*by, "_b", "_lo").distinct()
    if wanted.limit(_SMALL + 1).count() <= _SMALL:
        hit_bins = F.broadcast(hit_bins)
    inner = base.join(hit_bins, [*by, "_b"]).groupBy(*by, "_b", "_lo", "_v").agg(F.count(F.lit(1)).alias("_c"))
    cum = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.withColumn("_end", F.col("_lo") + F.sum("_c").over(cum))
    inner = inner.select(*by, "_b", "_v", (F.col("_end") - F.col("_c")).alias("_from"), "_end")

    near = wanted.drop("_lo", "_n", "_mn", "_mx").join(inner, [*by, "_b"]).where((F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_end")))
    lo = F.max(F.when(F.col("_k") == F.floor("_pos"), F.col("_v")))
    hi = F.max(F.when(F.col("_k") == F.ceil("_pos"), F.col("_v")))
    frac = F.col("_pos") - F.floor("_pos")
    out = near.groupBy(*by, "p", "_pos").agg(lo.alias("_l"), hi.alias("_h"))
    return out.select(*by, "p", (F.col("_l") + (F.col("_h") - F.col("_l")) * frac).alias("value"))


def _refined(base: DataFrame, wanted: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of the bins that hold asked ranks, and the ranks, both by finer bins."""
    held = wanted.select(*by, "_b", "_lo", "_mn", "_mx").distinct()
    if wanted.limit(_SMALL + 1).count() <= _SMALL:
        held = F.broadcast(held)
    part = F.when(F.col("_mx") > F.col("_mn"), F.floor((F.col("_v") - F.col("_mn")) / (F.col("_mx") - F.col("_mn")) * (_FINER - 1))).otherwise(0)
    rows = base.join(held, [*by, "_b"]).withColumn("_s", part.cast("long"))
    parts = rows.groupBy(*by, "_b", "_lo", "_s").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_fn"), F.max("_v").alias("_fx"))
    upto = Window.partitionBy(*by, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("_from", F.col("_lo") + F.sum("_c").over(upto) - F.col("_c")).drop("_lo")
    near = wanted.select(*by, "_b", "p", "_pos", "_k").join(parts, [*by, "_b"]).where((F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_from") + F.col("_c")))
    finer = lambda b, s: F.struct(b.alias("b"), s.alias("s"))
    near = near.select(*by, finer(F.col("_b"), F.col("_s")).alias("_b"), F.col("_from").alias("_lo"), "p", "_pos", "_k", F.col("_c").alias("_n"), F.col("_fn").alias("_mn"), F.col("_fx").alias("_mx"))
    return rows.select(*by, "_v", finer(F.col("_b"), F.col("_s")).alias("_b")), materialize(near, "ranks")


def percentile_columns(df: DataFrame, col: str, named: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The same as one row per group with a named column for each percentile."""
    rows = percentiles(df, col, sorted(set(named.values())), by)
    aggs = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(n) for n, p in named.items()]
    return rows.groupBy(*by).agg(*aggs)
