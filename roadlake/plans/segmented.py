"""Two-level windows: ordered computations that never put a whole key in one task.

``Window.partitionBy(vehicle).orderBy(time)`` sends every row of a vehicle to
one task.  Here the key is split into segments along the order (fixed spans of
time by default); each (key, segment) is a window of its own, and a small table
with one row per segment carries what crosses the border.  The rows shuffle
once, on (key, segment); the border table is built from a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.session import materialize

SEG = "_seg"
_PARTS = 1 << 20
_SMALL = 500_000


@dataclass(frozen=True)
class Adaptive:
    """Time spans of ``seconds``, those with more than ``target`` rows cut finer.

    ``counted`` may name a table to count instead, by time alone: one that holds at
    least the rows that any key can have in a span, and is cheaper to read.
    """

    seconds: float
    target: int = 2_000_000
    counted: DataFrame | None = None


def time_segment(time: str | Column, seconds: float) -> Column:
    """Number of the fixed time span a row lies in."""
    c = F.col(time) if isinstance(time, str) else time
    return F.floor(F.unix_micros(c) / F.lit(int(seconds * 1_000_000))).cast("long")


def with_segment(df: DataFrame, time: str, span: float | Adaptive, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the segment column: fixed spans of seconds, or adaptive ones.

    Fixed spans suit keys whose rows come at a sensor's rate.  Where many sources
    share a key, :class:`Adaptive` first counts rows per (key, span), a pass over
    two columns with map-side combine, and cuts crowded spans into eight equal
    parts per target they hold (rows may be uneven inside a span too).
    """
    if not isinstance(span, Adaptive):
        return df.withColumn(SEG, time_segment(time, span))
    keys, width = list(keys), int(span.seconds * 1_000_000)
    base = time_segment(time, span.seconds)
    source = df
    if span.counted is not None:
        source, keys = span.counted, []
    hot = source.groupBy(*keys, base.alias("_base")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > span.target)
    hot = materialize(hot.select(*keys, "_base", F.least(F.ceil(F.col("_n") * 8 / span.target), F.lit(_PARTS)).alias("_parts")), "hot-spans")
    n_hot = hot.limit(_SMALL + 1).count()
    if not n_hot:
        return df.withColumn(SEG, base * _PARTS)
    d = df.withColumn("_base", base).join(F.broadcast(hot) if n_hot <= _SMALL else hot, [*keys, "_base"], "left")
    part = F.floor((F.unix_micros(time) - F.col("_base") * width) / F.lit(float(width)) * F.coalesce("_parts", F.lit(1)))
    return d.select(*df.columns, (F.col("_base") * _PARTS + part).cast("long").alias(SEG))


def suggest_seconds(df: DataFrame, keys: Sequence[str], time: str | Column, seconds: float = 3600, target: int = 2_000_000) -> float:
    """Halve ``seconds`` until no (key, segment) holds more than ``target`` rows.

    One pass over the key and time columns with map-side combine; only the
    largest count comes back.
    """
    top = (
        df.groupBy(*keys, time_segment(time, seconds).alias(SEG)).count().agg(F.max("count").alias("n")).first()["n"] or 0
    )
    while top > target and seconds > 1:
        seconds, top = seconds / 2, top / 2
    return seconds


def _local(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, SEG).orderBy(*order)


def _across(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(SEG) if keys else Window.partitionBy(F.lit(0)).orderBy(SEG)


def lag_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, Column]) -> DataFrame:
    """Values of the previous row of the key (null for its first row).

    ``df`` needs a segment column that grows along ``order``; keys must be non-null.
    """
    payload = F.struct(*[e.alias(n) for n, e in cols.items()])
    last = df.groupBy(*keys, SEG).agg(F.max_by(payload, F.struct(*order)).alias("_last"))
    carry = last.select(*keys, SEG, F.lag("_last").over(_across(keys)).alias("_carry"))
    out = df.withColumn("_prev", F.lag(payload).over(_local(keys, order))).join(carry, [*keys, SEG], "left")
    prev = F.coalesce("_prev", "_carry")
    return out.select(*df.columns, *[prev[n].alias(n) for n in cols])


def lag_time(df: DataFrame, keys: Sequence[str], time: str, tie: str, name: str = "_p") -> DataFrame:
    """Epoch microseconds of the previous row of the key.  The latest time of a
    segment is a plain maximum, so the border table is a hash aggregate."""
    us = F.unix_micros(time)
    last = df.groupBy(*keys, SEG).agg(F.max(us).alias("_last"))
    carry = last.select(*keys, SEG, F.lag("_last").over(_across(keys)).alias("_carry"))
    out = df.withColumn("_prev", F.lag(us).over(_local(keys, [time, tie]))).join(carry, [*keys, SEG], "left")
    return out.select(*df.columns, F.coalesce("_prev", "_carry").alias(name))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, Column]) -> DataFrame:
    """Running totals of each expression over the key, current row included."""
    tot = df.groupBy(*keys, SEG).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in cols.items()])
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*keys, SEG, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in cols])
    here = _local(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.select("*", *[F.sum(e).over(here).alias(f"_r_{n}") for n, e in cols.items()]).join(carry, [*keys, SEG], "left")
    return out.select(*df.columns, *[(F.coalesce(f"_r_{n}", F.lit(0)) + F.col(f"_c_{n}")).alias(n) for n in cols])


def max_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The largest value of the rows before each row of the key (null where there is none)."""
    return maxima_before(df, keys, order, {name: value})


def maxima_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """:func:`max_before` for several values at once."""
    top = df.groupBy(*keys, SEG).agg(*[F.max(v).alias(f"_t_{n}") for n, v in values.items()])
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = top.select(*keys, SEG, *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in values])
    here = _local(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({f"_m_{n}": F.max(v).over(here) for n, v in values.items()}).join(carry, [*keys, SEG], "left")
    return out.select(*df.columns, *[F.greatest(f"_m_{n}", f"_c_{n}").alias(n) for n in values])


def next_to(keys: Sequence[str], order: Sequence[str]) -> Window:
    """The window of a row's neighbours in its segment, for rows that are known to share one."""
    return _local(keys, order)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx", total: str | None = None) -> DataFrame:
    """0-based position of a row in its key, and the size of the key if asked."""
    tot = df.groupBy(*keys, SEG).agg(F.count(F.lit(1)).alias("_n"))
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    whole = _across(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = tot.select(*keys, SEG, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"), F.sum("_n").over(whole).alias("_all"))
    out = df.withColumn("_rn", F.row_number().over(_local(keys, order))).join(carry, [*keys, SEG], "left")
    extra = [F.col("_all").alias(total)] if total else []
    return out.select(*df.columns, (F.col("_rn") - 1 + F.col("_c")).cast("long").alias(name), *extra)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: Column) -> DataFrame:
    """Runs of equal state (W5): adds ``state``, ``run_id`` (1, 2, ... in the key)
    and ``run_pos`` (0-based position in the run).

    The border table is built from the state alone: how often it changes in a
    segment, its first and last value, the rows after the last change.  A run may
    cover any number of segments.
    """
    keys = list(keys)
    slim = df.select(*keys, SEG, *order, state.alias("state"))
    here = _local(keys, order)
    changed = lambda d: (~F.col("state").eqNullSafe(F.lag("state").over(here)) & (F.row_number().over(here) > 1)).cast("long")
    m = slim.withColumn("_chg", changed(slim)).withColumn("_rn", F.row_number().over(here))
    # order columns decide first and last; row numbers do it with a plain maximum
    m = m.groupBy(*keys, SEG).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_chg").alias("_k"), F.max(F.when(F.col("_chg") == 1, F.col("_rn"))).alias("_lastchg"),
        F.max_by(F.struct("state"), "_rn").alias("_last"), F.min_by(F.struct("state"), "_rn").alias("_first"))
    w = _across(keys)
    past, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_pl", F.lag("_last").over(w))
    m = m.withColumn("_brk", (F.col("_pl").isNull() | ~F.col("_first.state").eqNullSafe(F.col("_pl.state"))).cast("long"))
    m = m.withColumn("_base", F.coalesce(F.sum(F.col("_k") + F.col("_brk")).over(past), F.lit(0)) + F.col("_brk"))
    m = m.withColumn("_g", F.sum(F.when((F.col("_k") > 0) | (F.col("_brk") == 1), 1).otherwise(0)).over(upto))
    tail = F.when(F.col("_k") > 0, F.col("_n") - F.col("_lastchg") + 1).otherwise(F.col("_n"))
    inside = Window.partitionBy(*keys, "_g").orderBy(SEG).rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_open", F.sum(tail).over(inside))
    carry = m.select(*keys, SEG, "_base", F.when(F.col("_brk") == 1, 0).otherwise(F.lag("_open").over(w)).alias("_before"))

    d = df.withColumn("state", state)
    d = d.withColumn("_chg", changed(d)).withColumn("_rn", F.row_number().over(here))
    sofar = here.rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", F.sum("_chg").over(sofar).alias("_k"), F.max(F.when(F.col("_chg") == 1, F.col("_rn"))).over(sofar).alias("_start"))
    d = d.join(carry, [*keys, SEG], "left")
    pos = F.when(F.col("_start").isNotNull(), F.col("_rn") - F.col("_start")).otherwise(F.col("_rn") - 1 + F.col("_before"))
    return d.select(*[c for c in df.columns if c != "state"], "state", (F.col("_base") + F.col("_k")).cast("long").alias("run_id"), pos.cast("long").alias("run_pos"))


def rising_edge(df: DataFrame, keys: Sequence[str], order: Sequence[str], mask: Column, name: str = "edge") -> DataFrame:
    """True where ``mask`` turns true; null counts as false and ends a run."""
    d = df.withColumn("_m", F.coalesce(mask, F.lit(False)))
    d = lag_rows(d, keys, order, {"_pm": F.col("_m")})
    return d.select(*df.columns, (F.col("_m") & ~F.coalesce("_pm", F.lit(False))).alias(name))


def value_segment(col: str | Column, per_octave: int = 4096) -> Column:
    """Order-keeping bin of a number (so many per power of two), the segment column
    of computations ordered by value rather than time."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    mag = F.floor((F.log2(F.abs(c)) + F.lit(1100.0)) * F.lit(float(per_octave)))
    return F.when(c == 0, F.lit(0)).otherwise(F.signum(c) * mag).cast("long")
