"""Acquisition quality and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.plans import segmented as sg
from roadlake.plans.selection import percentile_columns, percentiles
from roadlake.session import materialize

CORE_PIDS = ["rpm", "speed_kmh", "coolant_temp_c", "engine_load_pct"]
# A minute, cut finer where many sources share a key.
SPAN = sg.Adaptive(60)
QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}


def trip_bounds(df: DataFrame, keys: Sequence[str] = ("vehicle_id", "trip"), time: str = "time") -> DataFrame:
    """A10."""
    return df.groupBy(*keys).agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count(time).alias("n_rows"))


def null_fraction(df: DataFrame, key: str, col: str) -> DataFrame:
    """Share of missing readings per vehicle."""
    return df.groupBy(key).agg(F.avg(F.col(col).isNull().cast("double")).alias("null_frac"))


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std, min, quartiles, max; one row per column (and group)."""
    by = list(by)
    k = [*by, "column"]
    v = {c: F.col(c).cast("double") for c in cols}
    aggs = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.groupBy(*by).agg(*[F.struct(F.lit(c).alias("column"), *[f(v[c]).alias(n) for n, f in aggs.items()]).alias(f"_s{i}") for i, c in enumerate(cols)])
    base = one.select(*by, F.inline(F.array(*[F.col(f"_s{i}") for i in range(len(cols))]))).where("n > 0")
    # Quartiles column by column: a columnar scan reads one column each time, and no row is multiplied. The
    # first passes of the columns run beside each other.
    quartiles = lambda c: percentile_columns(df.select(*by, v[c].alias("v")), "v", QUARTILES, by).withColumn("column", F.lit(c))
    with ThreadPoolExecutor(8) as pool:
        parts = list(pool.map(quartiles, cols))
    return base.join(reduce(DataFrame.unionByName, parts), k)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every pair in one aggregate; rows lacking either value are skipped."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{i}").alias("r"))
             for i, (a, b) in enumerate(pairs) for x, y in {(a, b), (b, a)}]
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.a", "_c.b", "_c.r")


def gaps(df: DataFrame, keys: Sequence[str], time: str = "time", tie: str = "event_id", segment_s: float | sg.Adaptive = SPAN) -> DataFrame:
    """Seconds to the previous row of the key (``gap_s``), first rows left out."""
    d = sg.lag_time(sg.with_segment(df.select(*keys, time, tie), time, segment_s, keys), keys, time, tie)
    d = d.where(F.col("_p").isNotNull())
    return d.select(*keys, time, tie, ((F.unix_micros(time) - F.col("_p")) / 1e6).alias("gap_s"))


def gap_counts(df: DataFrame, keys: Sequence[str], digits: int = 2, **kw) -> DataFrame:
    """How often each gap occurs."""
    g = gaps(df, keys, **kw).select(F.floor(F.col("gap_s") * 10**digits) / float(10**digits))
    return g.toDF("gap_s").groupBy("gap_s").count().orderBy("gap_s")


def completeness_gap(df: DataFrame, keys: Sequence[str], pids: Sequence[str] = CORE_PIDS, k: float = 3.0,
                     time: str = "time", tie: str = "event_id", segment_s: float | sg.Adaptive = SPAN) -> DataFrame:
    """Completeness against the median interval, and connection-loss events."""
    keys = list(keys)
    g = materialize(gaps(df, keys, time, tie, segment_s).select(*keys, "gap_s"), "gaps")  # read three times
    med = percentile_columns(g, "gap_s", {"expected_interval_s": 0.5}, keys)
    tot = df.groupBy(*keys).agg(
        ((F.max(F.unix_micros(time)) - F.min(F.unix_micros(time))) / 1e6).alias("duration_s"), *[F.count(p).alias(f"_n_{p}") for p in pids])
    over = F.col("gap_s") > F.col("expected_interval_s") * k
    loss = g.join(med, keys).groupBy(*keys).agg(
        F.count_if(over).alias("loss_events"),
        F.coalesce(F.sum(F.when(over, F.col("gap_s") - F.col("expected_interval_s"))), F.lit(0.0)).alias("lost_s"))
    d = tot.join(med, keys).join(loss, keys).withColumn("expected_count", F.col("duration_s") / F.nullif("expected_interval_s", F.lit(0)))
    pct = [F.bround(F.col(f"_n_{p}") * 100 / F.col("expected_count"), 1) for p in pids]
    d = d.select(*keys, "expected_interval_s", "duration_s", "expected_count", "loss_events", "lost_s",
                 (F.col("lost_s") * 100 / F.col("duration_s")).alias("lost_pct"), *[c.alias(f"{p}_pct") for p, c in zip(pids, pct)])
    return d.withColumn("overall_pct", sum((F.col(f"{p}_pct") for p in pids), F.lit(0.0)) / len(pids))


def completeness_per_second(df: DataFrame, keys: Sequence[str], pids: Sequence[str] = CORE_PIDS, time: str = "time") -> DataFrame:
    """Share of whole seconds with a reading, per signal and overall."""
    keys = list(keys)
    sec = df.groupBy(*keys, F.floor(F.unix_micros(time) / 1000000).alias("_s")).agg(
        F.min(F.unix_micros(time)).alias("_lo"), F.max(F.unix_micros(time)).alias("_hi"),
        *[F.max(F.col(p).isNotNull().cast("int")).alias(f"_h_{p}") for p in pids])
    out = sec.groupBy(*keys).agg((F.floor((F.max("_hi") - F.min("_lo")) / 1000000) + 1).alias("expected_seconds"),
                                 *[F.sum(f"_h_{p}").alias(f"_h_{p}") for p in pids])
    out = out.select(*keys, "expected_seconds", *[F.bround(F.col(f"_h_{p}") * 100.0 / F.col("expected_seconds"), 1).alias(f"{p}_pct") for p in pids])
    return out.withColumn("overall_pct", sum((F.col(f"{p}_pct") for p in pids), F.lit(0.0)) / len(pids))


def missing_runs(df: DataFrame, keys: Sequence[str], min_len: int = 2, time: str = "time", segment_s: float | sg.Adaptive = sg.Adaptive(600)) -> DataFrame:
    """Runs of whole seconds without any row; found from the jump between
    present seconds, so no missing second is ever written out."""
    keys = list(keys)
    sec = df.select(*keys, F.timestamp_seconds(F.floor(F.unix_micros(time) / 1000000)).alias("sec")).distinct()
    d = sg.lag_time(sg.with_segment(sec, "sec", segment_s, keys), keys, "sec", "sec")
    before = F.floor(F.col("_p") / 1000000)
    n = F.unix_seconds("sec") - before - 1
    return d.where(n >= min_len).select(*keys, F.timestamp_seconds(before + 1).alias("run_start"), n.alias("run_len"))


def missing_summary(df: DataFrame, keys: Sequence[str], min_len: int = 2, time: str = "time") -> DataFrame:
    """W9 totals: loss events, lost seconds and their share of the expected ones."""
    keys = list(keys)
    runs = missing_runs(df, keys, min_len, time).groupBy(*keys).agg(F.count(F.lit(1)).alias("loss_events"), F.sum("run_len").alias("lost_s"))
    span = df.groupBy(*keys).agg((F.floor((F.max(F.unix_micros(time)) - F.min(F.unix_micros(time))) / 1000000) + 1).alias("expected_seconds"))
    d = span.join(runs, keys, "left").fillna({"loss_events": 0, "lost_s": 0})
    return d.withColumn("lost_pct", F.col("lost_s") * 100.0 / F.col("expected_seconds"))


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A22."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Density per bin of a fixed range; the last bin is closed above."""
    by = list(by)
    v, width = F.col(col).cast("double"), (hi - lo) / bins
    b = F.least(F.floor((v - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    h = df.where(v.between(lo, hi)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    tot = h.groupBy(*by).agg(F.sum("n").alias("_all"))
    h = h.join(tot, by) if by else h.crossJoin(F.broadcast(tot))
    return h.select(*by, "bin", (F.lit(lo) + F.col("bin") * width).alias("bin_lo"), "n", (F.col("n") / (F.col("_all") * width)).alias("density"))


def flag_rate_by(df: DataFrame, flag: Column, states: dict[str, Column]) -> DataFrame:
    """Flag percentage and share of rows for each state, from one aggregate."""
    cells = [F.struct(F.lit(n).alias("state"), F.count_if(c).alias("n"), F.avg(F.when(c, flag.cast("double"))).alias("r"),
                      F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias("s")) for n, c in states.items()]
    one = df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c"))
    return one.select("_c.state", "_c.n", (F.col("_c.r") * 100).alias("flag_pct"), (F.col("_c.s") * 100).alias("share_pct"))


def split_report(df: DataFrame, split: str, key: str, targets: dict[str, float] | None = None) -> DataFrame:
    """Vehicles and rows of each split with their shares."""
    per = df.groupBy(split, key).agg(F.count(F.lit(1)).alias("_n"))
    rep = per.groupBy(split).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("_n").alias("n_rows"))
    all_keys = per.groupBy(key).agg(F.sum("_n").alias("_n")).agg(F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_r"))
    rep = rep.crossJoin(F.broadcast(all_keys))
    out = rep.select(split, "n_keys", (F.col("n_keys") * 100 / F.col("_k")).alias("keys_pct"), "n_rows", (F.col("n_rows") * 100 / F.col("_r")).alias("rows_pct"))
    if targets:
        t = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v * 100))])
        out = out.withColumn("target_pct", t[F.col(split)])
    return out


def rows_per_trip(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distribution of trip sizes."""
    return describe(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), ["rows"])


def label_counts(df: DataFrame, keys: Sequence[str], label: str, order: Column | str) -> DataFrame:
    """Trips per label, the label being that of a trip's first row."""
    first = df.groupBy(*keys).agg(F.min_by(label, order).alias(label))
    return first.groupBy(label).agg(F.count(F.lit(1)).alias("n_trips"))


def share_beyond(df: DataFrame, ref: DataFrame, col: str, p: float = 0.95) -> DataFrame:
    """Share of rows whose size exceeds a percentile of another population."""
    lim = percentiles(ref.select(F.abs(F.col(col)).alias("_a")), "_a", [p]).select(F.col("value").alias("ref_limit"))
    d = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(lim))
    return d.groupBy("ref_limit").agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(F.col(col)) > F.col("ref_limit")).cast("double")).alias("share_beyond"))


def compare_variants(variants: dict[str, DataFrame], flag: str, on: Column, devs: Sequence[str]) -> DataFrame:
    """Variants side by side: flag rates and median absolute deviations."""
    parts = [df.select(F.lit(n).alias("variant"), F.col(flag).cast("double").alias("_f"), on.alias("_on"),
                       *[F.abs(F.col(c)).alias(c) for c in devs]) for n, df in variants.items()]
    allv = parts[0]
    for x in parts[1:]:
        allv = allv.unionByName(x)
    out = allv.groupBy("variant").agg((F.avg("_f") * 100).alias("flag_pct"), (F.avg(F.when(F.col("_on"), F.col("_f"))) * 100).alias("engine_on_flag_pct"))
    for c in devs:
        out = out.join(percentile_columns(allv.where("_on"), c, {f"median_abs_{c}": 0.5}, ["variant"]), "variant", "left")
    return out


def liveness(df: DataFrame, keys: Sequence[str], cols: Sequence[str], time: str = "time", tie: str = "event_id", segment_s: float | sg.Adaptive = SPAN) -> DataFrame:
    """Share of the most common value, and share of rows where a value changes."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_x"))
    vc = long.select("_x.column", "_x.v").where("v IS NOT NULL").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    top = vc.groupBy("column").agg((F.max("n") / F.sum("n")).alias("top_share"))
    d = sg.lag_rows(sg.with_segment(df, time, segment_s, keys), keys, [time, tie], {f"_p_{c}": F.col(c) for c in cols})
    both = lambda c: F.col(c).isNotNull() & F.col(f"_p_{c}").isNotNull()
    one = d.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(F.when(both(c), (F.col(c) != F.col(f"_p_{c}")).cast("double"))).alias("change_share"))
                          for c in cols]).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.column", "_c.change_share")
    return top.join(one, "column")


def stretches(df: DataFrame, keys: Sequence[str], state: Column, time: str = "time", tie: str = "event_id", segment_s: float | sg.Adaptive = SPAN) -> DataFrame:
    """Runs of one state: its value, start, length in seconds and rows (W5 folded)."""
    keys = list(keys)
    d = sg.runs(sg.with_segment(df.select(*keys, time, tie, state.alias("_st")), time, segment_s, keys), keys, [time, tie], F.col("_st"))
    us = F.unix_micros(time)
    return d.groupBy(*keys, "run_id").agg(
        F.max("state").alias("state"), F.min(time).alias("run_start"), F.count(F.lit(1)).alias("n_rows"), ((F.max(us) - F.min(us)) / 1e6).alias("length_s"))


def stretch_stats(df: DataFrame, keys: Sequence[str], on: Column, short_s: float = 10, long_s: float = 60, **kw) -> DataFrame:
    """Distribution of engine-on stretch lengths."""
    s = materialize(stretches(df, keys, on, **kw).where("state").select("length_s"), "stretches")
    shares = s.agg((F.avg((F.col("length_s") < short_s).cast("double"))).alias("share_short"), F.count_if(F.col("length_s") >= long_s).alias("n_long"))
    return describe(s, ["length_s"]).drop("column").crossJoin(F.broadcast(shares))


def run_position(df: DataFrame, keys: Sequence[str], state: Column, time: str = "time", tie: str = "event_id", segment_s: float | sg.Adaptive = SPAN) -> DataFrame:
    """Rows with the state, number and 0-based position of their run."""
    return sg.runs(sg.with_segment(df, time, segment_s, keys), keys, [time, tie], state).drop(sg.SEG)


def flag_by_run_age(df: DataFrame, flag: str, split_at: int = 60) -> DataFrame:
    """W6 + A16: flag rate early and late in an on-run, from ``run_position`` rows."""
    on = df.where("state")
    return on.groupBy(F.when(F.col("run_pos") < split_at, "early").otherwise("later").alias("phase")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col(flag).cast("double")) * 100).alias("flag_pct"))


def feature_std(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A17."""
    return df.groupBy(*by).agg(*[F.stddev_samp(c).alias(f"{c}_std") for c in cols])
