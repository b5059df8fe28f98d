"""Group-aware splits and vehicle selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.plans import segmented as sg

RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}
SEED = 42
TERCILES = ("low", "medium", "high")
#: Vehicles of one size whose turns are one row.
TURNS = 10_000


def hash_order(cols: Sequence[str], seed: int = SEED) -> Column:
    """A seeded shuffle key; callers may pass any other order."""
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))


def trip_split(df: DataFrame, key: str = "trip_id", order: Column | None = None, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """M3: whole trips to val, test, train by shuffled rank: (key, split).

    The rank is exact without a global window: keys fall in segments of the
    order value, and only the segment counts are accumulated in one place.
    """
    keys = df.select(key).distinct().withColumn("_o", order if order is not None else hash_order([key]))
    keys = keys.withColumn(sg.SEG, F.shiftright(F.col("_o").cast("long"), 44) if order is None else sg.value_segment("_o"))
    r = sg.row_index(keys, [], ["_o", key], "_i", total="_n")
    size = lambda f: F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(f), 0))
    v, t = size(val), size(test)
    return r.select(key, F.when(F.col("_i") < v, "val").when(F.col("_i") < v + t, "test").otherwise("train").alias("split"))


def balanced_split(counts: DataFrame, key: str = "vehicle_id", n: str = "n_rows", ratios: dict[str, float] | None = None,
                   tie: Column | None = None) -> DataFrame:
    """M4: vehicles, largest first, each to the split furthest below its row target.

    The greedy choice depends on every earlier one, but only through sizes:
    vehicles of one size differ by their turn alone.  So the walk goes over runs
    (a size and how many vehicles have it, counted with map-side combine) and puts
    out a letter per turn, in blocks; a vehicle finds its turn among those of its
    size by a two-level count, and its letter by a join.
    """
    ratios = ratios or RATIOS
    names, fracs = list(ratios), list(ratios.values())
    total = counts.agg(F.sum(n).cast("double").alias("_all"))
    runs = counts.groupBy(F.col(n).cast("long").alias("_size")).agg(F.count(F.lit(1)).alias("_c")).crossJoin(F.broadcast(total))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled = [0.0] * len(names)
        for pdf in batches:
            for size, c, whole in zip(pdf["_size"].tolist(), pdf["_c"].tolist(), pdf["_all"].tolist()):
                for block, begin in enumerate(range(0, c, TURNS)):
                    turns = []
                    for _ in range(min(TURNS, c - begin)):
                        short = [(whole * f - got) / (whole * f) for f, got in zip(fracs, filled)]
                        best = short.index(max(short))
                        filled[best] += size
                        turns.append(chr(ord("a") + best))
                    yield pd.DataFrame({"_size": [size], "_block": [block], "_turns": ["".join(turns)]})

    picks = runs.repartition(1).sortWithinPartitions(F.desc("_size")).mapInPandas(walk, "_size long, _block long, _turns string")
    d = counts.select(key, F.col(n).cast("long").alias(n), F.col(n).cast("long").alias("_size"), (tie if tie is not None else hash_order([key])).alias("_tie"))
    d = d.withColumn(sg.SEG, F.shiftright("_tie", 44) if tie is None else sg.value_segment("_tie"))
    d = sg.row_index(d, ["_size"], ["_tie", key], "_i").withColumn("_block", F.floor(F.col("_i") / TURNS))
    letter = F.ascii(F.substring(F.col("_turns"), (F.col("_i") % TURNS + 1).cast("int"), F.lit(1))) - ord("a")
    return d.join(picks, ["_size", "_block"]).select(key, n, F.element_at(F.array(*[F.lit(x) for x in names]), letter + 1).alias("split"))


def row_counts(df: DataFrame, key: str = "vehicle_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def manifest(assignment: DataFrame, counts: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Assignment with row counts, ordered by split and size."""
    return assignment.select(key, "split").join(counts, key).orderBy("split", F.desc("n_rows"))


def apply_manifest(df: DataFrame, prior: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Rows with an earlier assignment; a vehicle without one is an error."""
    gone = df.select(key).distinct().join(prior, key, "left_anti").limit(10).collect()
    if gone:
        raise ValueError(f"vehicles without an assignment: {sorted(r[key] for r in gone)}")
    return df.join(prior.select(key, "split"), key)


def ensure_row_counts(selection: DataFrame, pool: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Row counts for a manifest that lacks them."""
    if "row_count" in selection.columns:
        return selection
    n = pool.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))
    return selection.join(n, key, "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)).cast("long"))


def rank_bucket(df: DataFrame, col: str, tie: str, by: Sequence[str] = (), labels: Sequence[str] = TERCILES, name: str = "row_count_tercile") -> DataFrame:
    """Equal-width rank buckets over the sorted positions 0..n-1."""
    q = len(labels)
    d = df.withColumn(sg.SEG, sg.value_segment(col))
    d = sg.row_index(d, list(by), [col, tie], "_i", total="_n")
    out = F.lit(labels[-1])
    for k in range(q - 1, 0, -1):
        out = F.when(F.col("_i") * q < (F.col("_n") - 1) * k, labels[k - 1]).otherwise(out)
    return d.select(*df.columns, out.alias(name), F.col("_n").alias("_n_pool"))


def sample_per_group(df: DataFrame, group: Sequence[str], k: int, order: Column) -> DataFrame:
    """K rows per group in shuffled order (of the vehicle table)."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def select_vehicles(man: DataFrame, per_tercile: int = 1, key: str = "vehicle_id", order: Column | None = None) -> DataFrame:
    """Test vehicles, a sample from each size tercile of each pool.

    A pool with fewer than three test vehicles fails the job.
    """
    test = man.where(F.trim(F.lower("split")) == "test")
    r = rank_bucket(test, "row_count", key, ["powertrain"])
    few = F.raise_error(F.concat(F.col("powertrain"), F.lit(": too few test vehicles to form terciles")))
    r = r.withColumn("row_count", F.when(F.col("_n_pool") < len(TERCILES), few.cast("long")).otherwise(F.col("row_count")))
    picked = sample_per_group(r, ["powertrain", "row_count_tercile"], per_tercile, order if order is not None else hash_order([key]))
    return picked.select(key, "powertrain", "row_count", "row_count_tercile")


def hold_out_last(trips: DataFrame, key: str = "vehicle_id", trip: str = "trip", frac: float = 0.2, min_test: int = 3,
                  start: str = "start_time", segment_s: float = 30 * 86400) -> DataFrame:
    """The last trips of each vehicle held out: adds ``role`` train, test or
    rejected (no trip would be left to train on) and ``first_time``."""
    d = sg.row_index(sg.with_segment(trips, start, segment_s), [key], [start, trip], "_i", total="_n")
    first = trips.groupBy(key).agg(F.min(start).alias("first_time"))
    d = d.join(first, key)
    n_test = F.greatest(F.lit(min_test), F.ceil(F.col("_n") * F.lit(frac)))
    role = F.when(F.col("_n") - n_test < 1, "rejected").when(F.col("_i") >= F.col("_n") - n_test, "test").otherwise("train")
    return d.select(*trips.columns, "first_time", role.alias("role"))


def first_step(trips: DataFrame, days: Sequence[int] = (1, 3, 7, 14, 30), start: str = "start_time") -> DataFrame:
    """Train trips with ``step``, the place in the cut-offs' order of the first that holds them ('all' comes last)."""
    since, order = F.unix_micros(start) - F.unix_micros("first_time"), sorted(days)
    return trips.withColumn("step", F.coalesce(*[F.when(since <= int(d * 86400e6), F.lit(i)) for i, d in enumerate(order)], F.lit(len(order))))


def volume_steps(trips: DataFrame, days: Sequence[int] = (1, 3, 7, 14, 30), start: str = "start_time") -> DataFrame:
    """Train trips repeated for every step whose cut-off they meet, and for 'all'."""
    since = F.unix_micros(start) - F.unix_micros("first_time")
    fits = [F.when(since <= int(d * 86400e6), F.lit(str(d))) for d in days] + [F.lit("all")]
    return trips.withColumn("day_cutoff", F.explode(F.array_compact(F.array(*fits))))


