"""Cleaning rules and keyed joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.scalars import null_out_of_range
from roadlake.operators.quality import null_fraction
from roadlake.schemas import NORMAL_CONDITIONS, TRIP_CONDITIONS

BROADCAST_ROWS = 500_000
MAX_NULL_FRACTION = 0.3


def sized(dim: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table proven small: counting stops at the limit.
    Larger ones are left to the optimiser's shuffle join."""
    return F.broadcast(dim) if dim.limit(limit + 1).count() <= limit else dim


def fix_double_encoding(c: str | Column) -> Column:
    """S2 on a text column: undo one layer of UTF-8 read as Latin-1, only where
    the tell-tale two-character degree sign is present.  Where the rest of the text
    was not read that way too, only that sign is repaired."""
    col = F.col(c) if isinstance(c, str) else c
    sign = F.replace(col, F.lit("Â°"), F.lit("°"))
    latin = F.when(~col.rlike(r"[^\x{0}-\x{FF}]"), F.try_validate_utf8(F.encode(col, "ISO-8859-1").cast("string")))
    return F.when(col.contains("Â°"), F.coalesce(latin, sign)).otherwise(col)


def parse_trip_name(df: DataFrame, file_col: str) -> DataFrame:
    """``date`` and ``condition`` from a trip file name; a name without a date fails the job."""
    date = F.regexp_extract(file_col, r"^(\d{4}-\d{2}-\d{2})_", 1)
    stem = F.regexp_replace(F.col(file_col), r"\.[^.]*$", "")
    label = F.regexp_extract(stem, r"_([A-Za-z]+)$", 1)
    known = F.create_map(*[F.lit(x) for kv in TRIP_CONDITIONS.items() for x in kv])
    checked = F.when(date == "", F.raise_error(F.concat(F.lit("no date in file name: "), F.col(file_col))).cast("string")).otherwise(date)
    return df.withColumn("date", F.to_date(checked)).withColumn(
        "condition", F.when(label == "", "unknown").otherwise(F.coalesce(known[label], F.lower(label))))


def split_conditions(df: DataFrame, normal: Sequence[str] = NORMAL_CONDITIONS) -> tuple[DataFrame, DataFrame]:
    """the ordinary-driving pool and the special hold-out."""
    ok = F.coalesce(F.col("condition").isin(*normal), F.lit(False))
    return df.where(ok), df.where(~ok)


def trip_time(day_num: str | Column, offset_ms: str | Column, epoch: str = "2017-11-01 00:00:00") -> Column:
    """1-based fractional day number plus an offset in the trip."""
    d = F.col(day_num) if isinstance(day_num, str) else day_num
    ms = F.col(offset_ms) if isinstance(offset_ms, str) else offset_ms
    base = F.unix_micros(F.to_timestamp(F.lit(epoch)))
    return F.timestamp_micros(base + F.round((d - 1) * F.lit(86400e6)).cast("long") + F.round(ms * F.lit(1000.0)).cast("long"))


def keep_supported(df: DataFrame, key: str, col: str, max_null: float = MAX_NULL_FRACTION) -> DataFrame:
    """rows of vehicles that report a signal, judged on its raw nulls."""
    out = null_fraction(df, key, col).where(F.col("null_frac") >= max_null).select(key)
    return df.join(out, key, "left_anti")


def lookup(df: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """J6."""
    return df.join(sized(dim), key, how)


def with_engine_type(df: DataFrame, static: DataFrame, key: str = "vehicle_id", keep: Sequence[str] = ("ICE", "HEV")) -> DataFrame:
    """F5."""
    return df.join(sized(static.where(F.col("engine_type").isin(*keep)).select(key, "engine_type")), key)


def clean_pool(raw: DataFrame, static: DataFrame, key: str = "vehicle_id", signal: str = "engine_load_pct") -> DataFrame:
    """F2-F5 in the order that matters: support is judged before values are nulled."""
    d = keep_supported(raw, key, signal).withColumn(signal, null_out_of_range(signal))
    d = with_engine_type(d, static, key)
    return d.withColumn("time", trip_time("day_num", "offset_ms")).drop("day_num", "offset_ms")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U5 as a table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error naming some repeated keys."""
    bad = duplicates(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"duplicate keys: {[tuple(r[k] for k in keys) for r in bad]}")
    return df


def concat(*dfs: DataFrame) -> DataFrame:
    """U1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def missing_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def distinct_trips(df: DataFrame, cols: Sequence[str] = ("trip_id", "source_file", "condition")) -> DataFrame:
    """U3."""
    return df.select(*cols).dropDuplicates()


def semi_trips(df: DataFrame, trips: DataFrame, keys: Sequence[str] = ("vehicle_id", "trip")) -> DataFrame:
    """J7."""
    return df.join(trips.select(*keys), list(keys), "left_semi")


def attach_raw(features: DataFrame, raw: DataFrame, keys: Sequence[str] = ("vehicle_id", "trip", "time"), cols: Sequence[str] = ("rpm",)) -> DataFrame:
    """J8."""
    return features.join(raw.select(*keys, *cols), list(keys), "left")


def cross_candidates(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Every row with each of a short list of values, without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def flag(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """F16: strictly below the threshold is anomalous."""
    return df.withColumn("is_anomalous", F.col(score) < F.lit(threshold))


def explode_pids(df: DataFrame, pids: str = "all_pids") -> DataFrame:
    """one row per swept signal, its label the description or else the key."""
    keep = [c for c in df.columns if c != pids]
    d = df.select(*keep, F.explode(pids).alias("_k", "_v"))
    return d.select(*keep, F.coalesce(F.nullif(F.col("_v.desc"), F.lit("")), F.col("_k")).alias("pid"),
                    F.col("_v.value").alias("value"), F.coalesce(F.col("_v.unit"), F.lit("")).alias("unit"))
