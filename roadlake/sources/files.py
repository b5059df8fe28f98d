"""File and table sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake.functions.scalars import no_nan
from roadlake.operators.cleaning import assert_unique, concat, fix_double_encoding, parse_trip_name
from roadlake.plans import segmented as sg
from roadlake.schemas import SWEEP_RESULTS, TRIP_HEADER, WEEKLY_HEADER

TRIP_SCHEMA = T.StructType([T.StructField(n, T.StringType() if n == "time_str" else T.DoubleType()) for n in TRIP_HEADER.values()])


def headers(spark: SparkSession, path: str, glob: str = "*") -> dict[tuple[str, ...], list[str]]:
    """The files under a folder by their header, repaired and trimmed.

    Every file is one task that ends after its first rows: no file is scanned.
    One short line per file comes to the driver, which lists the files anyway.
    """

    def first_rows(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.head(1)
                return

    keys, one = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"], str(1 << 40)
    before = {k: spark.conf.get(k) for k in keys}
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.substring("value", 1, 1 << 16).alias("value"))
    try:
        for k in keys:
            spark.conf.set(k, one)
        found = lines.mapInPandas(first_rows, "file string, value string")
        found = found.select("file", F.transform(F.split(fix_double_encoding("value"), ","), lambda x: F.trim(x)).alias("names")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out: dict[tuple[str, ...], list[str]] = {}
    for r in found:
        out.setdefault(tuple(r["names"]), []).append(unquote(r["file"]))
    return out


def read_by_name(spark: SparkSession, path: str, types: dict[str, T.DataType], renamed: dict[str, str], glob: str = "*", what: str = "file") -> DataFrame:
    """CSV files whose columns are found by their names, in any order and among any others.

    Files are read once per distinct header, each group with its own schema; a file
    that lacks a needed column is an error. Adds the columns of ``_metadata`` and of
    partition folders.
    """
    groups = headers(spark, path, glob)
    if not groups:
        raise FileNotFoundError(f"no files match {glob} under {path}")
    bad = [(sorted(set(renamed) - set(h)), files[0]) for h, files in groups.items() if not set(renamed) <= set(h) or any(h.count(n) > 1 for n in renamed)]
    if bad:
        raise ValueError(f"{what} without the columns {bad[0][0]}: {bad[0][1]}")
    reader = spark.read.option("header", "true").option("enforceSchema", "true").option("basePath", path).option("pathGlobFilter", glob)
    parts = []
    for header, files in sorted(groups.items()):
        schema = T.StructType([T.StructField(renamed.get(n, f"_c{i}"), types.get(n, T.StringType())) for i, n in enumerate(header)])
        d = reader.schema(schema).csv(path if len(groups) == 1 else files)
        folders = [c for c in d.columns if c not in schema.names]
        values = [no_nan(n).alias(n) if isinstance(schema[n].dataType, T.DoubleType) else F.col(n) for n in renamed.values()]
        parts.append(d.select(*values, *folders, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias(sg.SEG)))
    return reduce(DataFrame.unionByName, parts)


def load_trips(spark: SparkSession, path: str) -> DataFrame:
    """All trip files of a folder with trip_id, condition, timestamp.

    Columns are found by name after damaged header bytes are repaired.  Files hold a
    clock without a date: the date comes from the file name (or from a
    ``source_file`` partition folder) and moves on a day whenever the clock steps
    back.  Physical row order is the offset of the file split plus the position
    in it; splits are the segments of that walk, so big files stay split.
    """
    raw = read_by_name(spark, path, {h: TRIP_SCHEMA[n].dataType for h, n in TRIP_HEADER.items()}, TRIP_HEADER, what="trip file")
    name = F.col("source_file") if "source_file" in raw.columns else F.col("_name")
    d = raw.select(*TRIP_SCHEMA.names, name.alias("source_file"), "_f", sg.SEG)
    d = d.withColumn("_pos", F.monotonically_increasing_id())
    d = sg.lag_rows(d, ["_f"], ["_pos"], {"_pc": F.col("time_str")})
    d = d.withColumn("_back", F.coalesce(F.col("time_str") < F.col("_pc"), F.lit(False)).cast("long"))
    d = sg.running_sum(d, ["_f"], ["_pos"], {"_days": F.col("_back")})
    d = parse_trip_name(d, "source_file")
    clock = F.unix_micros(F.to_timestamp(F.concat(F.col("date").cast("string"), F.lit(" "), F.col("time_str")), "yyyy-MM-dd HH:mm:ss.SSS"))
    d = d.withColumn("timestamp", F.timestamp_micros(clock + F.col("_days") * F.lit(86_400_000_000)))
    # one row per file, as many as the driver already lists
    ids = d.select("source_file").distinct().withColumn("trip_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_file")) - 1)
    d = d.join(ids, "source_file")
    return d.select(*[c for c in TRIP_SCHEMA.names if c != "time_str"], "timestamp", "source_file", "condition", "trip_id")


def load_weekly(spark: SparkSession, path: str, glob: str = "*_week.csv", columns: Sequence[str] = tuple(WEEKLY_HEADER)) -> DataFrame:
    """Weekly files by name pattern, only the used columns, our names.

    Header names select the columns of each file, so files may order them
    differently and carry more of them."""
    kinds = {n: T.LongType() if n in ("VehId", "Trip") else T.DoubleType() for n in columns}
    wanted = {n: WEEKLY_HEADER[n] for n in columns}
    return read_by_name(spark, path, kinds, wanted, glob, "weekly file").select(*wanted.values())


def load_static(*parts: tuple[DataFrame, str]) -> DataFrame:
    """Metadata tables whose engine-type column is named differently, as one;
    a vehicle in two of them is an error."""
    return assert_unique(concat(*[d.select(F.col("VehId").cast("long").alias("vehicle_id"), F.col(f"`{c}`").alias("engine_type")) for d, c in parts]), ["vehicle_id"])


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """S6."""
    return spark.read.parquet(path).select(*columns)


def sql_scan(spark: SparkSession, text: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """SQL with bound parameters over named tables."""
    return spark.sql(text, args=args or {}, **tables)


def jdbc_table(spark: SparkSession, url: str, table: str, partition: str | None = None, bounds: tuple | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A database table, read in parallel ranges of ``partition`` when given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition and bounds:
        r = r.options(partitionColumn=partition, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return r.load()


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A split manifest with our names and clean split labels."""
    d = spark.read.option("header", "true").csv(path)
    d = d.withColumnsRenamed({"VehId": "vehicle_id", "n_rows": "row_count"})
    missing = {"vehicle_id", "split"} - set(d.columns)
    if missing:
        raise ValueError(f"manifest lacks columns {sorted(missing)} (found {d.columns})")
    d = d.withColumn("vehicle_id", F.col("vehicle_id").cast("long")).withColumn("split", F.lower(F.trim("split")))
    return d.withColumn("row_count", F.col("row_count").cast("long")) if "row_count" in d.columns else d


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Sweep results with their types."""
    from roadlake.operators.volume import check_results

    d = check_results(spark.read.option("header", "true").csv(path))
    types = {f.name: f.dataType for f in SWEEP_RESULTS.fields}
    return d.select(*[F.col(c).cast(types[c]) if c in types else F.col(c) for c in d.columns])


def load_vehicle(pool: DataFrame, vehicle_id: int, key: str = "vehicle_id") -> DataFrame:
    """One vehicle (a pushed-down filter); an absent one is an error."""
    d = pool.where(F.col(key) == F.lit(vehicle_id))
    if not d.take(1):
        raise LookupError(f"vehicle not found: {vehicle_id}")
    return d


