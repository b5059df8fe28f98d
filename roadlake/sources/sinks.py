"""Stage outputs (K2-K4, U4)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_stage(df: DataFrame, path: str, *partition: str) -> None:
    """K2: Parquet per stage; ``partition`` makes one folder per split or date."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_pools(df: DataFrame, path: str) -> None:
    """U4: both engine-type pools in one job."""
    write_stage(df, path, "engine_type")


def write_table_csv(df: DataFrame, path: str) -> None:
    """K3: manifests and summaries as CSV with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_config(row: DataFrame, path: str) -> None:
    """K4: a one-row configuration as JSON."""
    row.write.mode("overwrite").json(path)
