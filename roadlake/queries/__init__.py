"""Registered queries: name -> (DataFrame function, DuckDB text or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = ["sessions", "quality", "features", "splits", "anomaly", "streams", "mounting", "loading"]


def catalog() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for m in _MODULES:
        for name, pair in importlib.import_module(f"roadlake.queries.{m}").QUERIES.items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = pair
    return out
