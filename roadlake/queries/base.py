"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake import fixtures as fx


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every floating column, so that sums in another order compare equal."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip:
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def joined(spark, sf_dir: str) -> DataFrame:
    from roadlake.plans import intervals as iv

    return iv.session_rows(fx.telemetry(spark, sf_dir), fx.sessions(spark, sf_dir), fx.NOW)
