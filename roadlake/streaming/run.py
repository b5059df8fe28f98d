"""Starting streaming queries: state store, checkpoints, bounded runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from roadlake.session import workspace

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def drain(query) -> None:
    """Let a running query take all there is, then stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def drain_to_parquet(stream: DataFrame, label: str, checkpoint: str | None = None, partition: tuple[str, ...] = (), arrivals: Iterable = (None,)) -> DataFrame:
    """Process what is available into a Parquet table and read it back; with ``arrivals`` anew after each of its steps."""
    spark = stream.sparkSession
    path, checkpoint = workspace(spark, label), checkpoint or workspace(spark, label + "-ckpt")
    for _ in arrivals:
        w = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        q = (w.partitionBy(*partition) if partition else w).outputMode("append").trigger(availableNow=True).start(path)
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_each(stream: DataFrame, fn: Callable[[DataFrame, int], None], label: str, mode: str = "append", checkpoint: str | None = None, arrivals: Iterable = (None,)) -> None:
    """Process what is available, one call of ``fn`` per micro-batch; with ``arrivals`` anew after each of its steps."""
    checkpoint = checkpoint or workspace(stream.sparkSession, label + "-ckpt")
    for _ in arrivals:
        q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
