"""Message sources: the two JSON topics, parsed, checked and routed (S8, ST1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake.functions.scalars import epoch_to_ts, no_nan
from roadlake.operators.cleaning import explode_pids
from roadlake.schemas import ACCELS, ANY_MESSAGE, PIDS, TOPIC_IMU, TOPIC_OBD

ENVELOPE = T.StructType([T.StructField("topic", T.StringType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def kafka_messages(spark: SparkSession, servers: str, **options: str) -> DataFrame:
    """Both topics from Kafka; the connector package comes with the cluster."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", f"{TOPIC_OBD},{TOPIC_IMU}")
    return r.options(**options).load().select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def file_messages(spark: SparkSession, path: str, files_per_trigger: int | None = 1000) -> DataFrame:
    """The same envelope from JSON-lines files dropped in a folder; without ``files_per_trigger`` a trigger takes all there are."""
    r = spark.readStream.schema(ENVELOPE)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).json(path)


def parse(messages: DataFrame) -> DataFrame:
    """Batch or stream: the payload as struct ``m`` and ``reject`` for bad ones.

    A payload is rejected when it is no JSON object or has no ``ts``; a field of
    the wrong type becomes null and the rest of the message is kept.
    """
    m = F.from_json("value", ANY_MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = messages.withColumn("m", m)
    broken = F.col("m").isNull() | (F.col("m.ts").isNull() & F.col("m._corrupt").isNotNull())
    other = ~F.coalesce(F.col("topic").isin(TOPIC_OBD, TOPIC_IMU), F.lit(False))
    return d.withColumn("reject", F.when(other, "unknown topic").when(broken, "unparseable").when(F.col("m.ts").isNull(), "no ts"))


def route(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(obd, imu, bad).  Advanced messages keep their core fields as OBD rows."""
    # A message of a known topic is rejected just where ``m.ts`` is null; said so, its filter parses the payload once.
    good = lambda topic: parsed.where((F.col("topic") == topic) & F.col("m.ts").isNotNull()).withColumn("time", epoch_to_ts("m.ts"))
    obd = good(TOPIC_OBD).select(F.col("key").alias("node_id"), "time", F.col("m.mode").alias("mode"), *[no_nan(f"m.{c}").alias(c) for c in PIDS])
    imu = good(TOPIC_IMU).select(F.col("key").alias("node_id"), "time", *[no_nan(f"m.{c}").alias(c) for c in ACCELS])
    return obd, imu, parsed.where("reject IS NOT NULL").select("topic", "key", "value", "reject")


def advanced(parsed: DataFrame) -> DataFrame:
    """ST6: swept signals of advanced messages, one row per signal."""
    d = parsed.where((F.col("reject").isNull()) & (F.col("topic") == TOPIC_OBD) & (F.col("m.mode") == "advanced") & F.col("m.all_pids").isNotNull())
    return explode_pids(d.select(F.col("key").alias("node_id"), epoch_to_ts("m.ts").alias("time"), F.col("m.all_pids").alias("all_pids")))


def to_messages(tel: DataFrame, obd: str, imu: str, node: str, ts: str = "time") -> DataFrame:
    """Telemetry rows as envelopes, nulls explicit; ``obd``/``imu`` say which rows make which."""
    opts = {"ignoreNullFields": "false"}
    t = (F.unix_micros(ts) / 1e6).alias("ts")
    o = F.to_json(F.struct(t, F.lit("normal").alias("mode"), *PIDS), opts)
    i = F.to_json(F.struct(t, *ACCELS), opts)
    both = F.array(F.when(F.expr(obd), F.struct(F.lit(TOPIC_OBD).alias("topic"), o.alias("value"))), F.when(F.expr(imu), F.struct(F.lit(TOPIC_IMU).alias("topic"), i.alias("value"))))
    d = tel.withColumn("_m", F.explode(F.array_compact(both)))
    return d.select("_m.topic", F.col(node).cast("string").alias("key"), "_m.value", ts)
