"""Session settings, the shared workspace folder and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_WORKSPACE_KEY = "spark.checkpoint.dir"
_roots: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app: str = "roadlake", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; safe to call many times."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Rows may be long texts: a Python worker holds a few batches at a time.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that functions
    of it can be unpickled where the package is not installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="roadlake-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "roadlake_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(home):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("roadlake", os.path.relpath(full, home)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh path for a written intermediate table.

    It lies in a folder of this application under the cluster's shared
    checkpoint folder (``spark.checkpoint.dir``, or the folder set on the
    context), which outlives any executor and goes when the driver ends. Without
    one, only a local master gets a temporary folder; on a cluster it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = _new_root(spark, app)
    return f"{_roots[app]}/{label}-{uuid.uuid4().hex}"


def _new_root(spark: SparkSession, app: str) -> str:
    shared = spark.conf.get(_WORKSPACE_KEY, None)
    if not shared:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = named.get() if named.isDefined() else None
    if shared:
        root = f"{shared.rstrip('/')}/roadlake-{app}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_WORKSPACE_KEY} to a folder that the driver and all executors share (master {master})")
    root = tempfile.mkdtemp(prefix="roadlake-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def materialize(df, label: str):
    """Write ``df`` to the workspace and read it back: cuts the lineage with a
    reliable copy, so that a multi-pass operator evaluates its input once."""
    spark = df.sparkSession
    path = workspace(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
