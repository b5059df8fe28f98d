"""The one-minute rollup kept up to date by a stream (ST4, ST5).

The stored rollup is a folder of written parts and, per date, a manifest that
names the parts that count, oldest first, and the last epoch of every stream
that wrote.  A part holds the buckets one micro-batch changed; of a bucket in
several parts the last commit counts.  A manifest is replaced by a rename, so a
reader sees a commit wholly or not at all, and a restarted stream, whose epochs
begin again, goes on after what is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.operators.rollup import measures

#: Parts of a date that are folded into one when they are this many.
PARTS = 8


def rollup_stream(tel: DataFrame, lookback: str = "1 hour", time: str = "time") -> DataFrame:
    """Minute buckets that change while within the look-back (update mode)."""
    g = tel.withWatermark(time, lookback).groupBy(F.window(time, "1 minute").alias("_w")).agg(*measures())
    return g.select(F.col("_w.start").alias("bucket"), *[c for c in g.columns if c != "_w"])


def bucket_writer(path: str, stream: str | None = None, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: one write of the changed buckets by date, then one commit per date.

    ``stream`` names the writer; by default it is the running query's id, which its
    checkpoint keeps.  An epoch that a date's manifest already holds is not
    committed again, so a retried batch is harmless, also one that failed
    between two dates.  A new checkpoint is a new stream: its buckets replace
    the stored ones, so it must read the whole of the minutes it touches.  One
    writer at a time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = RollupTable(spark, path, parts)
        name = stream or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        table.commit(batch, name, batch_id)

    return write


class RollupTable:
    """A stored rollup: its parts under ``data``, its manifests under ``manifest``."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(self._conf)

    # -- writing

    def commit(self, changed: DataFrame, stream: str, epoch: int) -> None:
        """Store changed buckets as one part per date."""
        home = self._written(f"{stream}-{epoch}")  # by an attempt that failed later
        if home is None:
            home = self._write(changed, f"{stream}-{epoch}")
        full, dates = [], self._dates(home)
        for date in dates:
            m = self.manifest(date)
            if m["epochs"].get(stream, -1) >= epoch:
                continue
            m["parts"].append(f"{home}/date={date}")
            m["epochs"][stream] = epoch
            self._swap(date, m)
            if len(m["parts"]) >= self.parts:
                full.append(date)
        if full:
            self.fold(full)
        if not dates:
            self.fs.delete(self._at(home), True)

    def fold(self, dates: Sequence[str]) -> None:
        """Fold the parts of these dates into one each, in one write.  Parts that a
        reader may still hold stay until the date is folded the next time."""
        held = {d: self.manifest(d) for d in dates}
        home = self._write(self._newest([p for m in held.values() for p in m["parts"]]), f"folded-{uuid.uuid4().hex}")
        for date, m in held.items():
            self._swap(date, m | {"parts": [f"{home}/date={date}"], "retired": m["parts"]})
            for part in m["retired"]:
                self.fs.delete(self._at(part), True)
                if not self._dates(part.rpartition("/")[0]):
                    self.fs.delete(self._at(part.rpartition("/")[0]), True)

    def _write(self, rows: DataFrame, name: str) -> str:
        """Write rows by date into a new folder; its number, in the rows too, is above all there are."""
        order = max((int(h.split("-")[0]) for h in self._names("data")), default=0) + 1
        home = f"data/{order:09d}-{name}"
        dated = rows.withColumns({"date": F.coalesce(F.to_date("bucket").cast("string"), F.lit("none")), "_order": F.lit(order).cast("long")})
        dated.write.mode("overwrite").partitionBy("date").parquet(f"{self.path}/{home}")
        return home

    def _written(self, name: str) -> str | None:
        homes = [f"data/{h}" for h in self._names("data") if h.partition("-")[2] == name]
        return next((h for h in sorted(homes) if self.fs.exists(self._at(f"{h}/_SUCCESS"))), None)

    def _swap(self, date: str, manifest: dict) -> None:
        """Replace a manifest: written beside, then renamed over the old one."""
        jvm = self.spark.sparkContext._jvm
        beside, target = self._at(f"manifest/.{uuid.uuid4().hex}"), self._at(f"manifest/date={date}.json")
        out = self.fs.create(beside, True)
        out.write(bytearray(json.dumps(manifest | {"date": date}).encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        context.rename(beside, target, over)

    # -- reading

    def manifest(self, date: str) -> dict:
        p = self._at(f"manifest/date={date}.json")
        if not self.fs.exists(p):
            return {"date": date, "parts": [], "retired": [], "epochs": {}}
        stream = self.fs.open(p)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def current(self, dates: Sequence[str] | None = None) -> DataFrame:
        """The stored buckets of some dates, of all without."""
        pattern = "date=*.json" if dates is None else "{" + ",".join(f"date={d}.json" for d in dates) + "}"
        manifests = self.spark.read.schema("date string, parts array<string>").json(f"{self.path}/manifest/{pattern}")
        return self._newest([p for r in manifests.collect() for p in r["parts"]])

    def _newest(self, parts: list[str]) -> DataFrame:
        """Of every bucket the row that was committed last among the given parts."""
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{p}" for p in parts])
        values = [c for c in rows.columns if c not in ("_order", "bucket")]
        g = rows.groupBy("bucket").agg(F.max_by(F.struct(*values), "_order").alias("_r"))
        return g.select("bucket", "_r.*")

    def _names(self, folder: str) -> list[str]:
        p = self._at(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def _dates(self, home: str) -> list[str]:
        return sorted(n.removeprefix("date=") for n in self._names(home) if n.startswith("date="))

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")


def current_rollup(spark: SparkSession, path: str, dates: Sequence[str] | None = None) -> DataFrame:
    """The stored rollup as of the last commits."""
    return RollupTable(spark, path).current(dates)
