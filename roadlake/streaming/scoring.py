"""Causal features and scores of a live stream (ST10)."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadlake.operators.forest import Forest
from roadlake.streaming.run import use_rocksdb
from roadlake.streaming.slots import OrderedPages, Rows

#: Breaks ties of time, where the rows have it.
_TIE = "event_id"


class DeviationProcessor(StatefulProcessor):
    """Rolling-median deviations of one trip, as rows arrive and expire.

    State: ``slots`` holds the rows that wait for the watermark or lie in the
    window, by time slot; ``pages`` the window's values of each column in order
    (see :class:`OrderedPages`); ``done`` the trip's first time, how far rows are
    closed and expired, the slots and the directories of the pages.  A row is written once,
    read when the watermark closes it and read when it leaves the window.
    """

    def __init__(self, keys: Sequence[str], cols: Sequence[str], keep: Sequence[str], window_us: int, slot_us: int, peers: bool = False):
        self.keys, self.cols, self.keep, self.window, self.slot, self.peers = list(keys), list(cols), list(keep), window_us, slot_us, peers
        self.names = [n for n in dict.fromkeys([*cols, *keep]) if n != _TIE]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "rows binary")
        self.pages = handle.getMapState("pages", "column int, number long", "ordered binary")
        self.done = handle.getValueState("done", "first long, closed long, expired long, slots array<long>, pages string")

    def _state(self) -> tuple[int | None, int, int, list[int], list]:
        found = self.done.get() if self.done.exists() else None
        if not found:
            return None, -(2**62), -(2**62), [], [[] for _ in self.cols]
        return found[0], found[1], found[2], list(found[3]), json.loads(found[4])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, closed, expired, known, pages = self._state()
        newest, fresh = 0, {}
        for pdf in rows:
            part = Rows.of(self.names, pdf)
            newest = max(newest, int(part.us.max()))
            for slot, packed in part.by_slot(self.slot).items():
                fresh.setdefault(slot, []).append(packed)
        for slot, parts in fresh.items():
            held = bytes(self.slots.getValue((slot,))[0]) if slot in known else b""
            self.slots.updateValue((slot,), (b"".join([held, *parts]),))
        self.done.update((first, closed, expired, sorted({*known, *fresh}), json.dumps(pages)))
        self.handle.registerTimer((newest // 1_000_000 + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        first, closed, expired, known, directories = self._state()
        loaded: dict[int, Rows] = {}

        def slot(s: int) -> Rows:
            if s not in loaded:
                loaded[s] = Rows.unpack(self.names, [self.slots.getValue((s,))[0]])
            return loaded[s]

        due = [s for s in known if (s + 1) * self.slot > closed and s * self.slot < limit]
        parts = [slot(s).where((slot(s).us >= closed) & (slot(s).us < limit)) for s in due]
        ready = Rows(self.names, np.concatenate([p.words for p in parts])) if parts else None
        if ready is None or not len(ready.us):
            return
        first = int(ready.us[0]) if first is None else first
        ordered = [OrderedPages(d, lambda number, c=c: self.pages.getValue((c, number))[0]) for c, d in enumerate(directories)]
        index = [self.names.index(c) for c in self.cols]
        leaving = self._leaving(slot, known, expired)
        medians, out, last = np.empty((len(ready.us), len(self.cols))), next(leaving, None), expired
        for i, (us, row) in enumerate(zip(ready.us.tolist(), ready.values[:, index].tolist(), strict=True)):
            while out is not None and out[0] <= us - self.window:
                for c, v in enumerate(out[1]):
                    if v == v:
                        ordered[c].remove(v)
                last, out = out[0], next(leaving, None)
            last = max(last, us - self.window)
            for c, v in enumerate(row):
                if v == v:
                    ordered[c].insert(v)
            if not self.peers or i + 1 == len(ready.us) or ready.us[i + 1] != us:  # with peers, the last row of a time knows for all
                medians[i] = [o.median() for o in ordered]
        if self.peers:
            medians = medians[np.searchsorted(ready.us, ready.us, side="right") - 1]
        for c, o in enumerate(ordered):
            for number in o.gone:
                if any(number == d[2] for d in directories[c]):
                    self.pages.removeKey((c, number))
            for number, values in o.pages.items():
                self.pages.updateValue((c, number), (np.array(values).tobytes(),))
        for s in [s for s in known if (s + 1) * self.slot <= last]:
            self.slots.removeKey((s,))
            known.remove(s)
        self.done.update((first, limit, last, known, json.dumps([o.directory for o in ordered])))
        d = ready.frame().rename(columns={"rid": _TIE})
        for c, name in enumerate(self.cols):
            d[f"{name}_dev"] = d[name] - medians[:, c]
        for i, k in enumerate(self.keys):
            d.insert(i, k, key[i])
        yield d[d["us"] >= first + self.window][[*self.keys, "us", *self.keep, *[f"{c}_dev" for c in self.cols]]]

    def _leaving(self, slot, known: list[int], expired: int) -> Iterator[tuple[int, list[float]]]:
        """The rows of the window in order, from the first that has not expired."""
        index = [self.names.index(c) for c in self.cols]
        for s in list(known):
            if (s + 1) * self.slot > expired:
                rows = slot(s).where(slot(s).us > expired)
                yield from zip(rows.us.tolist(), rows.values[:, index].tolist(), strict=True)

    def close(self) -> None:
        pass


def deviation_stream(tel: DataFrame, keys: Sequence[str], cols: Sequence[str], keep: Sequence[str], window_s: float = 60, late_s: float = 2.0, time: str = "time", slot_s: float = 8.0,
                     peers: bool = False) -> DataFrame:
    """Rolling-median deviations of a stream, cold start trimmed.  With ``peers`` a row sees all rows of its own time, not only earlier ones."""
    use_rocksdb(tel.sparkSession)
    names = list(dict.fromkeys([*cols, *keep]))
    us = F.unix_micros(time)
    src = tel.withWatermark(time, f"{int(late_s * 1000)} milliseconds").select(
        *keys, time, us.alias("us"), (F.col(_TIE).cast("long") if _TIE in names else us).alias("rid"), *[F.col(c).cast("double").alias(c) for c in names if c != _TIE])
    p = DeviationProcessor(keys, cols, keep, int(window_s * 1e6), int(slot_s * 1e6), peers)
    out = T.StructType([src.schema[k] for k in keys] + [T.StructField("us", T.LongType())] + [T.StructField(c, T.LongType() if c == _TIE else T.DoubleType()) for c in keep]
                       + [T.StructField(f"{c}_dev", T.DoubleType()) for c in cols])
    d = src.groupBy(*keys).transformWithStateInPandas(p, out, "Append", "EventTime")
    return d.select(*keys, F.timestamp_micros("us").alias("time"), *keep, *[f"{c}_dev" for c in cols])


def score_stream(features: DataFrame, model: Forest, threshold: float) -> DataFrame:
    return model.score(features).withColumn("is_anomalous", F.col("score") < threshold)
