"""One-to-one nearest pairing as a stateful stream (ST2, ST3).

Rows wait in state until the watermark has passed them by the pairing window;
then the same matching rule as in the batch operator runs over them in time
order.  What the watermark closes is final, so stream and batch agree.

Rows reach the processor packed: every task of the input puts its rows of one key, side
and slot into one piece of bytes before they are dealt by key, since Spark hands a
processor row after row.

A key's rows wait in time slots, one state entry each.  A timer takes the slots the
watermark has closed and the few next to them that may hold a partner; slots that
are still to come are not read.

A row later than the watermark comes out at once, as a partial row marked late:
its time is settled, whether or not it had a partner.  Spark would drop such
rows before they reach the processor, so the time the watermark is taken from
does not go on to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadlake.operators.merge import WINDOW_S, match_nearest, merged_fields, merged_rows, tagged
from roadlake.schemas import ACCELS, PIDS
from roadlake.streaming.run import use_rocksdb
from roadlake.streaming.slots import Rows

_COLUMNS = {"obd": list(PIDS), "imu": list(ACCELS)}
#: Rows that a task of the input holds until it packs them, rows of one piece at most, and late rows put out at once.
_HELD, _PIECE, _LATE = 100_000, 4096, 50_000


class PairingProcessor(StatefulProcessor):
    """State of a key: ``slots`` (slot number -> waiting rows) and ``waiting``, the numbers of these slots."""

    def __init__(self, key_name: str, window_us: int, slot_us: int):
        self.key_name, self.window, self.slot = key_name, window_us, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "obd binary, imu binary")
        self.waiting = handle.getValueState("waiting", "slots array<long>")

    def _known(self) -> set[int]:
        found = self.waiting.get() if self.waiting.exists() else None
        return set(found[0]) if found else set()

    @staticmethod
    def _arrived(pdf: pd.DataFrame) -> Iterator[tuple[str, Rows]]:
        """The rows of each side, plain or packed."""
        if "packed" in pdf.columns:
            for kind, packed in zip(pdf["kind"], pdf["packed"], strict=True):
                yield kind, Rows.packed(_COLUMNS[kind], packed)
        else:
            for kind, columns in _COLUMNS.items():
                yield kind, Rows.of(columns, pdf[pdf["kind"] == kind])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        known, newest, fresh, tardy = self._known(), None, {}, {kind: [] for kind in _COLUMNS}
        for pdf in rows:
            for kind, part in self._arrived(pdf):
                late = part.us < closed
                if late.any():
                    tardy[kind].append(part.where(late).words)
                    if sum(map(len, tardy[kind])) >= _LATE:
                        yield self._partial(key, kind, tardy[kind])
                        tardy[kind] = []
                    part = part.where(~late)
                if len(part.us):
                    newest = max(newest or 0, int(part.us.max()))
                for slot, packed in part.by_slot(self.slot).items():
                    fresh.setdefault(slot, ([], []))[kind == "imu"].append(packed)
        for kind, words in tardy.items():
            if words:
                yield self._partial(key, kind, words)
        for slot, parts in fresh.items():
            held = self.slots.getValue((slot,)) if slot in known else (b"", b"")
            self.slots.updateValue((slot,), tuple(b"".join([bytes(h), *p]) for h, p in zip(held, parts, strict=True)))
        if newest is not None:
            self.waiting.update((sorted(known | set(fresh)),))
            # one timer per batch, when its newest row becomes final
            self.handle.registerTimer(((newest + 2 * self.window) // 1_000_000 + 1) * 1000)

    def _partial(self, key, kind: str, words: Sequence[np.ndarray]) -> pd.DataFrame:
        d = Rows(_COLUMNS[kind], np.concatenate(words)).frame().rename(columns={"rid": f"{kind}_id"})
        return self._finished(key, d, True)

    def _finished(self, key, d: pd.DataFrame, late: bool) -> pd.DataFrame:
        d = d.reindex(columns=["us", "obd_id", "imu_id", *PIDS, *ACCELS])
        d.insert(0, self.key_name, key[0])
        return d.assign(late=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000 - self.window
        known = self._known()
        # a row before the limit may pair with one up to a window after it
        near = sorted(s for s in known if s * self.slot <= limit + self.window)
        if not near:
            return
        held = [self.slots.getValue((s,)) for s in near]
        obd, imu = (Rows.unpack(_COLUMNS[kind], [h[n] for h in held]) for n, kind in enumerate(("obd", "imu")))
        ready = obd.us < limit
        used = np.zeros(len(imu.us), dtype=bool)
        partner = match_nearest(obd.us[ready], imu.us, used, self.window)
        lone = ~used & (imu.us < limit - self.window)
        rest = obd.where(~ready).by_slot(self.slot), imu.where(~used & ~lone).by_slot(self.slot)
        for s, (o, i) in zip(near, held, strict=True):
            left = rest[0].get(s, b""), rest[1].get(s, b"")
            if not any(left):
                self.slots.removeKey((s,))
                known.discard(s)
            elif (len(left[0]), len(left[1])) != (len(o), len(i)):
                self.slots.updateValue((s,), left)
        if known:
            self.waiting.update((sorted(known),))
        else:
            self.waiting.clear()
        out = merged_rows(obd.where(ready).frame(), imu.frame(), partner, lone)
        if len(out):
            yield self._finished(key, out, False)

    def close(self) -> None:
        pass


def _pack(key: str, slot_us: int):
    """Tagged rows to pieces of one key, side and slot."""

    def pieces(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        names = table.column(key).combine_chunks().dictionary_encode("encode")
        code, sides = names.indices.to_numpy(zero_copy_only=False), table.column("kind").to_numpy()
        least = np.iinfo(np.int64).min
        for kind, columns in _COLUMNS.items():
            mine = np.flatnonzero(sides == kind)
            if not len(mine):
                continue
            own, words = table.take(mine), np.empty((len(mine), 2 + len(columns)), np.int64)
            for i, c in enumerate(("us", "rid")):
                words[:, i] = own.column(c).fill_null(least).to_numpy()
            for i, c in enumerate(columns):
                words[:, 2 + i] = own.column(c).to_numpy().view(np.int64)
            of, slots = code[mine], words[:, 0] // slot_us
            order = np.lexsort((slots, of))
            of, slots, words = of[order], slots[order], words[order]
            begin = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (slots[1:] != slots[:-1])))
            end = np.append(begin[1:], len(of))
            cuts = [(a, min(a + _PIECE, z)) for x, z in zip(begin.tolist(), end.tolist(), strict=True) for a in range(x, z, _PIECE)]
            who = names.dictionary.take(pa.array(of[[a for a, _ in cuts]]))
            yield pa.RecordBatch.from_arrays([who, pa.array([kind] * len(cuts)), pa.array([words[a:z].tobytes() for a, z in cuts], pa.binary())], names=[key, "kind", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _HELD:
                yield from pieces(held)
                held = []
        if held:
            yield from pieces(held)

    return run


def merge_stream(obd: DataFrame, imu: DataFrame, key: str = "node_id", window_s: float = WINDOW_S, late_s: float = 2.0, time: str = "time", sequence: str | None = None,
                 slot_s: float = 8.0) -> DataFrame:
    """Merged rows of two streams.  ``late_s`` is how long a row may wait for its turn; one
    that comes later is a partial row with ``late`` set."""
    use_rocksdb(obd.sparkSession)
    # Rows of one time go by their sequence number where the messages carry one.
    with_id = lambda d: d.withColumn("_rid", F.col(sequence).cast("long") if sequence else F.unix_micros(time))
    src = tagged(with_id(obd), with_id(imu), [key], time, "_rid")
    names = src.columns
    src = src.withColumn("at", F.timestamp_micros("us")).withWatermark("at", f"{int(late_s * 1000)} milliseconds").select(*names)
    schema = T.StructType([src.schema[key], *merged_fields(), T.StructField("late", T.BooleanType())])
    processor = PairingProcessor(key, int(window_s * 1e6), int(slot_s * 1e6))
    packed = T.StructType([src.schema[key], T.StructField("kind", T.StringType()), T.StructField("packed", T.BinaryType())])
    done = src.mapInArrow(_pack(key, int(slot_s * 1e6)), packed).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return done.select(key, F.timestamp_micros("us").alias("time"), *PIDS, *ACCELS, "late")


def stored(merged: DataFrame) -> DataFrame:
    """K1: merged rows as they are appended, with the date they are partitioned by."""
    return merged.withColumn("date", F.to_date("time"))


def counted(merged: DataFrame, name: str = "merge") -> DataFrame:
    """The same rows, with the numbers of all and of late ones in the metrics of every trigger."""
    return merged.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("late")).alias("late"))


def append_telemetry(merged: DataFrame, path: str, checkpoint: str, every: str = "1 second", partition: Sequence[str] = ("date",)):
    """K1: the running ingest query, one append per trigger."""
    return (stored(merged).writeStream.format("parquet").partitionBy(*partition).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(processingTime=every).start(path))
