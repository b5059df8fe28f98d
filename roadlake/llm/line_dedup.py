"""Line dedup with two Bloom filters.

One filter takes the line hashes seen once, the other those seen again. Each task gathers the positions of
its own lines, several for each line; they travel as segments, so that what moves is a few bytes per distinct
line, and the segments of all tasks are merged into one pair. Only lines in the second filter are suspected
repeats: they alone shuffle, with their text, for exact confirmation (counts of documents) and the choice of
the occurrence that stays. The filters grow with a bound on the number of lines, counted first, up to
``MOST_BITS``, which bounds what is broadcast; beyond it they fill up, more lines are suspected and shuffled,
and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.llm import words as W
from roadlake.llm.base import column, materialize, steps, utf8

MIN_CHARS, MIN_DOCS = 40, 5
#: Hash functions; bits of a filter for each line, and at most (64 MB); a segment is 2**16 bits.
HASHES, BITS_PER_LINE, MOST_BITS = 3, 8, 1 << 29
_SEGMENT = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all lines, and the first line of each text (with the end)."""
    breaks = np.flatnonzero(data == 10)
    ends = np.insert(breaks, np.searchsorted(breaks, off[1:]), off[1:])
    count = np.diff(np.searchsorted(breaks, off)) + 1
    first = np.append(0, np.cumsum(count))
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    starts[first[:-1]] = off[:-1]
    return starts, ends, first


class Keys:
    """The keys of all lines of a batch: trimmed byte ranges in lower-cased text, and which are long enough."""

    def __init__(self, data: np.ndarray, off: np.ndarray, min_chars: int):
        self.data = _LOWER[data]
        self.line_start, self.line_end, self.first = _lines(data, off)
        n = len(data)
        word = W._WORD[data]
        at = np.arange(n, dtype=np.int64)
        following = np.append(np.minimum.accumulate(np.where(word, at, n)[::-1])[::-1], n)
        preceding = np.append(-1, np.maximum.accumulate(np.where(word, at, -1)))
        start = np.minimum(following[self.line_start], self.line_end)
        end = np.maximum(preceding[self.line_end] + 1, start)
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        self.start, self.end = start, end
        self.long = np.flatnonzero(chars[end] - chars[start] >= min_chars)
        sums = W.Sums(W._BYTE[self.data], 0)
        self.hash = sums.hash(start[self.long], end[self.long])
        self.row = np.searchsorted(self.first, self.long, "right") - 1


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """One row of positions for each hash function."""
    step = W.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
    turns = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((hashes + turns * step) & np.uint64(bits - 1)).astype(np.int64)


def _fill(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, docs, held, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            """The distinct lines so far and in how many documents each stands."""
            fresh = np.concatenate([lines[:0], *held])
            all_, back = np.unique(np.append(lines, fresh), return_inverse=True)
            return all_, np.bincount(back, np.append(docs, np.ones(len(fresh), np.int64)), len(all_)).astype(np.int64)

        for batch in steps(batches):
            k = Keys(*utf8(column(batch, "text")), min_chars)
            # A document counts once: repeats inside it suspect nothing.
            own = k.hash[np.unique(W.mix(k.hash) ^ W.mix(k.row.astype(np.uint64)), return_index=True)[1]]
            held.append(own)
            waiting += len(own)
            if waiting > max(len(lines), 1 << 18):
                lines, docs = folded()
                held, waiting = [], 0
        lines, docs = folded()
        once = np.unique(_positions(lines, bits))
        again = np.unique(_positions(lines[docs > 1], bits))
        touched = np.unique(once // _SEGMENT)
        cuts, more = (np.searchsorted(z, np.append(touched, touched[-1:] + 1) * _SEGMENT) for z in (once, again))
        for i, s in enumerate(touched.tolist()):
            seen, twice = ((z[c[i] : c[i + 1]] - s * _SEGMENT).astype("<u2").tobytes() for z, c in ((once, cuts), (again, more)))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([seen], pa.binary()), pa.array([twice], pa.binary())], names=["segment", "once", "again"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order, any number of rows of each, to the merged second filter of each segment."""
    at, once, again = None, np.zeros(_SEGMENT, bool), np.zeros(_SEGMENT, bool)

    def row():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.flatnonzero(again).astype("<u2").tobytes()], pa.binary())], names=["segment", "again"])

    for batch in batches:
        for s, x, y in zip(column(batch, "segment").to_pylist(), column(batch, "once").to_pylist(), column(batch, "again").to_pylist(), strict=True):
            if at is not None and s != at:
                if again.any():
                    yield row()
                once[:], again[:] = False, False
            at = s
            x = np.frombuffer(x, "<u2")
            again[x[once[x]]] = True
            again[np.frombuffer(y, "<u2")] = True
            once[x] = True
    if at is not None and again.any():
        yield row()


def filter_bits(docs: DataFrame, min_chars: int = MIN_CHARS) -> int:
    """Bits of a filter for all lines that may be long enough: no more than the breaks of a text allow, nor its length."""
    length = F.length("text")
    most = F.least(length - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.floor((length + 1) / (min_chars + 1)))
    lines = docs.agg(F.sum(most)).first()[0] or 0
    return min(MOST_BITS, max(1 << 20, 1 << int(BITS_PER_LINE * lines).bit_length()))


def repeat_filter(docs: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> np.ndarray:
    """The filter of line hashes seen in two documents or more, packed (bits / 8 bytes)."""
    width = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = docs.select("text").mapInArrow(_fill(bits, min_chars), "segment int, once binary, again binary")
    merged = parts.repartition(width, "segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, again binary")
    out, one = np.zeros((bits // _SEGMENT, _SEGMENT // 8), np.uint8), np.zeros(_SEGMENT, bool)
    for r in merged.toLocalIterator():
        one[:] = False
        one[np.frombuffer(r["again"], "<u2")] = True
        out[r["segment"]] = np.packbits(one, bitorder="little")
    return out.ravel()


def _suspects(shared, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in steps(batches):
            k = Keys(*utf8(column(batch, "text")), min_chars)
            at = _positions(k.hash, bits)
            hit = np.flatnonzero((packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0))
            line, row = k.long[hit], k.row[hit]
            raw = k.data.tobytes()
            keys = [raw[a:b] for a, b in zip(k.start[line].tolist(), k.end[line].tolist(), strict=True)]
            ids, own = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row_key"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row], pa.int64()), pa.array(own[row], pa.int64()), pa.array((line - k.first[row]).astype(np.int32)), pa.array(keys, pa.binary()).cast(pa.string())],
                names=["doc_id", "row_key", "line", "key"])

    return run


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None) -> DataFrame:
    """(doc_id, row_key, lines): the numbers of the lines to drop, from 0, for each text that loses some."""
    kept = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    bits = filter_bits(kept, min_chars) if bits is None else bits
    shared = docs.sparkSession.sparkContext.broadcast(repeat_filter(kept, bits, min_chars))
    found = kept.mapInArrow(_suspects(shared, bits, min_chars), "doc_id long, row_key long, line int, key string")
    # A 128-bit name for the key is what is stored and joined; the text itself is not needed twice.
    found = materialize(found.select("doc_id", "row_key", "line", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2")), "line-suspects")
    holders = found.select("k1", "k2", "doc_id").distinct()
    repeated = materialize(holders.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("stays")).filter(F.col("docs") >= min_docs), "line-repeats")
    lost = found.join(repeated, ["k1", "k2"]).filter("doc_id < stays")
    return lost.groupBy("doc_id", "row_key").agg(F.collect_set("line").alias("lines"))


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        data, off = utf8(column(batch, "text"))
        starts, ends, first = _lines(data, off)
        lines = column(batch, "lines")
        count = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        gone = np.zeros(len(starts), bool)
        gone[np.repeat(first[:-1], count) + lines.flatten().to_numpy(zero_copy_only=False)] = True
        raw, kept = data.tobytes(), []
        for i in range(batch.num_rows):
            if not count[i]:
                kept.append(raw[off[i] : off[i + 1]])
                continue
            live = first[i] + np.flatnonzero(~gone[first[i] : first[i + 1]])
            kept.append(b"\n".join([raw[a:b] for a, b in zip(starts[live].tolist(), ends[live].tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").cast(pa.int64()), pa.array(np.diff(first).astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped and ``kept``, the lines left joined by \\n.

    A key (the line trimmed and A-Z lower-cased) of at least ``min_chars`` code points in at least
    ``min_docs`` documents keeps its lines in its largest doc_id only. Null and empty texts have one
    empty line. Rows without doc_id count for nothing and lose nothing; rows that share a doc_id are one
    document.
    """
    lines = repeated_lines(docs, min_chars, min_docs, bits)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    joined = keyed.join(lines, ["doc_id", "row_key"], "left").select("doc_id", "text", "lines")
    return joined.mapInArrow(_drop, "doc_id long, n_lines long, n_dropped long, kept string")


#: DuckDB: whole tables, plain windows.
SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS nr FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS stays FROM k WHERE len(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, k.line, k.nr, r.stays IS NOT NULL AND k.doc_id < r.stays AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id
"""
