"""Substring dedup by hash joins of blocks and windows, in place of a relative Lempel-Ziv parse.

Every text is cut into overlapping *reference blocks* at content-selected anchors: all windows of
``window`` words that select one anchor form a block. The index holds each distinct block with the
smallest document that has it; a block found in an earlier document is taken whole. Of the other blocks
whose anchor also occurs in other surroundings, single windows are looked up in an index of the windows
of just such blocks. No text is factored from left to right and no match is extended: words under a found
block or window are duplicate. Equal windows select equal anchors, so nothing is missed: a word is removed
exactly if one of the windows over it also starts in a document with a smaller doc_id.

Blocks and windows are compared by 128-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.llm import words as W
from roadlake.llm.base import column, materialize, release, row_key, steps, utf8

WINDOW, SEED = 50, 10
_RUNS = "doc_id long, row_key long, start int, count int, seed long, h1 long, h2 long"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", row_key().alias("row_key"))


def _runs(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, off = utf8(column(batch, "text"))
            s = W.Selected(data, off, window, seed)
            ids = column(batch, "doc_id").to_numpy(zero_copy_only=False)
            keys = column(batch, "row_key").to_numpy(zero_copy_only=False)
            h1, h2 = s.stretch(s.start, s.start + s.count + (window - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[s.row], pa.int64()), pa.array(keys[s.row], pa.int64()), pa.array((s.start - s.first[s.row]).astype(np.int32)),
                 pa.array(s.count.astype(np.int32)), pa.array(s.seed.view(np.int64)), pa.array(h1), pa.array(h2)],
                names=["doc_id", "row_key", "start", "count", "seed", "h1", "h2"])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, off = utf8(column(batch, "text"))
            starts, ends, first = W.find(data, off)
            w = W.hashes(data, starts, ends)
            a, b = W.Sums(w, 1), W.Sums(W.mix(w ^ np.uint64(0xA0761D6478BD642F)), 2)
            runs = column(batch, "runs")
            row = np.repeat(np.arange(batch.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
            flat = runs.flatten()
            start, count = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            row = np.repeat(row, count)
            rel = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            at = rel + first[row]
            ids = column(batch, "doc_id").to_numpy(zero_copy_only=False)
            keys = column(batch, "row_key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row], pa.int64()), pa.array(keys[row], pa.int64()), pa.array(rel.astype(np.int32)),
                 pa.array(a.hash(at, at + window).view(np.int64)), pa.array(b.hash(at, at + window).view(np.int64))],
                names=["doc_id", "row_key", "start", "h1", "h2"])

    return run


def duplicate_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, spans): per text, the word ranges [from, to) that earlier documents have.

    Null texts and texts of fewer than ``window`` words have none. Rows without doc_id neither have
    spans nor serve as reference. Rows that share a doc_id are one document as a reference and are
    told apart by ``row_key``, a hash of the text.
    """
    kept = _keyed(docs).filter(F.col("doc_id").isNotNull())
    runs = materialize(kept.mapInArrow(_runs(window, seed), _RUNS), "rlz-runs")
    block = ["seed", "h1", "h2"]
    index = materialize(runs.groupBy(*block).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "rlz-index")
    release(docs.sparkSession)
    held = runs.join(index.filter("n > 1").select(*block, "first_doc"), block, "left")
    unsettled = index.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed", F.lit(True).alias("unsettled"))
    settled = F.coalesce(F.col("first_doc") < F.col("doc_id"), F.lit(False))
    held = held.select("doc_id", "row_key", "start", "count", "seed", settled.alias("settled")).join(unsettled, "seed", "left").filter("settled or unsettled")
    # Written, so that the shuffles of the blocks are gone before the texts come.
    held = materialize(held.select("doc_id", "row_key", "start", "count", "settled"), "rlz-held")
    release(docs.sparkSession)
    whole = held.filter("settled").select("doc_id", "row_key", "start", (F.col("start") + F.col("count") + (window - 1)).alias("end"))
    by_text = held.filter("not settled").groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    texts = kept.join(by_text, ["doc_id", "row_key"])
    single = materialize(texts.mapInArrow(_windows(window), "doc_id long, row_key long, start int, h1 long, h2 long"), "rlz-windows")
    release(docs.sparkSession)
    first = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc")
    seen = single.join(first, ["h1", "h2"]).filter("first_doc < doc_id").select("doc_id", "row_key", "start", (F.col("start") + window).alias("end"))
    return whole.unionByName(seen).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _covered(spans: pa.Array, first: np.ndarray, n_words: int) -> np.ndarray:
    """Which words of the batch lie in a span of their text."""
    spans = spans.cast(pa.list_(spans.type.value_type))
    lengths = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    base = np.repeat(first[:-1], lengths)
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, base + flat.field(0).to_numpy(zero_copy_only=False), 1)
    np.add.at(change, base + flat.field(1).to_numpy(zero_copy_only=False), -1)
    return np.cumsum(change[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        data, off = utf8(column(batch, "text"))
        starts, ends, first = W.find(data, off)
        gone = _covered(column(batch, "spans"), first, len(starts))
        raw, kept = data.tobytes(), []
        for i in range(batch.num_rows):
            a, b = first[i], first[i + 1]
            live = a + np.flatnonzero(~gone[a:b])
            kept.append(b" ".join([raw[x:y] for x, y in zip(starts[live].tolist(), ends[live].tolist(), strict=True)]))
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) * (np.diff(first) > 0)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").cast(pa.int64()), pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"])


def remove_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and ``kept``, the words left joined by one space.

    Nulls and empty texts have zero words and an empty ``kept``; other columns are not looked at.
    """
    spans = materialize(duplicate_spans(docs, window, seed), "rlz-spans")
    release(docs.sparkSession)
    joined = _keyed(docs).join(spans, ["doc_id", "row_key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")
