"""Suffix-array dedup with sparse suffix arrays.

Of all suffixes only those at content-selected minimiser positions are kept: any passage of ``window``
words holds one of them at the same place wherever it occurs. Suffixes whose first words occur once in the
corpus drop out by a count. The others are sorted by the words that follow, and again by those that precede,
and neighbours' common words are counted in both orders. Suffixes that share a passage of ``window`` words over
their place lie in one interval of each order, whichever documents lie between them; each pair of intervals is
a class, and its larger doc_ids repeat the smallest. All splits of the window into left and right are gone through.

Suffixes that share their first words are one group of the sort. A group that is too large for a task is
dealt out by what follows: of suffixes in the same surroundings the smallest document's stands for all, and
those left give their windows to be compared by hash with all others of the group, wherever these were dealt.
Equal windows select equal anchors, so this finds the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.llm import words as W
from roadlake.llm.base import column, materialize, ragged, row_key, steps, utf8

WINDOW, SEED = 50, 10
#: Bytes of a word's hash that travel and are compared.
WORD_BYTES = 6
#: Suffixes of one sorted group at most.
GROUP = 4000
_SUFFIXES = "doc_id long, row_key long, place int, seed long, before short, windows short"
_CONTEXTS = "seed long, cut int, hot boolean, before short, windows short, doc_id long, row_key long, place int, again array<int>, n_right int, n_left int, following binary, preceding binary"

_FOUND = "doc_id long, row_key long, start int, end int, h1 long, h2 long"


def _suffixes(window: int, seed: int):
    """Suffixes at the anchors; ``windows`` windows select one, of which the first begins ``before`` words before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            s = W.Selected(*utf8(column(batch, "text")), window, seed)
            ids, keys = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row_key"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[s.row], pa.int64()), pa.array(keys[s.row], pa.int64()), pa.array((s.anchor - s.first[s.row]).astype(np.int32)), pa.array(s.seed.view(np.int64)),
                 pa.array((s.anchor - s.start).astype(np.int16)), pa.array(s.count.astype(np.int16))],
                names=["doc_id", "row_key", "place", "seed", "before", "windows"])

    return run


def _packed(words: np.ndarray) -> list[bytes]:
    """Rows of 48-bit words as bytes that sort like them."""
    return [r.tobytes() for r in np.ascontiguousarray(words.astype(">u8")).view(np.uint8).reshape(*words.shape, 8)[:, :, 2:]]


def _unpacked(rows: list[bytes], width: int) -> np.ndarray:
    words = np.zeros((len(rows), width, 8), np.uint8)
    words[:, :, 2:] = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), width, WORD_BYTES)
    return words.view(">u8")[:, :, 0].astype(np.uint64)


def _contexts(window: int, seed: int):
    """Each suffix with the words that follow and precede it, as 6-byte hashes in reading order from it. Places
    of a text in the same surroundings are one row: ``again`` lists the distances of the others from the first."""
    reach = window - seed
    odd = np.random.default_rng(7).integers(0, 2**63, window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            starts, ends, first = W.find(*(data_off := utf8(column(batch, "text"))))
            words = np.append(W.hashes(data_off[0], starts, ends) >> np.uint64(16), np.zeros(1, np.uint64))
            lists = column(batch, "suffixes")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            place, code, cuts, before, windows = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            at, none = first[row] + place, len(words) - 1
            n_right = np.minimum(first[row + 1] - at, window).astype(np.int32)
            n_left = np.minimum(place, reach).astype(np.int32)
            right = at[:, None] + np.arange(window)
            right = words[np.where(np.arange(window) < n_right[:, None], right, none)]
            left = at[:, None] - 1 - np.arange(reach)
            left = words[np.where(np.arange(reach) < n_left[:, None], left, none)]
            alike = W.mix(right @ odd[:window] ^ W.mix(left @ odd[:reach] + row.astype(np.uint64) * np.uint64(2**40)))
            _, one, member = np.unique(alike, return_index=True, return_inverse=True)
            order = np.lexsort((place, member))
            size = np.bincount(member, minlength=len(one))
            again = [p - p[0] for p in np.split(place[order], np.cumsum(size)[:-1])] if len(one) else []
            one = order[np.cumsum(size) - size]
            place, code, cuts, before, windows, row, right, left, n_right, n_left = (x[one] for x in (place, code, cuts, before, windows, row, right, left, n_right, n_left))
            cut = (W.mix(right @ odd[:window]) % cuts.astype(np.uint64)).astype(np.int32)
            ids, keys = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row_key"))
            raw = [pa.array(_packed(part), pa.binary()) for part in (right, left)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(code, pa.int64()), pa.array(cut), pa.array(cuts > 1), pa.array(before, pa.int16()), pa.array(windows, pa.int16()), pa.array(ids[row], pa.int64()), pa.array(keys[row], pa.int64()), pa.array(place.astype(np.int32)),
                 pa.array(again, pa.list_(pa.int32())), pa.array(n_right), pa.array(n_left), *raw],
                names=["seed", "cut", "hot", "before", "windows", "doc_id", "row_key", "place", "again", "n_right", "n_left", "following", "preceding"])

    return run


def _common(order: np.ndarray, words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Words that each row of ``order`` has in common with the row before it, from the beginning; -1 in another group."""
    differ = words[order[1:]] != words[order[:-1]]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    return np.append(-1, np.where(group[order[1:]] == group[order[:-1]], n, -1))


def _compare(rows: pa.Table, window: int, reach: int) -> pa.RecordBatch:
    """Spans that repeat an earlier document, from whole groups in sorted order.

    Rows share a window that has ``k`` words before the place if they lie in one interval of the order by
    following words, where neighbours have window - k words in common, and in one of the order by preceding
    words, where they have k. The smallest document of such a class keeps the window.
    """
    n = rows.num_rows
    doc, keys, place, seed, n_right, n_left = (rows[c].to_numpy() for c in ("doc_id", "row_key", "place", "seed", "n_right", "n_left"))
    preceding = rows["preceding"].to_pylist()
    right, left = _unpacked(rows["following"].to_pylist(), window), _unpacked(preceding, reach)
    group = np.cumsum(np.append(0, seed[1:] != seed[:-1]))
    codes = np.unique(np.frombuffer(b"".join(preceding), f"S{WORD_BYTES * reach}"), return_inverse=True)[1]
    turn = np.lexsort((codes, group))
    after, before = _common(np.arange(n), right, group), _common(turn, left, group)
    # The most words that a row shares with any other on either side: what reaches no window needs no look.
    most_right, most_left = np.maximum(after, np.append(after[1:], -1)), np.empty(n, np.int64)
    most_left[turn] = np.maximum(before, np.append(before[1:], -1))
    most_right, most_left = np.minimum(most_right, n_right), np.minimum(most_left, n_left)
    hits = []
    for k in range(reach + 1):
        live = np.flatnonzero((most_left >= k) & (most_right >= window - k))
        if len(live) < 2:
            continue
        kin = np.empty(n, np.int64)
        kin[turn] = np.cumsum(before < k)
        both = np.cumsum(after < window - k)[live] * (n + 1) + kin[live]
        order = np.argsort(both, kind="stable")
        live, both = live[order], both[order]
        head = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        least = np.repeat(np.minimum.reduceat(doc[live], head), np.diff(np.append(head, len(live))))
        repeats = live[least < doc[live]]
        hits.append(np.stack([repeats, np.full(len(repeats), k)]))
    i, k = np.concatenate([np.zeros((2, 0), np.int64), *hits], axis=1)
    # Windows that begin side by side are one span.
    order = np.lexsort((k, i))
    i, k = i[order], k[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i))[: len(first)] - 1
    starts, ends, i = place[i[first]] - k[last], place[i[first]] - k[first] + window, i[first]
    again = rows["again"].combine_chunks()
    flat, off = again.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(again.value_lengths().to_numpy(zero_copy_only=False)))
    times = np.diff(off)[i]
    shift = flat[ragged(off[i], times)]
    i, starts, ends = np.repeat(i, times), np.repeat(starts, times) + shift, np.repeat(ends, times) + shift
    return _found(pa.array(doc[i], pa.int64()), pa.array(keys[i], pa.int64()), starts, ends)


def _found(doc: pa.Array, keys: pa.Array, starts: np.ndarray, ends: np.ndarray, h1: np.ndarray | None = None, h2: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of ``_FOUND``: spans that repeat an earlier document or, with hashes, windows still to be compared."""
    hashes = [pa.nulls(len(doc), pa.int64()) if h is None else pa.array(h.view(np.int64)) for h in (h1, h2)]
    return pa.RecordBatch.from_arrays([doc, keys, pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32)), *hashes], names=["doc_id", "row_key", "start", "end", "h1", "h2"])


def _windows(part: pa.RecordBatch, window: int, reach: int) -> pa.RecordBatch:
    """The windows that select the places of ``part``, with 128 bits of hash each."""
    right, left = _unpacked(column(part, "following").to_pylist(), window), _unpacked(column(part, "preceding").to_pylist(), reach)
    around = W.mix(np.concatenate([left[:, ::-1], right], axis=1) + np.uint64(1))
    odd = np.random.default_rng(11).integers(0, 2**63, (window, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    place, before, windows = (column(part, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "before", "windows"))
    row, ahead, codes = [], [], []
    for k in range(reach + 1):
        own = np.flatnonzero((k <= before) & (k > before - windows))
        row.append(own)
        ahead.append(np.full(len(own), k))
        codes.append(W.mix(around[own, reach - k : reach - k + window] @ odd))
    row, ahead, codes = np.concatenate(row), np.concatenate(ahead), np.concatenate(codes)
    again = column(part, "again")
    times = again.value_lengths().to_numpy(zero_copy_only=False)
    off = np.cumsum(times) - times
    k = np.repeat(np.arange(len(row)), times[row])
    start = (place[row] - ahead)[k] + again.flatten().to_numpy(zero_copy_only=False)[ragged(off[row], times[row])]
    at = pa.array(row[k])
    return _found(column(part, "doc_id").take(at), column(part, "row_key").take(at), start, start + window, codes[k, 0], codes[k, 1])


def _spans(batch: pa.RecordBatch, pick: np.ndarray) -> pa.RecordBatch:
    """The whole surroundings of the picked rows, at all their places, as spans."""
    part = batch.take(pa.array(pick))
    place, n_right, n_left = (column(part, c).to_numpy(zero_copy_only=False) for c in ("place", "n_right", "n_left"))
    again = column(part, "again")
    times = again.value_lengths().to_numpy(zero_copy_only=False)
    at = np.repeat(place, times) + again.flatten().to_numpy(zero_copy_only=False)
    k = np.repeat(np.arange(len(pick)), times)
    return _found(column(part, "doc_id").take(pa.array(k)), column(part, "row_key").take(pa.array(k)), at - n_left[k], at + n_right[k])


class _Alike:
    """Sorted rows whose surroundings are those of the row before: the first one, of the smallest document,
    stands for all; the others repeat it and need not be held, however many there are."""

    def __init__(self, window: int):
        self.window, self._last, self._doc = window, None, None

    def split(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rows to compare with others, and rows that repeat an earlier document outright."""
        cols = [column(batch, c) for c in ("seed", "cut", "following", "preceding")]
        same = np.zeros(batch.num_rows, bool)
        same[0] = self._last == tuple(c[0] for c in cols)
        if batch.num_rows > 1:
            same[1:] = np.logical_and.reduce([pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in cols])
        long = column(batch, "n_right").to_numpy(zero_copy_only=False) + column(batch, "n_left").to_numpy(zero_copy_only=False) >= self.window
        doc = column(batch, "doc_id").to_numpy(zero_copy_only=False)
        head = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
        rep = np.where(head >= 0, doc[np.maximum(head, 0)], self._doc if self._doc is not None else 0)
        self._last, self._doc = tuple(c[-1] for c in cols), rep[-1]
        repeats = same & long & (rep < doc)
        return np.flatnonzero(~repeats), np.flatnonzero(repeats)


def _scan(window: int, reach: int, rows: int = 20_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        alike = _Alike(window)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, repeats = alike.split(batch)
            if len(repeats):
                yield _spans(batch, repeats)
                batch = batch.take(pa.array(own))
            hot = column(batch, "hot").to_numpy(zero_copy_only=False)
            if hot.any():
                yield _windows(batch.take(pa.array(np.flatnonzero(hot))), window, reach)
                batch = batch.take(pa.array(np.flatnonzero(~hot)))
            if not batch.num_rows:
                continue
            seed = column(batch, "seed").to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(seed != seed[-1])[-1]) + 1 if seed[0] != seed[-1] else 0
            if last and sum(b.num_rows for b in held) + last >= rows:
                yield _compare(pa.Table.from_batches([*held, batch.slice(0, last)]), window, reach)
                held, batch = [], batch.slice(last)
            held.append(batch)
        if held:
            yield _compare(pa.Table.from_batches(held), window, reach)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(doc_id, row_key, start, end): the word ranges [start, end) of each text that repeat a passage of at
    least ``window`` words of a document with a smaller doc_id; ranges of one text neither meet nor overlap.

    The smallest doc_id that has a passage keeps it. Passages repeated inside one document only stay. Null
    and short texts have none; rows without doc_id take no part; rows that share a doc_id are one document.
    """
    kept = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", row_key().alias("row_key"))
    found = materialize(kept.mapInArrow(_suffixes(window, seed), _SUFFIXES), "suffixes")
    shared = found.groupBy("seed").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    # Written, so that both sides of the join are exchanges and a hot seed's rows can be split.
    shared = materialize(shared.select("seed", F.ceil(F.col("n") / group).cast("int").alias("cuts")), "suffix-shared")
    held = found.join(shared, "seed").select("doc_id", "row_key", F.struct("place", "seed", "cuts", "before", "windows").alias("s"))
    by_text = held.groupBy("doc_id", "row_key").agg(F.collect_list("s").alias("suffixes"))
    texts = kept.join(by_text, ["doc_id", "row_key"])
    contexts = texts.mapInArrow(_contexts(window, seed), _CONTEXTS)
    width = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = contexts.repartition(width, "seed", "cut").sortWithinPartitions("seed", "cut", "following", "preceding", "doc_id")
    out = materialize(ordered.mapInArrow(_scan(window, window - seed), _FOUND), "suffix-spans")
    single = out.filter("h1 is not null")
    first = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc")
    seen = single.join(first, ["h1", "h2"]).filter("first_doc < doc_id")
    span = ["doc_id", "row_key", "start", "end"]
    spans = out.filter("h1 is null").select(span).unionByName(seen.select(span)).distinct()
    own = Window.partitionBy("doc_id", "row_key")
    before = own.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    islands = spans.withColumn("gap", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    islands = islands.withColumn("island", F.sum("gap").over(own.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "row_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
