"""Token files: the ids of all documents in ascending doc_id, coded by the context-mixing range coder.

A file is a shard of the documents in order. Its rows are blocks of up to BLOCK ids, each with its number,
its place in the shard, the documents that begin in it, and the coded ids with their checksum. A block is
decoded without any other; a document may run over several. Shards are Parquet files, so any store that
Spark can write to holds them, and a lost task writes its shard anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.llm import range_coder as R
from roadlake.llm.base import column, materialize, ragged, steps
from roadlake.llm.pieces import Growing, Lexicon, Pieces, Splitter

END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Pieces whose ids a worker remembers (60 to 140 bytes each); beyond it the memory starts anew.
REMEMBERED = 1_500_000
#: Words of one text when new ones are encoded.
JOINED = 1000
SCHEMA = "shard int, block int, first long, n_ids int, doc_ids array<long>, doc_at array<int>, doc_lengths array<int>, payload binary"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """Ids of texts; each distinct piece is encoded by the tokenizer once and then remembered."""

    def __init__(self, path: str):
        self._lexicon = Lexicon(Splitter(path), REMEMBERED)
        vocabulary = self._lexicon.splitter.tokenizer.get_vocab()
        self._n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a letter of a token stands for a byte
        self._n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self._ids, self._ends = Growing(np.uint32), Growing(np.int64)

    def _learn(self, pieces: Pieces) -> None:
        """Spaced words are encoded many in one text, whose ids part at their ends; other pieces one by one."""
        joined = pieces.spaced_words()
        sizes = np.zeros(len(pieces), np.int64)
        words, wi = self._learn_words(pieces.take(np.flatnonzero(joined)))
        other = self._coded(list(pieces.take(np.flatnonzero(~joined))))
        sizes[joined], sizes[~joined] = words, [len(c) for c in other]
        ends = np.cumsum(sizes)
        ids = np.zeros(int(sizes.sum()), np.uint32)
        ids[ragged((ends - sizes)[joined], words)] = wi
        ids[ragged((ends - sizes)[~joined], sizes[~joined])] = [i for c in other for i in c]
        begin = self._ids.size
        self._ids.extend(ids)
        self._ends.extend(begin + ends)

    def _learn_words(self, words: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them."""
        raw, cuts = words.data.tobytes(), [*words.off[:-1:JOINED].tolist(), int(words.off[-1])]
        coded = self._coded([raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        ids = np.array([i for c in coded for i in c], np.uint32)
        ends = np.append(0, np.cumsum(self._n_bytes[ids]))
        at = np.searchsorted(ends, words.off)
        if not np.array_equal(ends[at], words.off):
            raise ValueError("a token runs over the end of a word")
        return np.diff(at), ids

    def _coded(self, texts: list[str]) -> list[list[int]]:
        return [c.ids for c in self._lexicon.splitter.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one text after the other, and how many each has."""
        numbers, first = self._lexicon.cut(texts, self._forget, self._learn)
        ends = self._ends.values
        starts = np.append(0, ends[:-1])
        size = (ends - starts)[numbers]
        sums = np.append(0, np.cumsum(size))
        return self._ids.values[ragged(starts[numbers], size)], sums[first[1:]] - sums[first[:-1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = encoder(path)
        tail, held = np.zeros(0, np.uint32), []  # ids not yet in a block; finished blocks
        starts: list[tuple[int, int | None, int]] = []  # first id in the shard, doc_id, length
        total, at, number = 0, 0, 0

        def flush():
            nonlocal number, at, starts
            rows = []
            for ids, payload in zip(held, R.encode(held), strict=True):
                own = [s for s in starts if s[0] < at + len(ids)]
                starts = starts[len(own) :]
                rows.append((shard, number, at, len(ids), [s[1] for s in own], [s[0] - at for s in own], [s[2] for s in own], payload))
                number, at = number + 1, at + len(ids)
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            names = ["shard", "block", "first", "n_ids", "doc_ids", "doc_at", "doc_lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in steps(batches):
            ids, sizes = enc.encode(column(batch, "text"))
            ids = np.concatenate([tail, np.insert(ids, np.cumsum(sizes), np.uint32(end_id))])
            for doc_id, n in zip(column(batch, "doc_id").to_pylist(), (sizes + 1).tolist(), strict=True):
                starts.append((total, doc_id, n))
                total += n
            full = len(ids) // R.BLOCK * R.BLOCK
            held += [ids[i : i + R.BLOCK] for i in range(0, full, R.BLOCK)]
            tail = ids[full:].copy()
            if len(held) >= R.LANES:
                yield flush()
        if len(tail):
            held.append(tail)
        if held:
            yield flush()

    return run


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the token files to the shared workspace and returns what reads them.

    Null texts are empty: their end id alone. Rows that share a doc_id follow each other, ties in order
    of the text's hash; rows without doc_id come first.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    rows = rows.repartitionByRange(F.col("doc_id"), F.col("row_key")).sortWithinPartitions("doc_id", "row_key")
    return materialize(rows.mapInArrow(_blocks(path or default_path(), end_id), SCHEMA), "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted block rows of whole shards to one row per document."""
    waiting: list[list] = []  # documents not yet complete: shard, first, doc_id, length, crc, ids so far
    group: list[dict] = []

    def take() -> pa.RecordBatch:
        out = []
        for row, ids in zip(group, R.decode([r["payload"] for r in group]), strict=True):
            raw = np.ascontiguousarray(ids, "<u4").tobytes()
            if waiting:  # one document at most runs on from the block before
                doc = waiting[0]
                part = raw[: 4 * (doc[3] - doc[5])]
                doc[4], doc[5] = zlib.crc32(part, doc[4]), doc[5] + len(part) // 4
                if doc[5] == doc[3]:
                    out.append(waiting.pop())
            for doc_id, at, n in zip(row["doc_ids"], row["doc_at"], row["doc_lengths"], strict=True):
                part = raw[4 * at : 4 * (at + n)]
                doc = [row["shard"], row["first"] + at, doc_id, n, zlib.crc32(part), len(part) // 4]
                (out if doc[5] == n else waiting).append(doc)
        group.clear()
        kinds = [("shard", pa.int32(), 0), ("first", pa.int64(), 1), ("doc_id", pa.int64(), 2), ("n_tokens", pa.int64(), 3), ("ids_crc32", pa.int64(), 4)]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in out], k) for _, k, i in kinds], names=[k[0] for k in kinds])

    for batch in batches:
        for row in batch.to_pylist():
            group.append(row)
            if len(group) >= R.LANES:
                yield take()
    if group:
        yield take()
    if waiting:
        raise ValueError("a token file ends inside a document")


def documents_of(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the token files."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").cast("long").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    width = max(12, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = files.repartition(width, "shard").sortWithinPartitions("shard", "block").mapInArrow(_read, "shard int, first long, doc_id long, n_tokens long, ids_crc32 long")
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
