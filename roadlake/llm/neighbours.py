"""Approximate nearest neighbours by cross-polytope hashing.

Fast Hadamard pseudo-rotations (signs, transform, three times) turn unit vectors; the hash is the nearest
signed axis. Each of several tables has its own signs. A query probes, in every table, the axes it is
nearest to, in order; what the probed buckets hold is compared exactly, in double precision. How many axes
are probed is fitted: a bounded sample of queries is searched by brute force, and the smallest number that
finds the wanted share of their neighbours is taken, whatever the size of the table. Every row is indexed.

Equal vectors are one entry with its smallest ids (as many as any result can show), so copies cost nothing.
Buckets are cut into blocks, as are the queries that probe them: a task compares one block with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.llm.base import column, materialize

TABLES, K = 4, 20
#: The fit: queries in the sample, and the share of their neighbours that the probes must find.
SAMPLE, RECALL = 64, 0.96
#: Rows of a block of candidates and of queries.
BLOCK = 4096
SEED = 11


class Rotations:
    """The signs of all tables for vectors of one dimension."""

    def __init__(self, dim: int, tables: int = TABLES, seed: int = SEED):
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 3, self.size))

    def turned(self, v: np.ndarray, table: int) -> np.ndarray:
        """Rows of ``v`` after the pseudo-rotation of a table."""
        x = np.zeros((len(v), self.size))
        x[:, : v.shape[1]] = v / np.linalg.norm(v, axis=1, keepdims=True)
        for s in self.signs[table]:
            x = x * s
            width = 1
            while width < self.size:
                y = x.reshape(len(x), -1, 2, width)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
                width *= 2
            x /= np.sqrt(self.size)
        return x

    def order(self, v: np.ndarray, table: int) -> np.ndarray:
        """All signed axes for each row, the nearest first (axis, or axis + size for its opposite)."""
        x = self.turned(v, table)
        return np.argsort(-np.concatenate([x, -x], axis=1), axis=1, kind="stable")

    def bucket(self, v: np.ndarray, table: int) -> np.ndarray:
        x = self.turned(v, table)
        axis = np.abs(x).argmax(axis=1)
        return axis + np.where(x[np.arange(len(x)), axis] < 0, self.size, 0)


def _matrix(arrays: pa.Array, dim: int) -> np.ndarray:
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arrays), dim)


def entries(vectors: DataFrame, keep: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(entry, v, ids): the distinct usable vectors and the ``keep`` smallest ids of each.

    Vectors that are null, zero or hold null or non-finite components take no part, nor rows without an
    id, nor vectors whose length is not the most common one (the greatest of equally common ones).
    """
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    dim = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dim is None:
        return usable.limit(0).select(F.lit("").alias("entry"), "v", F.array("id").alias("ids"))
    named = usable.filter(F.size("v") == dim["d"]).withColumn("entry", F.concat_ws("-", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    few = named.withColumn("place", F.row_number().over(Window.partitionBy("entry").orderBy("id"))).filter(F.col("place") <= keep)
    return few.groupBy("entry").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


_FOUND = "query string, scores array<double>, ids array<long>, ranks array<int>"


def _best(query: np.ndarray, score: np.ndarray, ident: np.ndarray, rank: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """The ``keep`` best of each query: larger scores first, then smaller ids; each id once."""
    order = np.lexsort((ident, -score, query))
    query, score, ident, rank = query[order], score[order], ident[order], rank[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (ident[1:] != ident[:-1]) | (score[1:] != score[:-1])
    query, score, ident, rank = query[fresh], score[fresh], ident[fresh], rank[fresh]
    head = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
    top = place < keep
    return query[top], score[top], ident[top], rank[top]


def _compare(queries: np.ndarray, v: np.ndarray, ids: list[list[int]], ranks: np.ndarray | None, keep: int) -> tuple[np.ndarray, ...]:
    """For each query the best of a block. Products choose, sums in one fixed order score: equal vectors
    then score alike wherever they are."""
    sizes = np.array([len(i) for i in ids])
    flat, at = np.array([x for i in ids for x in i], np.int64), np.cumsum(sizes) - sizes
    out = []
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        approx = q @ v.T
        if len(v) > keep:
            floor = np.partition(approx, len(v) - keep, axis=1)[:, len(v) - keep]
            row, col = np.nonzero(approx >= (floor - 1e-9 * np.maximum(1, np.abs(floor)))[:, None])
        else:
            row, col = (x.ravel() for x in np.indices(approx.shape))
        score = (q[row] * v[col]).sum(axis=1)
        n = sizes[col]
        pick = np.repeat(at[col] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        rank = np.zeros(len(row), np.int32) if ranks is None else ranks[lo + row, col]
        out.append(_best(np.repeat(row + lo, n), np.repeat(score, n), flat[pick], np.repeat(rank, n), keep))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def _listed(names: list[str], query: np.ndarray, score: np.ndarray, ident: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """Best lists as rows; ``query`` is sorted."""
    own, count = np.unique(query, return_counts=True)
    off = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(off, pa.array(x, k)) for x, k in ((score, pa.float64()), (ident, pa.int64()), (rank, pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([names[i] for i in own], pa.string()), *lists], names=["query", "scores", "ids", "ranks"])


def _merge(keep: int):
    """Rows sorted by query to one list for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            names = column(batch, "query").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            lists = [column(batch, c) for c in ("scores", "ids", "ranks")]
            n = lists[0].value_lengths().to_numpy(zero_copy_only=False)
            merged = _listed(names.dictionary.to_pylist(), *_best(np.repeat(code, n), *[x.flatten().to_numpy(zero_copy_only=False) for x in lists], keep))
            if merged.num_rows > 1:
                yield merged.slice(0, merged.num_rows - 1)
            rest = merged.slice(merged.num_rows - 1)
        if rest is not None:
            yield rest

    return run


def _merged(found: DataFrame, keep: int) -> DataFrame:
    width = max(12, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return found.repartition(width, "query").sortWithinPartitions("query").mapInArrow(_merge(keep), _FOUND)


def _sampled(names: list[str], queries: np.ndarray, turn: Rotations, tables: int, keep: int):
    """Brute force for few queries, with the place of each neighbour in their probing order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [np.argsort(turn.order(queries, t), axis=1) for t in range(tables)]
        for batch in batches:
            if batch.num_rows:
                v = _matrix(column(batch, "v"), queries.shape[1])
                ranks = np.min([p[:, turn.bucket(v, t)] for t, p in enumerate(places)], axis=0).astype(np.int32)
                yield _listed(names, *_compare(queries, v, column(batch, "ids").to_pylist(), ranks, keep))

    return run


def fitted_probes(index: DataFrame, queries: DataFrame, turn: Rotations, tables: int, keep: int, sample: int = SAMPLE, recall: float = RECALL) -> int:
    """The smallest number of probes in each table that finds ``recall`` of the sample's neighbours."""
    rows = queries.orderBy(F.xxhash64("entry")).limit(sample).collect()
    if not rows:
        return 1
    names, vectors = [r["entry"] for r in rows], np.array([r["v"] for r in rows])
    found = _merged(index.select("v", "ids").mapInArrow(_sampled(names, vectors, turn, tables, keep), _FOUND), keep).collect()
    ranks = np.array([x for r in found for x in r["ranks"]])
    return int(np.quantile(ranks, recall, method="higher")) + 1


def _indexed(turn: Rotations, dim: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(column(batch, "v"), dim)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(turn.bucket(v, t).astype(np.int32)), *[column(batch, c) for c in ("entry", "v", "ids")]], names=["t", "bucket", "entry", "v", "ids"])

    return run


def _probed(turn: Rotations, dim: int, tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(column(batch, "v"), dim)
                for t in range(tables):
                    buckets = turn.order(v, t)[:, :probes].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(list(buckets), pa.list_(pa.int32())), *[column(batch, c) for c in ("entry", "v")]], names=["t", "buckets", "entry", "v"])

    return run


def _block(dim: int, keep: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_listed([], *[np.zeros(0, np.int64)] * 4)])
        q, c = left.combine_chunks(), right.combine_chunks()
        qv, cv = (_matrix(x["v"].combine_chunks(), dim) for x in (q, c))
        return pa.Table.from_batches([_listed(q["entry"].to_pylist(), *_compare(qv, cv, c["ids"].to_pylist(), None, keep))])

    return run


def search(vectors: DataFrame, is_query: F.Column, k: int = K, tables: int = TABLES, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``is_query`` (a condition on ``id``) its k
    nearest other rows by inner product, nearest first, ties to the smaller id.

    An id that several rows share counts as one row if their vectors are equal, and as several otherwise;
    a query never finds its own id. With fewer than k other rows all that are found are returned. Vectors have
    products with those of their own length only, so each length is searched apart. Vectors that are null, zero
    or hold null or non-finite components take no part; an empty table gives no rows.
    """
    # One number for each length that occurs.
    lengths = sorted(r["d"] for r in vectors.select(F.size(vec_col).alias("d")).filter("d > 0").distinct().collect())
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = [_search(vectors.filter(F.size(vec_col) == d), is_query, k, tables, probes, id_col, vec_col) for d in lengths]
    return reduce(DataFrame.unionByName, parts)


def _search(vectors: DataFrame, is_query: F.Column, k: int, tables: int, probes: int | None, id_col: str, vec_col: str) -> DataFrame:
    """``search`` over vectors of one length."""
    keep = k + 1  # a query may find itself
    spark = vectors.sparkSession
    index = materialize(entries(vectors, keep, id_col, vec_col), "ann-entries")
    own = materialize(_query_ids(vectors, is_query, id_col, vec_col).join(index.select("entry"), "entry", "left_semi"), "ann-query-ids")
    queries = index.select("entry", "v").join(own.select("entry").distinct(), "entry", "left_semi")
    head = index.select("v").first()
    if head is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(head["v"])
    turn = Rotations(dim, tables)
    if probes is None:
        probes = fitted_probes(index, queries, turn, tables, keep)
    placed = materialize(index.mapInArrow(_indexed(turn, dim, tables), "t int, bucket int, entry string, v array<double>, ids array<long>"), "ann-index")
    # Tables times signed axes rows, whatever the size of the index.
    sizes = materialize(placed.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "ann-sizes")
    cand = placed.join(F.broadcast(sizes), ["t", "bucket"]).withColumn("part", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"))
    asked = queries.mapInArrow(_probed(turn, dim, tables, probes), "t int, buckets array<int>, entry string, v array<double>").withColumn("bucket", F.explode("buckets")).drop("buckets")
    asked = asked.join(F.broadcast(sizes), ["t", "bucket"])
    q_blocks = max(1, -(-own.select("entry").distinct().count() // BLOCK))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("q", F.pmod(F.xxhash64("entry"), F.lit(q_blocks)).cast("int"))
    cand = cand.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    keys = ["t", "bucket", "part", "q"]
    pairs = asked.select(*keys, "entry", "v").groupBy(*keys).cogroup(cand.select(*keys, "v", "ids").groupBy(*keys))
    best = _merged(pairs.applyInArrow(_block(dim, keep), _FOUND), keep)
    listed = own.join(best, own["entry"] == best["query"]).select("query_id", F.arrays_zip("scores", "ids").alias("found"))
    listed = listed.withColumn("found", F.slice(F.filter("found", lambda x: x["ids"] != F.col("query_id")), 1, k))
    out = listed.select("query_id", F.posexplode("found").alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))


def _query_ids(vectors: DataFrame, is_query: F.Column, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, entry) of all queries; entries that take no part fall out when joined."""
    v = F.col(vec_col).cast("array<double>")
    named = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    return named.filter(is_query).select(F.col("id").alias("query_id"), F.concat_ws("-", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).alias("entry")).distinct()
