"""Whitening of embeddings from exact integer statistics, gathered as bit-sliced scatter.

Every entry c becomes the integer floor(1024 c) + 100000. A task cuts its rows into batches; a batch
shifts each dimension by its least value there and packs every bit plane of every dimension across the
rows into 64-bit words. The cross-product of two dimensions is then the sum over pairs of planes of
popcount(plane and plane), weighted by the power of two of both. Shifts are put back in integers, so that
sums and cross-products over any number of rows are exact, and the covariance is centred as an integer
(n times cross-product less the product of the sums) before anything is rounded.

Rows of one length are fitted together; tables of several lengths get one fit each. A vector that is null
or holds a null, NaN or infinite entry takes no part and gets no row; an empty vector has no components
and gets none either. Integers beyond 2**45 are held there. A component whose variance is zero (to 1e-11
of the largest) has no whitened value: null. Repeated rows and rows without id count and return as often
as they stand; an empty table gives an empty result. Other columns of the table are not looked at.

The driver holds one model per length, of the size of its components; the cross-products of a length, a
square of the length, meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake.llm.base import column, fresh, materialize, ragged

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Integers are held within this, so that sums over 2**36 rows of products fit 38 decimal digits.
LARGEST = 1 << 45
#: Share of the largest variance below which a component counts as constant.
FLAT = 1e-11


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that take part and their integers, one pair of arrays per length."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    off = np.frombuffer(vectors.buffers()[1], np.int64, len(vectors) + 1 + vectors.offset)[vectors.offset :]
    flat = vectors.values.to_numpy(zero_copy_only=False)
    length = np.diff(off)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fine = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[off[1:]] == bad[off[:-1]])
    for n in np.unique(length[fine & (length > 0)]).tolist():
        rows = np.flatnonzero(fine & (length == n))
        values = flat[ragged(off[rows], length[rows])].reshape(-1, n)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(values * SCALE), -LARGEST, LARGEST - OFFSET)
        yield rows, x.astype(np.int64) + OFFSET


def bit_planes(y: np.ndarray) -> np.ndarray:
    """Words [plane, column, 64 rows] of non-negative integers [row, column]."""
    rows, dims = y.shape
    words = -(-rows // 64)
    turned = np.zeros((dims, words * 64), np.int64)
    turned[:, :rows] = y.T
    planes = np.empty((max(1, int(y.max()).bit_length()), dims, words), np.uint64)
    for p in range(len(planes)):
        planes[p] = np.packbits((turned >> p & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return planes


def scatter(planes: np.ndarray) -> np.ndarray:
    """Exact cross-products of all columns as Python integers; above the diagonal only."""
    n, dims, _ = planes.shape
    by_weight = np.zeros((2 * n - 1, dims, dims), np.int64)
    for i in range(dims):
        others = planes[:, i:]
        for p in range(n):
            if planes[p, i].any():
                by_weight[p : p + n, i, i:] += np.bitwise_count(others & planes[p, i]).sum(axis=2, dtype=np.int64)
    total = np.zeros((dims, dims), object)
    for s in range(0, 2 * n - 1, 32):  # 32 weights at a time stay below 2**63 for any batch of 2**20 rows
        part = by_weight[s : s + 32]
        total = total + (part << np.arange(len(part))[:, None, None]).sum(axis=0).astype(object) * (1 << s)
    return total


def _statistics(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[pa.RecordBatch]:
    """Rows (length, i, j, value): cross-products for i <= j, sums as j = -1, the count as i = j = -1."""
    held: dict[int, list] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for dims, (n, sums, cross) in held.items():
            i, j = np.triu_indices(dims)
            i, j = np.concatenate([[-1], np.arange(dims), i]), np.concatenate([np.full(dims + 1, -1), j])
            values = [n, *sums.tolist(), *cross[np.triu_indices(dims)].tolist()]
            cols = [pa.array(np.full(len(i), dims), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(cols, ["length", "i", "j", "value"])
        held.clear()

    for batch in batches:
        for _, x in _by_length(column(batch, vector)):
            rows, dims = x.shape
            low = x.min(axis=0)
            y = x - low
            low, sums = low.astype(object), y.sum(axis=0).astype(object)
            cross = scatter(bit_planes(y)) + np.outer(sums, low) + np.outer(low, sums) + rows * np.outer(low, low)
            n, s, c = held.get(dims, (0, 0, 0))
            held[dims] = [n + rows, s + sums + rows * low, c + cross]
        if sum(d * d for d in held) > 1 << 22 and len(held) > 1:
            yield from flush()
    yield from flush()


@dataclass
class Model:
    """What whitens vectors of one length: exact sums, the leading components and their variances."""

    length: int
    n: int
    sums: list[int]
    variances: list[float]
    trace: float
    components: np.ndarray


_MODEL = "length int, n long, sums array<string>, variances array<double>, trace double, components array<array<double>>"


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    dims = int(pdf["length"].iloc[0])
    i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    value = np.array([int(v) for v in pdf["value"]], dtype=object)
    n = value[i == -1][0]
    sums = np.zeros(dims, object)
    sums[i[(i >= 0) & (j == -1)]] = value[(i >= 0) & (j == -1)]
    cov = np.zeros((dims, dims))
    for a, b, v in zip(i[j >= 0].tolist(), j[j >= 0].tolist(), value[j >= 0].tolist(), strict=True):
        cov[a, b] = cov[b, a] = (n * v - sums[a] * sums[b]) / (n * n)  # of integers: rounded once
    e, vectors = np.linalg.eigh(cov)
    top = np.argsort(-e, kind="stable")[:COMPONENTS]
    row = (dims, n, [str(s) for s in sums], np.maximum(e[top], 0.0).tolist(), float(np.trace(cov)), [vectors[:, k].tolist() for k in top])
    return pd.DataFrame([row], columns=["length", "n", "sums", "variances", "trace", "components"])


def fit(vectors: DataFrame, vector: str = "embedding") -> list[Model]:
    """One model per length of vector."""
    cells = vectors.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(lambda b: _statistics(b, "v"), "length int, i int, j int, value decimal(38,0)")
    summed = cells.groupBy("length", "i", "j").agg(F.sum("value").alias("value"))
    found = summed.groupBy("length").applyInPandas(_solve, _MODEL).collect()
    return [Model(r["length"], r["n"], [int(s) for s in r["sums"]], list(r["variances"]), r["trace"], np.array(r["components"])) for r in found]


def _deviations(y: np.ndarray, n: int, rest: np.ndarray) -> list[int]:
    """Sum over columns of (n y - rest)**2 for every row, exact; ``rest`` holds Python integers."""
    reach = int(np.abs(y).max(initial=0)) + 1
    if n * reach >= 1 << 58 or y.shape[1] >= 1 << 20:
        d = y.astype(object) * n - rest
        return (d * d).sum(axis=1).tolist()
    d = y * n - rest.astype(np.int64)
    # Squares of two halves: d = a 2**30 + b; with |a| < 2**30 and fewer than 2**20 columns no sum overflows a pair of parts.
    a, b = d >> 30, d & ((1 << 30) - 1)
    if int(np.abs(a).max(initial=0)) >= 1 << 21:
        d = d.astype(object)
        return (d * d).sum(axis=1).tolist()
    high, middle, low = ((p.sum(axis=1)).tolist() for p in (a * a, a * b >> 20, b * b >> 20))
    mid_rest, low_rest = ((a * b & ((1 << 20) - 1)).sum(axis=1).tolist(), (b * b & ((1 << 20) - 1)).sum(axis=1).tolist())
    return [(h << 60) + (((m << 20) + mr) << 31) + (w << 20) + lr for h, m, mr, w, lr in zip(high, middle, mid_rest, low, low_rest, strict=True)]


def _project(batches: Iterator[pa.RecordBatch], ident: str, models: dict[int, Model], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in _by_length(column(batch, "v")):
            m = models[x.shape[1]]
            base = np.array([s // m.n for s in m.sums], np.int64)
            rest = np.array([s % m.n for s in m.sums], object)
            y = x - base
            centred = y - (rest / m.n).astype(np.float64)
            e = np.array(m.variances)
            flat = e <= FLAT * e[0]
            w = centred @ m.components.T / np.sqrt(np.where(flat, 1.0, e))
            holes = np.broadcast_to(flat, w.shape).ravel()
            dev = _deviations(y, m.n, rest)
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel(), pa.float64(), mask=holes))
            cols = [column(batch, ident).take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1]), pa.int32()),
                    pa.array([d if d < 1 << 63 else None for d in dev], pa.int64()), pa.array([str(d) for d in dev], pa.string()), lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def whiten(vectors: DataFrame, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """(ident, component, n, deviation, deviation_text, whitened, explained, identity_error, length).

    One row per remaining vector and component. ``deviation`` is null where the exact sum, always in
    ``deviation_text``, is beyond a long; ``identity_error`` is one value per length of vector.
    """
    models = {m.length: m for m in fit(vectors, vector)}
    key = fresh("id", ["v"])
    rows = vectors.select(F.col(ident).alias(key), F.col(vector).cast("array<double>").alias("v"))
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL("length int, deviation long, deviation_text string, w array<double>")])
    arrow = pa.schema([pa.field(key, _arrow(rows.schema[key].dataType)), ("length", pa.int32()), ("deviation", pa.int64()), ("deviation_text", pa.string()), ("w", pa.list_(pa.float64()))])
    done = materialize(rows.mapInArrow(lambda b: _project(b, key, models, arrow), schema), "whitened")
    table = _model_table(vectors.sparkSession, models)
    # One row per length, as many as there are models on the driver.
    out = done.join(F.broadcast(table.join(identity_errors(done), "length", "left")), "length")
    out = out.select("*", F.posexplode("w").alias("_at", "whitened"))
    return out.select(F.col(key).alias(ident), (F.col("_at") + 1).alias("component"), "n", "deviation", "deviation_text", "whitened",
                      F.get("explained", F.col("_at")).alias("explained"), F.coalesce("identity_error", F.lit(0.0)).alias("identity_error"), "length")


def identity_errors(done: DataFrame) -> DataFrame:
    """(length, identity_error): the largest entry of the covariance of ``w`` less the identity."""
    at = lambda i: F.get("w", F.lit(i))
    pairs = [(i, j) for i in range(COMPONENTS) for j in range(i, COMPONENTS)]
    sums = [F.avg(at(i)).alias(f"m{i}") for i in range(COMPONENTS)] + [F.avg(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in pairs]
    gaps = [F.abs(F.col(f"p{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}") - F.lit(float(i == j))) for i, j in pairs]
    return done.groupBy("length").agg(*sums).select("length", F.greatest(*gaps).alias("identity_error"))


def _model_table(spark, models: dict[int, Model]) -> DataFrame:
    rows = [(m.length, m.n, [e / m.trace if m.trace > 0 else 0.0 for e in m.variances]) for m in models.values()]
    return spark.createDataFrame(rows, "length int, n long, explained array<double>")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
