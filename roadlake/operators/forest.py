"""Isolation forests on Spark (M1, M2), after Liu, Ting & Zhou 2008.

Spark draws the samples (hash thresholds, one bounded window per tree), grows
the trees as grouped tasks of a few hundred rows each, and scores rows with a
vectorised UDF over the broadcast trees.  The data never gathers: only samples
of at most 256 rows per tree and the finished trees (a fixed-size table) move.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_TREES = 100
PSI = 256
SEED = 42
BLOCK = 10  # trees grown by one task group
NODE_FIELDS = [("tree", T.IntegerType()), ("node", T.IntegerType()), ("feature", T.IntegerType()), ("cut", T.DoubleType()),
               ("size", T.IntegerType()), ("depth", T.IntegerType()), ("psi", T.IntegerType())]


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + 0.5772156649) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def _unit(*cols: Column) -> Column:
    """Hash of the columns as a number in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def tree_samples(df: DataFrame, features: Sequence[str], by: Sequence[str], row_key: Sequence[str], n_trees: int = N_TREES,
                 psi: int = PSI, seed: int = SEED) -> DataFrame:
    """At most ``psi`` rows for each (model, tree), drawn by hash.

    A first threshold leaves about n_trees * psi rows per model, a second about
    1.5 * psi per tree; only those meet the exact top-psi window.
    """
    by, feats = list(by), list(features)
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in feats], *[F.col(c).alias(f"_k{i}") for i, c in enumerate(row_key)]).dropna(subset=feats)
    keys = [F.col(f"_k{i}") for i in range(len(row_key))]
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(n, by) if by else rows.crossJoin(F.broadcast(n))
    pool = float(n_trees * psi)
    rows = rows.where(_unit(*keys, F.lit(seed)) < F.lit(pool) / F.col("_n"))
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    rows = rows.withColumn("_u", _unit(*keys, F.col("tree"), F.lit(seed + 1)))
    slack = psi + 8 * math.sqrt(psi) + 8
    rows = rows.where(F.col("_u") < F.lit(slack) / F.least(F.col("_n").cast("double"), F.lit(pool)))
    w = Window.partitionBy(*by, "tree").orderBy("_u", *feats)
    rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi)
    return rows.select(*by, "tree", "_r", *feats)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree in heap numbering (children of i are 2i+1 and 2i+2)."""
    out, todo = [], [(0, 0, np.arange(len(x)))]
    while todo:
        node, depth, idx = todo.pop()
        part = x[idx]
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(idx) <= 1 or not len(usable):
            out.append((node, -1, 0.0, len(idx), depth))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = part[:, f] <= cut
        out.append((node, f, cut, len(idx), depth))
        todo.append((2 * node + 2, depth + 1, idx[~left]))
        todo.append((2 * node + 1, depth + 1, idx[left]))
    return out


def fit_forests(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), row_key: Sequence[str] = ("event_id",),
                n_trees: int = N_TREES, psi: int = PSI, seed: int = SEED) -> DataFrame:
    """M1 for one model or for one per group: the node table."""
    by, feats = list(by), list(features)
    return grow_forests(tree_samples(df, feats, by, row_key, n_trees, psi, seed), feats, by, seed)


def nested_samples(rows: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str], row_key: Sequence[str] = ("event_id",),
                   n_trees: int = N_TREES, psi: int = PSI, seed: int = SEED) -> DataFrame:
    """:func:`tree_samples` of models that hold one another, from rows that stand once.

    ``models`` has ``by`` (a key's columns and, last, the model's name), its ``step`` and its number of
    rows ``n``; ``rows`` have the key and the ``step`` from which on models hold them.  A
    row meets the list of its key's models.  Only what a model's thresholds leave is dealt out to it: about
    1.5 * psi rows a tree, whatever the number of rows and steps.
    """
    *key, name = by
    feats, keys = list(features), [F.col(f"_k{i}") for i in range(len(row_key))]
    lists = models.groupBy(*key).agg(F.collect_list(F.struct("step", F.col(name).alias("name"), F.col("n").cast("double").alias("n"))).alias("_models"))
    d = rows.select(*key, "step", *[F.col(c).cast("double").alias(c) for c in feats], *[F.col(c).alias(f"_k{i}") for i, c in enumerate(row_key)]).dropna(subset=feats)
    pool, slack = float(n_trees * psi), psi + 8 * math.sqrt(psi) + 8
    d = d.join(lists, key).withColumn("_u", _unit(*keys, F.lit(seed)))
    d = d.withColumn("_models", F.filter("_models", lambda m: (m["step"] >= F.col("step")) & (F.col("_u") < F.lit(pool) / m["n"]))).where(F.size("_models") > 0)
    d = d.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn("_u", _unit(*keys, F.col("tree"), F.lit(seed + 1)))
    d = d.withColumn("_m", F.explode(F.filter("_models", lambda m: F.col("_u") < F.lit(slack) / F.least(m["n"], F.lit(pool))))).drop("_models")
    w = Window.partitionBy(*key, "_m.name", "tree").orderBy("_u", *feats)
    d = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi)
    return d.select(*key, F.col("_m.name").alias(name), "tree", "_r", *feats)


def fit_nested(rows: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str], row_key: Sequence[str] = ("event_id",),
               n_trees: int = N_TREES, psi: int = PSI, seed: int = SEED) -> DataFrame:
    """M1 for models that hold one another: the node tables that :func:`fit_forests` gives on their copied rows."""
    return grow_forests(nested_samples(rows, models, features, by, row_key, n_trees, psi, seed), features, by, seed)


def grow_forests(samples: DataFrame, features: Sequence[str], by: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """The node tables of sampled rows."""
    by, feats = list(by), list(features)
    s = samples.withColumn("_blk", F.floor(F.col("tree") / BLOCK).cast("int"))
    schema = T.StructType([s.schema[c] for c in by] + [T.StructField(n, t) for n, t in NODE_FIELDS])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for tree, part in pdf.sort_values(["tree", "_r"]).groupby("tree"):
            x = part[feats].to_numpy()
            size = len(x)
            rng = np.random.default_rng([seed, int(tree)])
            nodes = _grow(x, rng, max(1, math.ceil(math.log2(max(size, 2)))))
            f = pd.DataFrame(nodes, columns=["node", "feature", "cut", "size", "depth"])
            f["tree"], f["psi"] = int(tree), size
            frames.append(f)
        out = pd.concat(frames)
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[schema.names]

    return s.groupBy(*by, "_blk").applyInPandas(grow, schema)


class Forest:
    """Trees as bit vectors (after Lucchese et al. 2015): a row's leaf is found without walking.

    The slots of a complete tree's bottom are the bits of a vector; a leaf above the bottom has all
    slots under it.  A node whose test fails rules out the slots of its left side, so a
    feature's nodes in the order of their cuts rule out ever more: what is left after the first so
    many is looked up.  One search per feature serves all trees; the lowest bit left by all
    features is the leaf.
    """

    def __init__(self, nodes: pd.DataFrame, features: Sequence[str]):
        self.features = list(features)
        self.nodes = n = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        names, tree = np.unique(n["tree"].to_numpy(), return_inverse=True)
        depth = max(1, int(n["depth"].max()))
        d, feature, cut = n["depth"].to_numpy(np.int64), n["feature"].to_numpy(np.int64), n["cut"].to_numpy(float)
        width = 1 << (depth - d)  # slots under a node, from ``first`` on
        first = (n["node"].to_numpy(np.int64) + 1 - (1 << d)) * width
        self.path = np.zeros((len(names), 1 << depth))
        leaf = np.flatnonzero(feature < 0)
        slot = np.repeat(first[leaf], width[leaf]) + np.arange(width[leaf].sum()) - np.repeat(np.cumsum(width[leaf]) - width[leaf], width[leaf])
        self.path[np.repeat(tree[leaf], width[leaf]), slot] = np.repeat(d[leaf] + mean_path(n["size"].to_numpy()[leaf]), width[leaf])
        psi = n.groupby("tree")["psi"].first().to_numpy()
        self.norm = float(mean_path(psi).mean()) or 1.0

        words = max(1, (1 << depth) // 64)
        self.searches, self.counts, self.left = [], [], []
        for f in range(len(self.features)):
            own = np.flatnonzero(feature == f)
            own = own[np.argsort(cut[own], kind="stable")]
            # how many of a tree's cuts are among the first of all
            count = np.zeros((len(names), len(own) + 1), np.int32)
            count[tree[own], np.arange(len(own)) + 1] = 1
            keep = ~self._bits(first[own], first[own] + width[own] // 2, words)
            full = np.full((1, words), ~np.uint64(0))
            left = [np.bitwise_and.accumulate(np.concatenate([full, keep[tree[own] == t]])) for t in range(len(names))]
            self.searches.append(cut[own])
            self.counts.append(np.cumsum(count, axis=1))
            self.left.append(left)

    @staticmethod
    def _bits(start: np.ndarray, end: np.ndarray, words: int) -> np.ndarray:
        """Vectors with the bits from start to before end set."""
        at = np.arange(words) * 64
        lo, hi = (np.clip(x[:, None] - at, 0, 64).astype(np.uint64) for x in (start, end))
        below = lambda k: np.where(k >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(k, np.uint64(63))) - np.uint64(1))
        return below(hi) ^ below(lo)

    def decide(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Decision value, lower = more anomalous: 0.5 - 2^(-mean path / c(psi))."""
        x = np.asarray(x, dtype=float)
        total = np.zeros(len(x))
        one = np.uint64(1)
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            ranks = [np.searchsorted(s, part[:, f], side="left") for f, s in enumerate(self.searches)]
            for t, path in enumerate(self.path):
                bits = None
                for rank, count, left in zip(ranks, self.counts, self.left):
                    if len(left[t]) > 1:
                        found = left[t].take(count[t].take(rank), axis=0)
                        bits = found if bits is None else np.bitwise_and(bits, found, out=bits)
                if bits is None:
                    total[at : at + rows] += path[0]
                    continue
                slot = None
                for w in reversed(range(bits.shape[1])):  # the lowest word with a bit, its lowest bit
                    word = bits[:, w]
                    here = np.bitwise_count((word & (~word + one)) - one).astype(np.int64) + 64 * w
                    slot = here if slot is None else np.where(word != 0, here, slot)
                total[at : at + rows] += path.take(slot)
        return 0.5 - np.exp2(-total / len(self.path) / self.norm)

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """M2: adds the decision value; rows with a null feature get null."""
        # a forest is at most trees x 2^depth nodes, whatever the data size
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf(T.DoubleType())
        def decide(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            ok = ~np.isnan(x).any(axis=1)
            res = np.full(len(x), np.nan)
            if ok.any():
                res[ok] = shared.value.decide(x[ok])
            return pd.Series(res)

        return df.withColumn(out, F.nanvl(decide(*[F.col(c).cast("double") for c in self.features]), F.lit(None).cast("double")))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes[[n for n, _ in NODE_FIELDS]], T.StructType([T.StructField(n, t) for n, t in NODE_FIELDS]))

    def save(self, spark: SparkSession, path: str) -> None:
        """K5: node table and feature list as Parquet."""
        self.to_df(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.features,)], "feature_cols array<string>").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, expect: Sequence[str] | None = None) -> Forest:
        feats = spark.read.parquet(f"{path}/meta").first()["feature_cols"]
        if expect is not None and list(expect) != list(feats):
            raise ValueError(f"model features {feats} are not {list(expect)}")
        return cls(spark.read.parquet(f"{path}/nodes").toPandas(), feats)


def fit(df: DataFrame, features: Sequence[str], **kw) -> Forest:
    """One forest, its bounded node table brought to the driver for broadcast."""
    return Forest(fit_forests(df, features, **kw).toPandas(), features)


def score_many(df: DataFrame, nodes: DataFrame, features: Sequence[str], by: Sequence[str], out: str = "score", slice_rows: int = 200_000) -> DataFrame:
    """M2 for many models at once: rows meet the trees of their own model.

    Rows of a model are cut into slices of about ``slice_rows``, and each slice
    gets a copy of the model, so a model that scores a third of all rows is
    spread like the others.
    """
    by, feats = list(by), list(features)
    n = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("_ns"))
    rows = df.join(n, by).withColumn("_sl", F.pmod(F.xxhash64(*df.columns), F.col("_ns")).cast("int")).drop("_ns")
    copies = nodes.join(n.select(*by, F.explode(F.sequence(F.lit(0), F.col("_ns") - 1)).alias("_sl")), by)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        res = left[df_cols].copy()
        res[out] = np.nan
        if len(left) and len(right):
            x = left[feats].to_numpy(dtype=float)
            ok = ~np.isnan(x).any(axis=1)
            vals = np.full(len(x), np.nan)
            if ok.any():
                vals[ok] = Forest(right, feats).decide(x[ok])
            res[out] = vals
        return res

    df_cols = list(df.columns)
    return rows.groupBy(*by, "_sl").cogroup(copies.groupBy(*by, "_sl")).applyInPandas(run, schema)


