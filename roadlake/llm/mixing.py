"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; every document of it is expected ``target / size of the
source`` times. The expected copies are prefix-summed within the source, one random offset is added,
and a document is emitted once for each integer boundary its stretch of the sum crosses. Documents are
summed in order of size, so the sample is stratified by size. Documents of over LARGE of a target are
drawn first, and the others' expected copies make up for what was drawn, so that a source of few
documents comes near its target too.

A source may hold any share of the rows: ranks inside a source come from range partitions of
(source, size, doc_id) and a small table of one row per source and partition, never from one task.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.llm.base import column, fresh, materialize

WEIGHTS, CAP, SEED, LARGE = (5, 2, 1), 3.0, 17, 0.02
WORD = r"[^\x20\x09-\x0D]+"


def offset(seed: int = SEED) -> float:
    """The one random offset, a multiple of 2**-20: sums with it stay exact."""
    return random.Random(seed).randrange(1 << 20) / (1 << 20)


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, take ``weights`` in turn and share the sum of all sizes; a
    target stops at ``cap`` times its source's size, and the excess is shared again by weight. That is
    min(cap * size, level * weight) with one level for all: with sources in order of cap * size / weight,
    the level is found at the first source that stays below its cap. Windows here run over sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", turn).withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("reach", F.col("most") / F.col("w"))
    below = Window.orderBy("reach", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("reach", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("place", F.row_number().over(Window.orderBy("reach", F.col("source").isNull(), F.col("source").cast("binary"))))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("reach"), F.col("place"))).over(whole))
    return s.select("source", "source_size", F.least("most", F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and each row's position among the partition's rows of its source."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, seen = object(), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        codes = column(batch, "source").dictionary_encode(null_encoding="encode")
        at = codes.indices.to_numpy(zero_copy_only=False)
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rank = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
        names = codes.dictionary.to_pylist()
        if names[at[0]] == last:
            rank[: head[1] if len(head) > 1 else n] += seen
        last, seen = names[at[-1]], int(rank[-1]) + 1
        out = batch.append_column("part", pa.array(np.full(n, part, np.int32)))
        yield out.append_column("rank", pa.array(rank.astype(np.int64)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, row_key, source, size, source_size, target, copies, taken.

    ``size`` counts words (null text: 0), ``taken`` is copies * size. Without any word all targets are 0
    and nothing is taken. Repeated rows count and are drawn each for itself; ties are taken in order of
    doc_id, and reruns agree.
    """
    rows = materialize(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.xxhash64("text").alias("row_key"), "size"), "mix-sizes")
    goals = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    spread = rows.repartitionByRange(F.col("source"), F.col("size"), F.col("doc_id"), F.col("row_key")).sortWithinPartitions("source", "size", "doc_id", "row_key")
    ranked = materialize(spread.mapInArrow(_ranks, "doc_id long, source string, row_key long, size long, part int, rank long"), "mix-ranks")
    parts = ranked.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    same = parts["source"].eqNullSafe(goals["source"])
    parts = parts.join(goals, same).select(parts["source"], "part", "earlier", "source_size", "target")
    placed = ranked.alias("r").join(parts.alias("p"), (F.col("r.part") == F.col("p.part")) & F.col("r.source").eqNullSafe(F.col("p.source")))
    placed = placed.select("doc_id", "row_key", F.col("r.source").alias("source"), "size", "source_size", "target", (F.col("earlier") + F.col("rank")).alias("place"))
    large = F.col("size") > F.col("target") * LARGE
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def crossed(place: F.Column, rate: F.Column) -> F.Column:
        return F.floor((place + 1) * rate + offset(seed)) - F.floor(place * rate + offset(seed))

    small = placed.groupBy("source").agg(F.count_if(~large).alias("n_small"), F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0)).alias("small_size"))
    placed = placed.alias("d").join(small.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "n_small", "small_size")
    placed = placed.withColumn("first", F.when(large, crossed(F.col("place") - F.col("n_small"), rate)).otherwise(0))
    drawn = placed.groupBy("source").agg(F.sum(F.col("first") * F.col("size")).alias("drawn"))
    placed = placed.alias("d").join(drawn.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "drawn")
    rest = F.when(F.col("small_size") > 0, F.least(F.greatest((F.col("target") - F.col("drawn")) / F.col("small_size"), F.lit(0.0)), F.lit(cap))).otherwise(0.0)
    copies = F.when(large, F.col("first")).otherwise(crossed(F.col("place"), rest))
    out = placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("n_small", "small_size", "first", "drawn")


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``; a document is repeated ``copies`` times."""
    chosen = mix(docs, weights, cap, seed).filter("copies > 0")
    # Rows alike in doc_id, source and text are the same document: their copies are added up, over one of them.
    sums = chosen.groupBy("doc_id", "source", "row_key").agg(F.sum("copies").alias("copies")).alias("s")
    key = fresh("row_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", "source", key]).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col(f"d.{key}") == F.col("s.row_key"))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("s.copies"))).alias(fresh("copy", docs.columns))
    return keyed.join(sums, same).select("d.*", times).select(*docs.columns)


#: DuckDB: the same rows from the same prefix sums.
SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]}.0 WHEN 1 THEN {WEIGHTS[1]}.0 ELSE {WEIGHTS[2]}.0 END::DOUBLE AS w,
  source_size * {CAP}::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
r AS (SELECT *, most / w AS reach FROM w),
l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY reach, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY reach, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY reach, source IS NULL, encode(source)) AS place FROM r),
t AS (SELECT source, source_size, least(most, coalesce(arg_min(level, place) FILTER (WHERE level <= reach) OVER (), 0.0) * w) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS place, d.source, d.size > t.target * CAST({LARGE} AS DOUBLE) AS large
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, count(*) FILTER (WHERE NOT large) OVER (PARTITION BY source) AS n_small, coalesce(sum(size) FILTER (WHERE NOT large) OVER (PARTITION BY source), 0) AS small_size FROM p),
f AS (SELECT *, CASE WHEN large THEN floor((place - n_small + 1) * rate + @@) - floor((place - n_small) * rate + @@) ELSE 0.0 END AS first FROM q),
g AS (SELECT *, sum(first * size) OVER (PARTITION BY source) AS drawn FROM f),
h AS (SELECT *, CASE WHEN small_size > 0 THEN least(greatest((target - drawn) / small_size, 0.0::DOUBLE), {CAP}::DOUBLE) ELSE 0.0::DOUBLE END AS rest FROM g)
SELECT doc_id, size, source_size, target,
  (CASE WHEN large THEN first ELSE floor((place + 1) * rest + @@) - floor(place * rest + @@) END * size)::BIGINT AS taken FROM h
""".replace("@@", f"CAST('{offset()!r}' AS DOUBLE)")
