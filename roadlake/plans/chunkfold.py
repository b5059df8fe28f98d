"""Ordered folds with carried state, run in parallel over segments of a key.

Some operators walk a key in time order and carry a small state (which partner
rows are taken, the last accepted reading).  A whole key in one task would not
scale, so every segment first guesses its incoming state by warming up on the
rows just before it.  The guess is then compared with the state the previous
segment really ended in, and only segments that guessed wrong are run again from
the true state, until all agree.  A segment that leaves its state as it found it
hands on that of the last one that changed it, so a state may pass any number
of quiet segments in one round.  The result is exactly that of one sequential
walk; the warm-up only decides how many rounds it takes, in practice one or two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake.plans.segmented import SEG, suggest_seconds
from roadlake.session import materialize

# fold(rows, state or None, start_us, end_us) -> (output rows, state at start, state at end)
#: Rows that one pandas group should hold at most.
GROUP_ROWS = 200_000
Fold = Callable[[pd.DataFrame, str | None, int, int], tuple[pd.DataFrame, str, str]]
Carry = Callable[[str, int], str]


def _pieces(df: DataFrame, us: str, width: int, back: int, ahead: int) -> DataFrame:
    own = F.floor(F.col(us) / width).cast("long")
    places = [own]
    places.append(F.when(F.col(us) >= (own + 1) * width - back, own + 1))
    if ahead:
        places.append(F.when(F.col(us) < own * width + ahead, own - 1))
    return df.withColumn(SEG, F.explode(F.array_compact(F.array(*places))))


def fitting(df: DataFrame, keys: Sequence[str], time: str | Column, segment_s: float) -> float:
    """A length of segments that keeps the densest within a group; counts the rows."""
    return suggest_seconds(df, keys, time, segment_s, GROUP_ROWS)


def chunked_fold(df: DataFrame, keys: Sequence[str], us: str, order: Sequence[str], fold: Fold, out: T.StructType, segment_s: float = 600,
                 warmup_s: float = 10, ahead_s: float = 0, carry: Carry = lambda state, start: state, fits: bool = False) -> DataFrame:
    """Rows of ``out`` (keys first) from folding each key of ``df`` along ``order``.

    ``us`` holds epoch microseconds.  Segments of ``segment_s`` are halved where rows are dense,
    unless they are known to fit (:func:`fitting`).  ``carry`` restates a state for a later
    start, for folds that forget rows by age.
    """
    keys, order = list(keys), list(order)
    # As long as the densest segment fits a group, but never shorter than what is read beside it.
    segment_s = max(segment_s if fits else fitting(df, keys, F.timestamp_micros(us), segment_s), 2 * (warmup_s + ahead_s), 1)
    width, back, ahead = (int(s * 1e6) for s in (segment_s, warmup_s, ahead_s))
    key_fields = [df.schema[k] for k in keys]
    names = [f.name for f in out.fields]
    schema = T.StructType(out.fields + [T.StructField(SEG, T.LongType()), T.StructField("_in", T.StringType()), T.StructField("_out", T.StringType())])

    def run(pdf: pd.DataFrame, state: str | None) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="mergesort").reset_index(drop=True)
        seg = int(pdf[SEG].iloc[0])
        rows, before, after = fold(pdf, state, seg * width, (seg + 1) * width)
        for k in keys:
            rows[k] = pdf[k].iloc[0]
        rows = rows.reindex(columns=names)
        rows["_in"], rows["_out"] = None, None
        mark = {**{k: pdf[k].iloc[0] for k in keys}, "_in": before, "_out": after}
        rows = pd.concat([rows.astype(object), pd.DataFrame([mark], dtype=object)], ignore_index=True)
        rows[SEG] = seg
        return rows[schema.names]

    pieces = _pieces(df, us, width, back, ahead)
    done = materialize(pieces.groupBy(*keys, SEG).applyInPandas(lambda pdf: run(pdf, None), schema), "fold")

    wrong_schema = T.StructType([*key_fields, T.StructField(SEG, T.LongType()), T.StructField("_state", T.StringType())])

    def disagree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m in batches:
            true = [carry(s, int(g) * width) for s, g in zip(m["_prev"], m[SEG])]
            yield m.assign(_state=true)[[t != s for t, s in zip(true, m["_in"])]][wrong_schema.names]

    by_time = Window.partitionBy(*keys).orderBy(SEG)
    while True:
        marks = done.where(F.col("_out").isNotNull()).select(*keys, SEG, "_in", "_out")
        first = F.row_number().over(by_time) == 1  # its state is true; what it ends in is handed on even if unchanged
        marks = marks.withColumn("_says", F.when(first | ~F.col("_in").eqNullSafe(F.col("_out")), F.col("_out")))
        earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
        marks = marks.select("*", F.last("_says", ignorenulls=True).over(earlier).alias("_prev")).where(F.col("_prev").isNotNull())
        wrong = materialize(marks.mapInPandas(disagree, wrong_schema), "fold-wrong")
        if not wrong.take(1):
            return done.where(F.col("_out").isNull()).select(*names)
        # A state goes to its segment once, beside the rows and not on each of them.
        redo = pieces.join(wrong.select(*keys, SEG), [*keys, SEG], "left_semi").groupBy(*keys, SEG).cogroup(wrong.groupBy(*keys, SEG))
        # Only the repaired segments are written; the others stay where they are.
        again = materialize(redo.applyInPandas(lambda pdf, told: run(pdf, told["_state"].iloc[0]), schema), "fold")
        done = done.join(wrong.select(*keys, SEG), [*keys, SEG], "left_anti").select(*schema.names).unionByName(again)
