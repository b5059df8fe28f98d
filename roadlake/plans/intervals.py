"""Interval joins: a row belongs to every session whose closed interval holds it.

The theta join becomes an equi join on time slots.  The slot width is the mean
session length, so the exploded session table has at most three rows per
session however uneven the lengths are; it is broadcast only when that bound is
small, and otherwise joined by shuffle, where AQE splits a hot slot.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.plans import segmented as sg

BROADCAST_SLOTS = 200_000
_SLOT = "_slot"


def closed_sessions(sessions: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """Sessions with an effective end: open ones reach to ``now``."""
    end = F.lit(now) if now is not None else F.current_timestamp()
    return sessions.withColumn("_hi", F.coalesce("ended_at", end))


def _slot_of(c: Column, width_us: int) -> Column:
    return F.floor(F.unix_micros(c) / F.lit(width_us)).cast("long")


def _slots(sessions: DataFrame, now: dt.datetime | None, keep: Sequence[str]) -> tuple[DataFrame, int, dict]:
    s = closed_sessions(sessions, now).where(F.col("_hi") >= F.col("started_at"))
    span = F.unix_micros("_hi") - F.unix_micros("started_at")
    b = s.agg(
        F.count(F.lit(1)).alias("n"), F.avg(span).alias("mean"), F.min("started_at").alias("lo"), F.max("_hi").alias("hi")
    ).first()
    width = max(1_000_000, int(b["mean"] or 0))
    slots = s.select(*keep, "started_at", "_hi",
                     F.explode(F.sequence(_slot_of(F.col("started_at"), width), _slot_of(F.col("_hi"), width))).alias(_SLOT))
    small = 3 * b["n"] <= BROADCAST_SLOTS
    return (F.broadcast(slots) if small else slots), width, b.asDict()


def _within(time: str, bounds: dict) -> Column:
    """Static outer bounds, so that the scan of a time series can be pruned."""
    if bounds["lo"] is None:
        return F.lit(False)
    return F.col(time).between(F.lit(bounds["lo"]), F.lit(bounds["hi"]))


def session_rows(tel: DataFrame, sessions: DataFrame, now: dt.datetime | None = None, by: Sequence[str] = (),
                 time: str = "time", session_cols: Sequence[str] = ("session_id",)) -> DataFrame:
    """Rows joined to their sessions; ``by`` adds equal keys such as the node."""
    slots, width, bounds = _slots(sessions, now, [*session_cols, *by])
    t = tel.where(_within(time, bounds)).withColumn(_SLOT, _slot_of(F.col(time), width))
    t, s = t.alias("t"), slots.alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in [_SLOT, *by]]
    cond = F.col(f"t.{time}").between(F.col("s.started_at"), F.col("s._hi"))
    for c in on:
        cond = cond & c
    return t.join(s, cond).select(*[F.col(f"s.{c}") for c in session_cols], *[F.col(f"t.{c}") for c in tel.columns])


def count_in_intervals(rows: DataFrame, intervals: DataFrame, ident: str, start: str, end: str, by: Sequence[str] = (), time: str = "time") -> DataFrame:
    """(ident, n): how many rows lie in each interval, both ends included.

    A count is the difference of two: rows up to the end less rows before the start.
    Rows are counted by minute first; a running sum over the minutes gives what lies
    before the minute of an edge, and only rows in the minutes of edges are looked
    at one by one.  Intervals whose end comes first hold none.
    """
    by = list(by)
    good = intervals.where(F.col(end) >= F.col(start))
    b = good.agg(F.min(start).alias("lo"), F.max(end).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    edge = lambda at, inclusive, sign: F.struct(F.col(at).alias("at"), F.lit(inclusive).alias("inclusive"), F.lit(sign).alias("sign"))
    edges = good.select(F.col(ident).alias("_id"), *by, F.explode(F.array(edge(start, False, -1), edge(end, True, 1))).alias("_e"))
    edges = edges.select("_id", *by, sg.time_segment("_e.at", 60).alias("_minute"), "_e.*")
    r = rows.where(_within(time, b.asDict())).select(*by, F.col(time).alias("_time")).withColumn("_minute", sg.time_segment("_time", 60))

    per_minute = r.groupBy(*by, "_minute").agg(F.count(F.lit(1)).alias("_n")).withColumn("_kind", F.lit(1))
    both = per_minute.unionByName(edges.withColumns({"_kind": F.lit(0), "_n": F.lit(0)}), allowMissingColumns=True)
    both = both.withColumn(sg.SEG, F.floor(F.col("_minute") / 1440).cast("long"))
    whole = sg.running_sum(both, by, ["_minute", "_kind"], {"_before": F.col("_n")}).where("_kind = 0").select("_id", (F.col("sign") * F.col("_before")).alias("_c"))

    minutes = edges.select(*by, "_minute").distinct()
    near = r.join(F.broadcast(minutes) if 2 * b["n"] <= BROADCAST_SLOTS else minutes, [*by, "_minute"], "left_semi")
    instants = near.groupBy(*by, "_minute", "_time").agg(F.count(F.lit(1)).alias("_n"))
    upto = (F.col("_time") < F.col("at")) | (F.col("inclusive") & (F.col("_time") == F.col("at")))
    parts = edges.join(instants, [*by, "_minute"]).where(upto).select("_id", (F.col("sign") * F.col("_n")).alias("_c"))
    return whole.unionByName(parts).groupBy(F.col("_id").alias(ident)).agg(F.sum("_c").alias("n"))


def list_sessions(tel: DataFrame, sessions: DataFrame, now: dt.datetime | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Every session with its row count, sessions without rows kept."""
    n = count_in_intervals(tel, closed_sessions(sessions, now), "session_id", "started_at", "_hi", by).withColumnRenamed("n", "row_count")
    return (
        sessions.join(n, "session_id", "left")
        .withColumn("row_count", F.coalesce("row_count", F.lit(0)).cast("long"))
        .orderBy("started_at")
    )


def orphans(tel: DataFrame, sessions: DataFrame, now: dt.datetime | None = None, time: str = "time") -> DataFrame:
    """Rows that lie in no session."""
    slots, width, _ = _slots(sessions, now, [])
    t = tel.withColumn(_SLOT, _slot_of(F.col(time), width)).alias("t")
    s = slots.alias("s")
    cond = (F.col(f"t.{_SLOT}") == F.col(f"s.{_SLOT}")) & F.col(f"t.{time}").between(F.col("s.started_at"), F.col("s._hi"))
    return t.join(s, cond, "left_anti").drop(_SLOT)


def get_session(sessions: DataFrame, session_id: str) -> DataFrame:
    """One session by id; a missing one is an error."""
    one = sessions.where(F.col("session_id") == F.lit(session_id))
    if not one.take(1):
        raise LookupError(f"session not found: {session_id}")
    return one


def rows_of(tel: DataFrame, sessions: DataFrame, session_id: str, now: dt.datetime | None = None,
            time: str = "time") -> DataFrame:
    """Rows of a single session: its two bounds become literals the scan can use."""
    s = closed_sessions(get_session(sessions, session_id), now).select("started_at", "_hi").first()
    return tel.where(F.col(time).between(F.lit(s["started_at"]), F.lit(s["_hi"])))


def between(tel: DataFrame, start: dt.datetime, end: dt.datetime, time: str = "time", date_col: str | None = None) -> DataFrame:
    """Rows of an explicit range in time order; prunes date partitions too."""
    cond = F.col(time).between(F.lit(start), F.lit(end))
    if date_col:
        cond = cond & F.col(date_col).between(F.lit(start.date()), F.lit(end.date()))
    return tel.where(cond).orderBy(time)


def around(df: DataFrame, anchor: dt.datetime, before_s: float = 10, after_s: float = 1800, time: str = "time") -> DataFrame:
    """the stretch around an instant, both ends included."""
    return df.where(
        F.col(time).between(F.lit(anchor - dt.timedelta(seconds=before_s)), F.lit(anchor + dt.timedelta(seconds=after_s)))
    )
