"""Column helpers: units, bands, labels, time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

G = 9.80665
# Fixed values: (warn, danger) limits of the display signals; None = no such limit.
BANDS = {"throttle_pct": (85.0, None), "engine_load_pct": (70.0, 90.0), "coolant_temp_c": (100.0, 115.0), "rpm": (None, 6000.0)}
# Display ranges.
GAUGES = {"speed_kmh": (0.0, 220.0), "rpm": (0.0, 7000.0), "coolant_temp_c": (0.0, 130.0)}


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_to_ts(c: str | Column) -> Column:
    """Epoch seconds to a timestamp at microsecond precision."""
    return F.timestamp_micros(F.round(_c(c) * F.lit(1e6)).cast("long"))


def to_display_tz(c: str | Column, tz: str) -> Column:
    return F.from_utc_timestamp(_c(c), tz)


def iso_text(c: str | Column) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def no_nan(c: str | Column) -> Column:
    """Missing is null: NaN readings become it where they enter."""
    return F.nullif(_c(c), F.lit(float("nan")))


def kmh_to_ms(c: str | Column) -> Column:
    return _c(c) / F.lit(3.6)


def to_g(c: str | Column) -> Column:
    return _c(c) / F.lit(G)


def planar_g(x: str | Column, y: str | Column) -> Column:
    return F.hypot(_c(x), _c(y)) / F.lit(G)


def counts_to_ms2(c: str | Column) -> Column:
    """Raw +-2 g sensor counts to m/s^2."""
    return _c(c) * F.lit(9.81) / F.lit(16384.0)


def null_out_of_range(c: str | Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.when(_c(c).between(F.lit(lo), F.lit(hi)), _c(c))


def band(c: str | Column, warn: float | None, danger: float | None) -> Column:
    out = F.when(_c(c).isNull() | F.isnan(_c(c)), "missing")
    if danger is not None:
        out = out.when(_c(c) >= danger, "danger")
    if warn is not None:
        out = out.when(_c(c) >= warn, "warn")
    return out.otherwise("ok")


def gauge_fraction(c: str | Column, lo: float, hi: float) -> Column:
    """Share of the display range; a missing value sits at the low end."""
    v = F.coalesce(_c(c), F.lit(lo))
    return (F.least(F.greatest(v, F.lit(lo)), F.lit(hi)) - F.lit(lo)) / F.lit(hi - lo)


def gauge_angle(c: str | Column, lo: float, hi: float, start_deg: float, sweep_deg: float) -> Column:
    return F.lit(start_deg) + gauge_fraction(c, lo, hi) * F.lit(sweep_deg)


def plausibility(flag_pct: str | Column, expected_pct: str | Column) -> Column:
    return F.when(_c(flag_pct) <= _c(expected_pct) * 2, "plausible").otherwise("elevated")


def fmt_duration(c: str | Column) -> Column:
    s = _c(c)
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), F.floor(s % 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    text = F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m"))).otherwise(
        F.concat(m.cast("string"), F.lit("m "), two(sec), F.lit("s"))
    )
    return F.when(s.isNull(), "--").otherwise(text)


def session_label(name: str = "name", started: str = "started_at", ended: str = "ended_at") -> Column:
    title = F.coalesce(F.nullif(_c(name), F.lit("")), F.lit("Untitled session"))
    live = F.when(_c(ended).isNull(), " · live").otherwise("")
    return F.concat(title, F.lit(" · "), F.date_format(_c(started), "MMM d, HH:mm"), live)


def new_id() -> Column:
    """A random 32-digit hex id."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
