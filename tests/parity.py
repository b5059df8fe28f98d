"""Runs a registered query in Spark and its SQL in DuckDB and compares them."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def family(t: str) -> str:
    t = t.lower()
    for name, words in (("time", ("timestamp",)), ("date", ("date",)), ("float", ("double", "float")), ("int", ("bigint", "int", "integer", "smallint", "tinyint")),
                        ("text", ("string", "varchar")), ("bool", ("boolean",))):
        if any(t == w or t.startswith(w) for w in words):
            return name
    return t


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    df = fn(spark, sf_dir)
    sc, sr = table(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    dc, dr = table([d[0] for d in res.description], res.fetchall())
    if sc != dc:
        return f"{name}: columns {sc} vs {dc}"
    kinds = {d[0]: family(str(d[1])) for d in res.description}
    odd = [(n, t, kinds[n]) for n, t in df.dtypes if family(t) != kinds[n]]
    if odd:
        return f"{name}: types {odd}"
    if len(sr) != len(dr):
        return f"{name}: {len(sr)} rows vs {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{name}: {len(bad)} of {len(sr)} rows differ, e.g. {bad[0]} {sc}"
    return f"{name}: ok {len(sr)}" if sr else f"{name}: EMPTY"
