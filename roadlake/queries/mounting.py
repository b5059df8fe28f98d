"""Mount calibration over logged samples: C1-C14, F20."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlake import fixtures as fx
from roadlake.functions import rotation as ro
from roadlake.operators import mount as mo
from roadlake.queries.base import rounded

V = ["vehicle_id"]
CFG = {"trigger": 0.15, "end": 0.05, "min_samples": 4, "max_samples": 6}
LOCK = {"min_windows": 3, "min_corr": 0.4, "tolerance": 20.0}


def log(s, d):
    return fx.mount_log(s, d)


def fresh(s, d):
    return mo.fresh_samples(log(s, d))


def ticks(s, d):
    return mo.interval_means(fresh(s, d))


def windows(s, d):
    return mo.event_windows(ticks(s, d).where("mark = 'fresh'"), **CFG)


def stats(s, d):
    return mo.window_stats(windows(s, d))


def pooled(s, d):
    return mo.pooled_heading(stats(s, d), **LOCK)


def states(s, d):
    return mo.calibrate(mo.calibration_events(log(s, d)), **CFG, **LOCK)


def tilt(s, d):
    t = fx.telemetry(s, d)
    x, y, z = F.col("accel_x"), F.coalesce("accel_y", F.lit(0.0)), F.when(F.col("event_id") % 5 == 0, -F.col("accel_z")).otherwise(F.col("accel_z"))
    t = t.select("event_id", x.alias("x"), y.alias("y"), z.alias("z")).withColumn("m", ro.tilt_matrix(F.col("x"), F.col("y"), F.col("z")))
    u = ro.apply_matrix(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    back = ro.apply_matrix(F.col("m"), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return rounded(t.select("event_id", *[c.alias(n) for n, c in zip(("gx", "gy", "gz"), u)], *[c.alias(n) for n, c in zip(("px", "py", "pz"), back)]))


_TILT = f"""WITH {fx.TEL}, t AS (SELECT event_id, accel_x AS x, COALESCE(accel_y, 0) AS y, CASE WHEN event_id % 5 = 0 THEN -accel_z ELSE accel_z END AS z FROM tel),
 n AS (SELECT *, x / SQRT(x*x + y*y + z*z) AS a, y / SQRT(x*x + y*y + z*z) AS b, z / SQRT(x*x + y*y + z*z) AS c FROM t), k AS (SELECT *, a*a + b*b AS s, CASE WHEN SQRT(a*a + b*b) >= 0.000001 THEN (1 - c) / (a*a + b*b) END AS k FROM n),
 q AS (SELECT event_id, x, y, z, UNNEST([CASE WHEN k IS NOT NULL THEN [1-k*a*a, -k*a*b, -a, -k*a*b, 1-k*b*b, -b, a, b, 1-k*s] WHEN c > 0 THEN [1.0::DOUBLE,0,0,0,1,0,0,0,1] ELSE [1.0::DOUBLE,0,0,0,-1,0,0,0,-1] END]) AS m FROM k)
 SELECT event_id, ROUND(m[1]*x + m[2]*y + m[3]*z, 6) AS gx, ROUND(m[4]*x + m[5]*y + m[6]*z, 6) AS gy, ROUND(m[7]*x + m[8]*y + m[9]*z, 6) AS gz,
 ROUND(m[1] + m[2]*2 + m[3]*3, 6) AS px, ROUND(m[4] + m[5]*2 + m[6]*3, 6) AS py, ROUND(m[7] + m[8]*2 + m[9]*3, 6) AS pz FROM q"""

# one recursion step per sample position, all vehicles at once
_FRESH = (fx.MOUNT + """, o AS MATERIALIZED (SELECT *, EPOCH_US(time) AS us, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY time, event_id) AS pos FROM ml),
 w AS (SELECT vehicle_id, 0::BIGINT AS pos, NULL::BIGINT AS event_id, NULL::VARCHAR AS mark, NULL::DOUBLE AS ref_accel, us AS anc, 0::DOUBLE AS v FROM o WHERE pos = 1
  UNION ALL SELECT vehicle_id, pos, event_id, mark, CASE mark WHEN 'fresh' THEN (s - v) / 3.6::DOUBLE / ((us - anc) / 1000000.0::DOUBLE) END, CASE WHEN mark IS NULL THEN anc ELSE us END, CASE WHEN mark IS NULL THEN v ELSE s END
  FROM (SELECT o.vehicle_id, o.pos, o.event_id, o.us, o.speed_kmh AS s, w.anc, w.v, CASE WHEN o.speed_kmh <> w.v AND o.us - w.anc >= 3000000 THEN 'anchor' WHEN o.speed_kmh <> w.v AND o.us - w.anc >= 1000000 THEN 'fresh' END AS mark
    FROM w JOIN o ON o.vehicle_id = w.vehicle_id AND o.pos = w.pos + 1)),
 fr AS MATERIALIZED (SELECT o.*, w.mark, w.ref_accel FROM w JOIN o USING (vehicle_id, event_id))""")
_TICKS = _FRESH + """, iv AS (SELECT *, COALESCE(SUM((mark IS NOT NULL)::INT) OVER (PARTITION BY vehicle_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS iv FROM fr),
 im AS (SELECT vehicle_id, iv, AVG(ax) AS mx, AVG(ay) AS my, AVG(az) AS mz FROM iv GROUP BY 1, 2),
 tk AS MATERIALIZED (SELECT iv.* REPLACE (CASE mark WHEN 'fresh' THEN mx ELSE ax END AS ax, CASE mark WHEN 'fresh' THEN my ELSE ay END AS ay, CASE mark WHEN 'fresh' THEN mz ELSE az END AS az) FROM iv JOIN im USING (vehicle_id, iv))"""
_WIN = _TICKS + """, f AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY us, event_id) AS k FROM tk WHERE mark = 'fresh'),
 e AS (SELECT vehicle_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS window_id, NULL::BIGINT AS opened, 0 AS n, FALSE AS closes FROM f WHERE k = 1
  UNION ALL SELECT vehicle_id, k, event_id, CASE WHEN opened IS NOT NULL THEN opened WHEN hot THEN us END, CASE WHEN opened IS NULL THEN CASE WHEN hot THEN us END WHEN shut THEN NULL ELSE opened END,
   CASE WHEN opened IS NULL THEN CASE WHEN hot THEN 1 ELSE 0 END WHEN shut THEN 0 ELSE n + 1 END, opened IS NOT NULL AND shut FROM
   (SELECT f.vehicle_id, f.k, f.event_id, f.us, e.opened, e.n, ABS(ref) >= 0.15 AS hot, e.n + 1 >= 6 OR ABS(ref) < 0.05 AS shut FROM e JOIN (SELECT *, ref_accel AS ref FROM f) f ON f.vehicle_id = e.vehicle_id AND f.k = e.k + 1)),
 ok AS (SELECT vehicle_id, window_id FROM e WHERE window_id IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 4 AND MAX(closes::INT) = 1),
 wn AS MATERIALIZED (SELECT f.*, window_id FROM e JOIN ok USING (vehicle_id, window_id) JOIN f USING (vehicle_id, event_id))"""
_STATS = _WIN + """, s0 AS (SELECT vehicle_id, window_id, COUNT(*) AS n, CORR(ax, ref_accel) AS corr_x, CORR(ay, ref_accel) AS corr_y, COVAR_POP(ax, ref_accel) * COUNT(*) AS cov_xr, COVAR_POP(ay, ref_accel) * COUNT(*) AS cov_yr,
   VAR_POP(ax) * COUNT(*) AS sxx, VAR_POP(ay) * COUNT(*) AS syy, COVAR_POP(ax, ay) * COUNT(*) AS sxy, VAR_POP(ref_accel) * COUNT(*) AS srr FROM wn GROUP BY 1, 2),
 s1 AS (SELECT *, CASE WHEN GREATEST(ABS(corr_x), ABS(corr_y)) < 0.5 OR ABS(ABS(corr_x) - ABS(corr_y)) < 0.15 THEN 'undetermined' WHEN ABS(corr_x) > ABS(corr_y) THEN 'x' ELSE 'y' END AS axis, ATAN2(cov_yr, cov_xr) AS th FROM s0),
 s2 AS MATERIALIZED (SELECT *, CASE axis WHEN 'x' THEN CASE WHEN corr_x >= 0 THEN 1 ELSE -1 END WHEN 'y' THEN CASE WHEN corr_y >= 0 THEN 1 ELSE -1 END ELSE 0 END AS forward_sign FROM s1)"""
_PROJ = "(COS(th)*cov_xr + SIN(th)*cov_yr) / SQRT((COS(th)*COS(th)*sxx + 2*COS(th)*SIN(th)*sxy + SIN(th)*SIN(th)*syy) * srr)"
_POOL = _STATS + """, c0 AS (SELECT vehicle_id, window_id, COUNT(*) OVER w AS n_windows, SUM(cov_xr) OVER w AS cov_xr, SUM(cov_yr) OVER w AS cov_yr, SUM(sxx) OVER w AS sxx, SUM(syy) OVER w AS syy, SUM(sxy) OVER w AS sxy, SUM(srr) OVER w AS srr
   FROM s2 WINDOW w AS (PARTITION BY vehicle_id ORDER BY window_id ROWS UNBOUNDED PRECEDING)), c1 AS (SELECT *, ATAN2(cov_yr, cov_xr) AS th FROM c0),
 c2 AS (SELECT *, DEGREES(th) AS pooled_deg, %s AS pooled_corr, LAG(DEGREES(th)) OVER w AS p1, LAG(DEGREES(th), 2) OVER w AS p2 FROM c1 WINDOW w AS (PARTITION BY vehicle_id ORDER BY window_id)),
 c3 AS (SELECT *, n_windows >= 3 AND pooled_corr >= 0.4 AND p2 IS NOT NULL AND ABS((p1 - pooled_deg + 900) %% 360 - 180) <= 20 AND ABS((p2 - pooled_deg + 900) %% 360 - 180) <= 20 AS lockable FROM c2)""" % _PROJ
_GRAV = ", st AS (SELECT *, speed_kmh < 1 AS st, LAG(speed_kmh < 1) OVER (PARTITION BY vehicle_id ORDER BY time, event_id) AS pst FROM {t}), rn AS (SELECT *, SUM((pst IS NULL OR pst <> st)::INT) OVER (PARTITION BY vehicle_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS run FROM st), " \
        "ps AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY vehicle_id, run ORDER BY time, event_id) - 1) // 20 AS blk FROM rn WHERE st) " \
        "SELECT vehicle_id, MAX(time) AS time, ARG_MAX(event_id, (time, event_id)) AS event_id, ROUND(AVG(ax), 6) AS gx, ROUND(AVG(ay), 6) AS gy, ROUND(AVG(az), 6) AS gz FROM ps GROUP BY vehicle_id, run, blk HAVING COUNT(*) = 20"

# the stage machine, one recursion step per reduced event, all vehicles at once
_ZERO = "[0.0::DOUBLE, 0, 0, 0, 0, 0]"
_NEW = "[1-k*a*a, -k*a*b, -a, -k*a*b, 1-k*b*b, -b, a, b, 1-k*(a*a + b*b)]"
_DOT = lambda p, q: f"pool[{{}}] + LIST_SUM(LIST_TRANSFORM(nb, LAMBDA e: (e.{p} - m{p}) * (e.{q} - m{q})))"
_SUMS = ", ".join(_DOT(p, q).format(i + 1) for i, (p, q) in enumerate(("xr", "yr", "xx", "yy", "xy", "rr")))
_MEAN = ", ".join(f"LIST_AVG(LIST_TRANSFORM(nb, LAMBDA e: e.{c})) AS m{c}" for c in "xyr")
_STATES = _TICKS + _GRAV.format(t="tk").replace(" SELECT vehicle_id, MAX(time) AS time,", " gb AS MATERIALIZED (SELECT vehicle_id, MAX(time) AS time,").replace("ps AS (", "gp AS (").replace("FROM ps GROUP", "FROM gp GROUP").replace("WHERE st) gb", "WHERE st), gb").replace(
    "ROUND(AVG(ax), 6)", "AVG(ax)").replace("ROUND(AVG(ay), 6)", "AVG(ay)").replace("ROUND(AVG(az), 6)", "AVG(az)") + f"""),
 ev AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY us, event_id, kind) AS pos FROM (
   SELECT vehicle_id, EPOCH_US(time) AS us, event_id, 0 AS kind, gx AS x, gy AS y, gz AS z, 0.0::DOUBLE AS ref FROM gb UNION ALL SELECT vehicle_id, us, event_id, 1, ax, ay, az, ref_accel FROM tk WHERE mark = 'fresh')),
 sm AS (SELECT vehicle_id, 0::BIGINT AS pos, NULL::BIGINT AS us, NULL::BIGINT AS tick, NULL::DOUBLE[] AS tilt, NULL::DOUBLE AS yaw, 0 AS resets, []::STRUCT(x DOUBLE, y DOUBLE, r DOUBLE)[] AS buf, {_ZERO} AS pool, 0 AS windows, []::DOUBLE[] AS angles, FALSE AS changed
   FROM ev WHERE pos = 1 UNION ALL
  SELECT vehicle_id, pos, us, CASE WHEN grav THEN event_id ELSE tick END, CASE WHEN grav THEN nt ELSE tilt END, CASE WHEN reset THEN NULL WHEN locks THEN deg ELSE yaw END, resets + reset::INT,
   CASE WHEN reset OR shut THEN [] ELSE nb END, CASE WHEN reset THEN {_ZERO} ELSE np END, CASE WHEN reset THEN 0 ELSE nw END, CASE WHEN reset THEN [] ELSE na END, grav OR locks FROM
   (SELECT *, known AND nw >= {LOCK['min_windows']} AND corr >= {LOCK['min_corr']} AND LEN(na) = 3 AND LEN(LIST_FILTER(na, LAMBDA p: ABS((p - deg + 900) % 360 - 180) <= {LOCK['tolerance']})) = 3 AS locks FROM
   (SELECT *, CASE WHEN known THEN LIST_APPEND(angles, deg)[-3:] ELSE angles END AS na, CASE WHEN den > 0.000000001 THEN (COS(th) * np[1] + SIN(th) * np[2]) / den ELSE 0 END AS corr FROM
   (SELECT *, DEGREES(th) AS deg, SQRT((COS(th) * COS(th) * np[3] + 2 * COS(th) * SIN(th) * np[5] + SIN(th) * SIN(th) * np[4]) * np[6]) AS den FROM
   (SELECT *, ATAN2(np[2], np[1]) AS th, whole AND NOT (ABS(np[1]) < 0.000000001 AND ABS(np[2]) < 0.000000001) AS known FROM
   (SELECT *, CASE WHEN whole THEN [{_SUMS}] ELSE pool END AS np, windows + whole::INT AS nw FROM
   (SELECT *, shut AND LEN(nb) >= {CFG['min_samples']} AS whole, {_MEAN} FROM
   (SELECT *, CASE WHEN NOT can THEN buf WHEN LEN(buf) > 0 THEN LIST_APPEND(buf, now) WHEN ABS(ref) >= {CFG['trigger']} THEN [now] ELSE buf END AS nb,
     can AND LEN(buf) > 0 AND (LEN(buf) + 1 >= {CFG['max_samples']} OR ABS(ref) < {CFG['end']}) AS shut FROM
   (SELECT *, {{'x': tilt[1]*x + tilt[2]*y + tilt[3]*z, 'y': tilt[4]*x + tilt[5]*y + tilt[6]*z, 'r': ref}} AS now, grav AND tilt IS NOT NULL AS reset, CASE WHEN SQRT(a*a + b*b) >= 0.000001 THEN {_NEW} WHEN c > 0 THEN [1.0::DOUBLE,0,0,0,1,0,0,0,1] ELSE [1.0::DOUBLE,0,0,0,-1,0,0,0,-1] END AS nt FROM
   (SELECT *, (1 - c) / (a*a + b*b) AS k, kind = 1 AND tilt IS NOT NULL AND yaw IS NULL AND event_id IS DISTINCT FROM tick AS can,
     kind = 0 AND (tilt IS NULL OR (ABS(size - 9.81) <= 1.5 AND DEGREES(ACOS(LEAST(GREATEST((tilt[7]*x + tilt[8]*y + tilt[9]*z) / size, -1), 1))) > 15)) AS grav FROM
   (SELECT ev.vehicle_id, ev.pos, ev.us, ev.event_id, ev.kind, ev.x, ev.y, ev.z, ev.ref, SQRT(ev.x*ev.x + ev.y*ev.y + ev.z*ev.z) AS size, ev.x / SQRT(ev.x*ev.x + ev.y*ev.y + ev.z*ev.z) AS a, ev.y / SQRT(ev.x*ev.x + ev.y*ev.y + ev.z*ev.z) AS b,
      ev.z / SQRT(ev.x*ev.x + ev.y*ev.y + ev.z*ev.z) AS c, sm.tick, sm.tilt, sm.yaw, sm.resets, sm.buf, sm.pool, sm.windows, sm.angles FROM sm JOIN ev ON ev.vehicle_id = sm.vehicle_id AND ev.pos = sm.pos + 1))))))))))),
 cs AS MATERIALIZED (SELECT vehicle_id, us AS from_us, CASE WHEN yaw IS NULL THEN 'needs_yaw' ELSE 'ready' END AS stage, tilt, yaw AS yaw_deg, TRUE AS tilt_valid, yaw IS NOT NULL AS yaw_valid, resets AS tilt_resets,
   LEAD(us) OVER (PARTITION BY vehicle_id ORDER BY us, resets, yaw IS NOT NULL) AS to_us FROM sm WHERE changed)"""
_TURN = "{p} * COS(RADIANS(yaw_deg)) {o} {q} * SIN(RADIANS(yaw_deg))"
_CORRECTED = _STATES + f""", co AS (SELECT ml.vehicle_id, event_id, COALESCE(tilt[1]*ax + tilt[2]*ay + tilt[3]*az, ax) AS x, COALESCE(tilt[4]*ax + tilt[5]*ay + tilt[6]*az, ay) AS y, COALESCE(tilt[7]*ax + tilt[8]*ay + tilt[9]*az, az) AS up,
   yaw_deg, COALESCE(yaw_valid, FALSE) AS turned, tilt IS NULL AS raw FROM ml LEFT JOIN cs ON ml.vehicle_id = cs.vehicle_id AND EPOCH_US(time) >= from_us AND (to_us IS NULL OR EPOCH_US(time) < to_us))
 SELECT vehicle_id, event_id, ROUND(CASE WHEN turned THEN {_TURN.format(p='x', q='y', o='+')} ELSE x END, 5) AS forward, ROUND(CASE WHEN turned THEN {_TURN.format(p='y', q='x', o='-')} ELSE y END, 5) AS lateral,
  ROUND(up, 5) AS up, CASE WHEN raw THEN 'raw' WHEN turned THEN 'full' ELSE 'tilt' END AS corrected FROM co"""

QUERIES = {
    "tilt_matrix": (tilt, _TILT),
    "speed_accel": (lambda s, d: rounded(mo.speed_accel(log(s, d)).select("event_id", "speed_kmh", "ref_accel")), f"""WITH {fx.MOUNT}, l AS (SELECT *, LAG(speed_kmh) OVER w AS pv, (EPOCH_US(time) - LAG(EPOCH_US(time)) OVER w) / 1000000.0::DOUBLE AS dt FROM ml WINDOW w AS (PARTITION BY vehicle_id ORDER BY time, event_id))
      SELECT event_id, speed_kmh, ROUND(CASE WHEN dt > 0.001 THEN (speed_kmh - pv) / 3.6::DOUBLE / dt ELSE 0 END, 6) AS ref_accel FROM l"""),
    "gravity_blocks": (lambda s, d: rounded(mo.gravity_blocks(log(s, d))), f"WITH {fx.MOUNT}" + _GRAV.format(t="ml")),
    "fresh_speed_samples": (lambda s, d: rounded(fresh(s, d).select("event_id", "mark", "ref_accel")), f"WITH RECURSIVE {_FRESH} SELECT event_id, mark, ROUND(ref_accel, 6) AS ref_accel FROM fr"),
    "interval_means": (lambda s, d: rounded(ticks(s, d).select("event_id", "mark", "ax", "ay", "az")), f"WITH RECURSIVE {_TICKS} SELECT event_id, mark, ROUND(ax, 6) AS ax, ROUND(ay, 6) AS ay, ROUND(az, 6) AS az FROM tk"),
    "event_windows": (lambda s, d: windows(s, d).select("vehicle_id", "event_id", "window_id"), f"WITH RECURSIVE {_WIN} SELECT vehicle_id, event_id, window_id FROM wn"),
    "window_stats": (lambda s, d: rounded(stats(s, d), 5), f"WITH RECURSIVE {_STATS} SELECT vehicle_id, window_id, n, " + ", ".join(f"ROUND({c}, 5) AS {c}" for c in ("corr_x", "corr_y", "cov_xr", "cov_yr", "sxx", "syy", "sxy", "srr"))
                     + f", axis, forward_sign, ROUND(DEGREES(th), 5) AS heading_deg, ROUND({_PROJ}, 5) AS projected_corr FROM s2"),
    "axis_lock": (lambda s, d: mo.axis_lock(stats(s, d)).select("vehicle_id", "window_id", "axis", "forward_sign", "streak", "locked"), f"""WITH RECURSIVE {_STATS}, d AS (SELECT *, axis || forward_sign AS a, LAG(axis || forward_sign) OVER (PARTITION BY vehicle_id ORDER BY window_id) AS pa FROM s2 WHERE axis <> 'undetermined'),
      g AS (SELECT *, SUM((pa IS NULL OR pa <> a)::INT) OVER (PARTITION BY vehicle_id ORDER BY window_id ROWS UNBOUNDED PRECEDING) AS g FROM d), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id, g ORDER BY window_id) AS streak FROM g)
      SELECT vehicle_id, window_id, axis, forward_sign, streak, streak >= 3 AS locked FROM k"""),
    "pooled_heading": (lambda s, d: rounded(pooled(s, d), 5), f"WITH RECURSIVE {_POOL} SELECT vehicle_id, window_id, n_windows, ROUND(pooled_deg, 5) AS pooled_deg, ROUND(pooled_corr, 5) AS pooled_corr, lockable FROM c3"),
    "heading_lock": (lambda s, d: rounded(mo.heading_lock(pooled(s, d)), 5), f"WITH RECURSIVE {_POOL}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY window_id) AS rn FROM c3 WHERE lockable) "
                     "SELECT vehicle_id, n_windows, ROUND(pooled_deg, 5) AS pooled_deg, ROUND(pooled_corr, 5) AS pooled_corr, window_id FROM k WHERE rn = 1"),
    "calibration_states": (lambda s, d: rounded(states(s, d).drop("tilt"), 5), f"WITH RECURSIVE {_STATES} SELECT * EXCLUDE (tilt) REPLACE (ROUND(yaw_deg, 5) AS yaw_deg) FROM cs"),
    "corrected_accel": (lambda s, d: rounded(mo.correct(log(s, d), states(s, d)).select("vehicle_id", "event_id", "forward", "lateral", "up", "corrected"), 5), f"WITH RECURSIVE {_CORRECTED}"),
}
