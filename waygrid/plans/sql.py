"""Pieces of DuckDB SQL that several oracle queries share."""

from __future__ import annotations

TRACK = """pt AS (
  SELECT CAST(user_id AS VARCHAR) AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pt_idx, ts, epoch_us(ts) / 1e6 AS epoch_s,
         44.95 + value / 10000.0 AS lat, -93.30 + CAST(regexp_extract(props, '[0-9]+') AS INTEGER) / 10000.0 AS lon, value AS elevation
  FROM events)"""
MOTION = """mo AS (
  SELECT CAST(user_id AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) AS t, value AS motion_magnitude FROM events)"""
DET = """det AS (
  SELECT CAST(user_id AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS det_idx, hour(ts) AS frame_second, event_type AS object_class,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) / 100.0 AS confidence, value AS x1, value / 2 AS y1, value + CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS x2, value / 2 + CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS y2
  FROM events)"""
W = "(PARTITION BY track_id ORDER BY pt_idx)"


def r(x: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round({x}, {digits}) + 0.0)"


def rounded(**columns: str) -> str:
    return ", ".join(f"{r(x)} AS {name}" for name, x in columns.items())


def cols(*names: str) -> str:
    return ", ".join(f"{r(n)} AS {n}" for n in names)


def lag(x: str, w: str = W, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {w}"


def lead(x: str, w: str = W, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER {w}"


def gradient(x: str, w: str = W) -> str:
    return f"coalesce(({lead(x, w)} - {lag(x, w)}) / 2, {lead(x, w)} - {x}, {x} - {lag(x, w)}, 0.0)"


def frame(before: int, after: int, key: str = "track_id", order: str = "pt_idx") -> str:
    edge = lambda k: f"{-k} PRECEDING" if k < 0 else "CURRENT ROW" if k == 0 else f"{k} FOLLOWING"
    return f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {edge(before)} AND {edge(after)})"


def rolling(agg: str, most: int, part: int, n: str = "n") -> str:
    """agg holds one call, like avg(x), over a centred window of min(most, n // part) rows."""
    cases = [f"WHEN {n} // {part} {'=' if w < most else '>='} {w} THEN {agg} OVER {frame(-(w // 2), (w - 1) // 2)}" for w in range(2, most + 1)]
    return f"CASE {' '.join(cases)} END"


def haversine(a: str, b: str, c: str, d: str, radius: str = "3958.8") -> str:
    h = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"CASE WHEN {a} IS NOT NULL AND {c} IS NOT NULL AND {b} IS NOT NULL AND {d} IS NOT NULL THEN 2 * {radius} * asin(sqrt(least(1.0, {h}))) END"


def bearing_signed(a: str, b: str, c: str, d: str) -> str:
    return f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"


def pmod(x: str, m: str = "360.0") -> str:
    return f"((({x}) % {m} + {m}) % {m})"


def bearing(a: str, b: str, c: str, d: str) -> str:
    return pmod(f"{bearing_signed(a, b, c, d)} + 360")


def angle_diff(a: str, b: str) -> str:
    d = pmod(f"abs({a} - {b})")
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({d}, 360 - {d}) END"


def planar(a: str, b: str, c: str, d: str) -> str:
    return f"sqrt(pow({c} - {a}, 2) + pow({d} - {b}, 2))"


DT = f"CASE WHEN {lag('epoch_s')} IS NULL THEN 1.0 ELSE least(greatest(epoch_s - {lag('epoch_s')}, 0.1), 3600.0) END"
STEP = f"coalesce({haversine(lag('lat'), lag('lon'), 'lat', 'lon')}, 0.0)"
FEATURES = f"""{TRACK},
f1 AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, {DT} AS dt, {STEP} AS step_mi, coalesce({bearing(lag('lat'), lag('lon'), 'lat', 'lon')}, 0.0) AS bearing FROM pt),
f2 AS (SELECT *, CASE WHEN dt > 0 THEN step_mi * 3600 / dt ELSE 0.0 END AS speed_mph FROM f1),
f3 AS (SELECT *, {gradient('speed_mph')} / greatest(dt, 1e-8) AS accel, abs({gradient('bearing')}) AS db, abs({gradient('speed_mph')}) AS dv FROM f2),
f AS (SELECT *, {gradient('accel')} / greatest(dt, 1e-8) AS jerk, least(db, 360 - db) AS turn_angle, CASE WHEN step_mi * 111000 <> 0 THEN least(db, 360 - db) / (step_mi * 111000) ELSE 0.0 END AS curvature,
      dv / greatest(speed_mph, 1e-8) AS speed_change_rate,
      coalesce(1 / (1 + coalesce({rolling('stddev_samp(speed_mph)', 5, 3)}, 0.0) / ({rolling('avg(speed_mph)', 5, 3)} + 1e-8)), 0.0) AS consistency FROM f3)"""
