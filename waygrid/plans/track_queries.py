"""Queries on tracks, and their SQL. Doubles are rounded on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.functions import geo, scalar
from waygrid.operators import aggregates, track
from waygrid.plans import sql as q
from waygrid.sources import adapters


def out(df: DataFrame, *keys: str, **columns) -> DataFrame:
    """Keys as they are, doubles to six digits without a negative zero."""
    kinds = dict(df.dtypes)
    picked = [F.col(k) for k in keys]
    for name, x in columns.items():
        col = F.col(name) if x is True else x
        picked.append((F.round(col, 6) + F.lit(0.0)).alias(name))
    return df.select(*picked) if columns else df.select(*[(F.round(F.col(k), 6) + F.lit(0.0)).alias(k) if kinds[k] == "double" else F.col(k) for k in keys])


def features(s, d):
    return track.motion_features(adapters.tracks(s, d))


def track_clean(s, d):
    return out(track.smoothed(track.within_sigma(adapters.tracks(s, d))), "track_id", "pt_idx", "lat", "lon")


def track_speed_filter(s, d):
    return out(track.within_speed(track.within_sigma(adapters.tracks(s, d))), "track_id", "pt_idx", "lat", "lon")


def interval_speeds(s, d):
    return out(track.iqr_filtered(track.interval_speeds(adapters.tracks(s, d))), "track_id", "pt_idx", t_mid=F.round("t_mid", 3), speed_mps=True)


def clipped_speeds(s, d):
    f = features(s, d)
    return out(f.withColumn("clipped", track.iqr_clipped("speed_mph")).withColumn("bounded", scalar.clip(F.col("speed_mph"), 0, 2)), "track_id", "pt_idx", "clipped", "bounded")


def motion_features(s, d):
    return out(features(s, d), "track_id", "pt_idx", "dt", "step_mi", "bearing", "speed_mph", "accel", "jerk", "turn_angle", "speed_change_rate", "consistency")


def curvature(s, d):
    return out(features(s, d), "track_id", "pt_idx", "curvature")


def step_variants(s, d):
    return out(track.step_variants(adapters.tracks(s, d)), "track_id", "pt_idx", "bearing_forward", "bearing_signed", "step_m", "mph_1s", "accel_diff", "turn")


def extra_motion(s, d):
    return out(track.extra_motion(features(s, d)), "track_id", "pt_idx", "stop_probability", "speed_var10", "path_complexity")


def elevation_features(s, d):
    f = track.elevation_features(features(s, d)).withColumn("elevation_variance", F.round("elevation_variance", 3))
    return out(f, "track_id", "pt_idx", "vertical_speed", "gain_rate", "loss_rate", "roughness", "smoothness", "elevation_variance", "uphill", "downhill", "flat")


def terrain_features(s, d):
    return out(track.terrain_features(adapters.tracks(s, d)), "track_id", "pt_idx", "turn_density", "straightaway", "route_complexity", "tortuosity")


def stop_features(s, d):
    return out(track.stop_features(features(s, d)), "track_id", "pt_idx", "stop_event", "start_event", "pause_s", "speed_variance")


def shape_features(s, d):
    f = track.shape_features(adapters.tracks(s, d))
    return f.select("track_id", "pt_idx", (F.round("local_curvature", 2) + 0.0).alias("local_curvature"), (F.round("path_efficiency", 6) + 0.0).alias("path_efficiency"))


def event_features(s, d):
    return out(track.events(features(s, d), "speed_mph"), "track_id", "pt_idx", "peak", "burst", "local_max")


def plane_motion(s, d):
    t = adapters.tracks(s, d).withColumns({"x": (F.col("lon") + 93.30) * 10000, "y": (F.col("lat") - 44.95) * 10000})
    return out(track.plane_motion(t, "x", "y"), "track_id", "pt_idx", "plane_speed", "plane_accel", "plane_curvature")


def sphere_motion(s, d):
    return out(track.sphere_motion(adapters.tracks(s, d)), "track_id", "pt_idx", "circle_deviation")


def sun_features(s, d):
    return track.sun_features(adapters.tracks(s, d)).select("track_id", "pt_idx", *[(F.round(x, 4) + 0.0).alias(x) for x in ("sun_elevation", "sun_azimuth", "time_of_day_score", "season_score")], "daylight", "golden_hour", "blue_hour")


def smoothing(s, d):
    t = adapters.tracks(s, d)
    return out(t.withColumns({"padded": track.edge_padded_mean("elevation"), "convolved": track.convolved("elevation", 5), "exposure": 1 / (1 + F.abs(F.col("elevation") - track.lag("elevation")))}), "track_id", "pt_idx", "padded", "convolved", "exposure")


def downsampled(s, d):
    return track.downsampled(adapters.tracks(s, d), 20).select("track_id", "pt_idx")


def every_tenth(s, d):
    return out(track.every_kth(features(s, d), 10), "track_id", "pt_idx", "bearing")


def track_summary(s, d):
    return out(aggregates.track_summary(features(s, d)), "track_id", "start_s", "duration_s", "distance_mi", "point_count", "max_speed", "avg_speed")


def track_profile(s, d):
    return out(aggregates.profile(features(s, d), "speed_mph", "track_id"), "track_id", "mean", "std", "low", "high", "n", "p25", "median", "p75", "p90", "p95", "iqr", "cv")


def track_signature(s, d):
    return out(aggregates.signature(features(s, d), "speed_mph"), "track_id", "mean", "std", "p25", "median", "p75", "n", "total_variation")


def motion_statistics(s, d):
    return out(aggregates.motion_statistics(features(s, d)), "track_id", "speed_mean", "speed_std", "speed_min", "speed_max", "speed_median", "turn_mean", "turn_std", "turn_max", "turn_total", "climb", "descent")


def direction_metrics(s, d):
    return out(aggregates.direction_metrics(adapters.tracks(s, d)), "track_id", "total_change", "avg_change", "max_change", "sinuosity", "straightness")


def fractal_dimension(s, d):
    return out(aggregates.fractal_dimension(adapters.tracks(s, d)), "track_id", "fractal_dimension")


def robust_spread(s, d):
    return out(aggregates.mad(features(s, d), "speed_mph", "track_id"), "track_id", "median", "mad", "mad_scaled")


def first_times(s, d):
    return aggregates.first_time(adapters.tracks(s, d)).select("track_id", F.unix_micros("first_ts").alias("first_us"))


def track_bounds(s, d):
    t = adapters.tracks(s, d)
    ok = geo.in_range(F.col("lat"), F.col("lon")) & geo.nonzero(F.col("lat"), F.col("lon"))
    return out(t.groupBy("track_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid")), "track_id", "south", "north", "west", "east", "valid", "invalid")


def destinations(s, d):
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), F.col("bearing"), F.col("elevation"))
    return out(features(s, d).withColumns({"to_lat": lat, "to_lon": lon, "seen": geo.angle_diff(F.col("bearing"), F.lit(350.0)), "pixel": geo.pixel_bearing(F.col("elevation"), F.lit(100.0))}), "track_id", "pt_idx", "to_lat", "to_lon", "seen", "pixel")


QUERIES = [
    track_clean, track_speed_filter, interval_speeds, clipped_speeds, motion_features, curvature, step_variants, extra_motion, elevation_features, terrain_features, stop_features,
    shape_features, event_features, plane_motion, sphere_motion, sun_features, smoothing, downsampled, every_tenth, track_summary, track_profile, track_signature, motion_statistics,
    direction_metrics, fractal_dimension, robust_spread, first_times, track_bounds, destinations,
]

SIGMA = f"""{q.TRACK}, s1 AS (SELECT *, count(*) OVER t AS n, avg(lat) OVER t AS ma, stddev_samp(lat) OVER t AS sa, avg(lon) OVER t AS mo, stddev_samp(lon) OVER t AS so FROM pt WINDOW t AS (PARTITION BY track_id)),
sg AS (SELECT track_id, pt_idx, epoch_s, lat, lon FROM s1 WHERE n < 3 OR (abs(lat - ma) <= 3.0 * sa AND abs(lon - mo) <= 3.0 * so))"""
PCT = "quantile_cont({x}, {p})"
METERS = f"coalesce({q.haversine(q.lag('lat'), q.lag('lon'), 'lat', 'lon', '6371000.0')}, 0.0)"
AHEAD = q.bearing("lat", "lon", q.lead("lat"), q.lead("lon"))
T = "OVER (PARTITION BY track_id)"


def _path_efficiency() -> str:
    cases = []
    for w in range(3, 21):
        h = w // 2
        along = f"sum(sb) OVER {q.frame(-h, h - 2)}" if -h <= h - 2 else "0.0"
        straight = q.planar(q.lag("lat", n=h), q.lag("lon", n=h), q.lead("lat", n=h), q.lead("lon", n=h))
        cases.append(f"WHEN n // 3 {'=' if w < 20 else '>='} {w} THEN CASE WHEN pt_idx BETWEEN {w} AND n - {w} - 1 AND {along} > 1e-10 THEN {straight} / ({along}) ELSE 0.0 END")
    return f"CASE WHEN n >= 10 THEN coalesce(CASE {' '.join(cases)} END, 0.0) ELSE 0.0 END"


SQL = {
    "track_clean": f"WITH {SIGMA}, n AS (SELECT *, count(*) {T} AS n2 FROM sg) SELECT track_id, pt_idx, {q.rounded(lat='coalesce(' + q.rolling('avg(lat)', 5, 3, 'n2') + ', lat)', lon='coalesce(' + q.rolling('avg(lon)', 5, 3, 'n2') + ', lon)')} FROM n",
    "track_speed_filter": f"WITH {SIGMA}, v AS (SELECT *, {q.STEP} * 3600 / ({q.DT}) AS v FROM sg) SELECT track_id, pt_idx, {q.cols('lat', 'lon')} FROM v WHERE v <= 200.0",
    "interval_speeds": f"""WITH {q.TRACK}, a AS (SELECT *, epoch_s - {q.lag('epoch_s')} AS dt, {METERS} AS m FROM pt), b AS (SELECT track_id, pt_idx, m / dt AS speed_mps, epoch_s - dt / 2 AS t_mid FROM a WHERE dt > 0),
      c AS (SELECT * FROM b WHERE speed_mps < 140.0), d AS (SELECT *, quantile_cont(speed_mps, 0.25) {T} AS q1, quantile_cont(speed_mps, 0.75) {T} AS q3 FROM c),
      e AS (SELECT *, speed_mps < q3 + 2.0 * (q3 - q1) AS ok FROM d), g AS (SELECT *, avg(CAST(ok AS INTEGER)) {T} AS share FROM e)
      SELECT track_id, pt_idx, {q.r('t_mid', 3)} AS t_mid, {q.cols('speed_mps')} FROM g WHERE CASE WHEN share >= 0.4 THEN ok ELSE speed_mps < 138.9 END""",
    "clipped_speeds": f"""WITH {q.FEATURES}, g AS (SELECT *, quantile_cont(speed_mph, 0.25) {T} AS q1, quantile_cont(speed_mph, 0.75) {T} AS q3 FROM f)
      SELECT track_id, pt_idx, {q.rounded(clipped='CASE WHEN n > 10 THEN least(greatest(speed_mph, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) ELSE speed_mph END', bounded='least(greatest(speed_mph, 0), 2)')} FROM g""",
    "motion_features": f"WITH {q.FEATURES} SELECT track_id, pt_idx, {q.cols('dt', 'step_mi', 'bearing', 'speed_mph', 'accel', 'jerk', 'turn_angle', 'speed_change_rate', 'consistency')} FROM f",
    "curvature": f"WITH {q.FEATURES} SELECT track_id, pt_idx, {q.cols('curvature')} FROM f",
    "step_variants": f"""WITH {q.TRACK}, a AS (SELECT *, {AHEAD} AS ahead, {q.bearing_signed(q.lag('lat'), q.lag('lon'), 'lat', 'lon')} AS bearing_signed, {METERS} AS step_m FROM pt),
      b AS (SELECT *, coalesce(ahead, {q.lag('ahead')}, 0.0) AS bearing_forward, step_m * 2.237 AS mph_1s FROM a)
      SELECT track_id, pt_idx, {q.cols('bearing_forward', 'bearing_signed', 'step_m', 'mph_1s')}, {q.rounded(accel_diff=f"coalesce(mph_1s - {q.lag('mph_1s')}, 0.0)", turn=f"abs({q.pmod('bearing_forward - ' + q.lag('bearing_forward') + ' + 180')} - 180)")} FROM b""",
    "extra_motion": f"""WITH {q.FEATURES}, g AS (SELECT *, abs({q.pmod('bearing - ' + q.lag('bearing') + ' + 180')} - 180) AS turn FROM f)
      SELECT track_id, pt_idx, {q.rounded(stop_probability='exp(-speed_mph / 2)', speed_var10=f'var_pop(speed_mph) OVER {q.frame(-9, 0)}', path_complexity=f'coalesce(stddev_pop(turn) OVER {q.frame(-9, 0)}, 0.0)')} FROM g""",
    "elevation_features": f"""WITH {q.FEATURES}, a AS (SELECT *, {q.gradient('elevation')} AS de, CAST(floor(epoch_s - {q.lag('epoch_s')}) AS DOUBLE) AS ws FROM f),
      b AS (SELECT *, {q.gradient('de')} AS dde, greatest(coalesce(ws, {q.lead('ws')}, 1.0), 1e-8) AS secs, 0.5 * stddev_pop(de) {T} AS bar FROM a)
      SELECT track_id, pt_idx, {q.rounded(vertical_speed='de / secs', gain_rate='CASE WHEN de > 0 THEN de * 60 / secs ELSE 0.0 END', loss_rate='CASE WHEN de < 0 THEN -de * 60 / secs ELSE 0.0 END', roughness='abs(dde)', smoothness='1 / (1 + abs(dde))', elevation_variance='round(coalesce(' + q.rolling('var_samp(elevation)', 10, 5) + ', 0.0), 3)')},
             CAST(de > bar AS INTEGER) AS uphill, CAST(de < -bar AS INTEGER) AS downhill, CAST(abs(de) <= bar AS INTEGER) AS flat FROM b""",
    "terrain_features": f"""WITH {q.TRACK}, a AS (SELECT *, count(*) {T} AS n, {AHEAD} AS b0, coalesce({q.planar(q.lag('lat'), q.lag('lon'), 'lat', 'lon')}, 0.0) AS seg FROM pt), b AS (SELECT *, coalesce(b0, {q.lag('b0')}, 0.0) AS b FROM a),
      c AS (SELECT *, abs({q.gradient('b')}) AS g0, abs({q.gradient('elevation')}) AS ge, sum(seg) OVER (PARTITION BY track_id ORDER BY pt_idx ROWS UNBOUNDED PRECEDING) AS cum FROM b), e AS (SELECT *, least(g0, 360 - g0) AS g FROM c),
      h AS (SELECT *, {q.planar(*[f'{fn}({x}) OVER z' for fn in ('first', 'last') for x in ('lat', 'lon')])} AS straight, last(cum) OVER z - first(cum) OVER z AS along FROM e WINDOW z AS {q.frame(-5, 5)})
      SELECT track_id, pt_idx, {q.rounded(turn_density='coalesce(' + q.rolling('sum(g)', 10, 5) + ', 0.0)', straightaway='1 / (1 + g)', route_complexity='g + ge * 0.1', tortuosity='CASE WHEN n >= 10 AND straight > 1e-8 THEN along / straight ELSE 0.0 END')} FROM h""",
    "stop_features": f"""WITH {q.FEATURES}, a AS (SELECT *, CAST(speed_mph <= 0.1 * avg(speed_mph) {T} AS INTEGER) AS st FROM f), b AS (SELECT *, coalesce(CAST({q.lead('st')} - st = 1 AS INTEGER), 0) AS stop_event, coalesce(CAST({q.lead('st')} - st = -1 AS INTEGER), 0) AS start_event FROM a),
      c AS (SELECT *, min(CASE WHEN start_event = 1 THEN epoch_s END) OVER (PARTITION BY track_id ORDER BY pt_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM b),
      e AS (SELECT *, max(CASE WHEN stop_event = 1 THEN pt_idx END) OVER (PARTITION BY track_id ORDER BY pt_idx ROWS UNBOUNDED PRECEDING) AS li FROM c)
      SELECT e.track_id, e.pt_idx, e.stop_event, e.start_event, {q.rounded(pause_s='CASE WHEN e.epoch_s < z.nxt THEN z.nxt - z.epoch_s ELSE 0.0 END')}, e.speed_variance FROM (SELECT *, {q.r('coalesce(' + q.rolling('var_samp(speed_mph)', 10, 5) + ', 0.0)')} AS speed_variance FROM e) e LEFT JOIN c z ON z.track_id = e.track_id AND z.pt_idx = e.li""",
    "shape_features": f"""WITH {q.TRACK}, a AS (SELECT *, count(*) {T} AS n, {q.planar(q.lag('lat'), q.lag('lon'), 'lat', 'lon')} AS sa, {q.planar('lat', 'lon', q.lead('lat'), q.lead('lon'))} AS sb, {q.planar(q.lag('lat'), q.lag('lon'), q.lead('lat'), q.lead('lon'))} AS sc FROM pt),
      b AS (SELECT *, (sa + sb + sc) / 2 AS s FROM a), c AS (SELECT *, sqrt(greatest(0.0, s * (s - sa) * (s - sb) * (s - sc))) AS area FROM b)
      SELECT track_id, pt_idx, {q.r('CASE WHEN n >= 10 AND pt_idx BETWEEN 2 AND n - 3 AND sa > 1e-10 AND sb > 1e-10 AND sc > 1e-10 AND area > 1e-10 THEN 4 * area / (sa * sb * sc) ELSE 0.0 END', 2)} AS local_curvature, {q.r(_path_efficiency())} AS path_efficiency FROM c""",
    "event_features": f"""WITH {q.FEATURES}, a AS (SELECT *, CAST(speed_mph > avg(speed_mph) {T} + stddev_pop(speed_mph) {T} AS INTEGER) AS up, abs(speed_mph - {q.lag('speed_mph')}) AS st FROM f), b AS (SELECT *, avg(st) {T} + 2 * stddev_pop(st) {T} AS bar FROM a)
      SELECT track_id, pt_idx, coalesce(CAST(up = 1 AND {q.lag('up')} = 0 AS INTEGER), 0) AS peak, coalesce(CAST(st > bar AS INTEGER), 0) AS burst, coalesce(CAST(speed_mph > {q.lag('speed_mph')} AND speed_mph > {q.lead('speed_mph')} AND speed_mph > 0.1 AS INTEGER), 0) AS local_max FROM b""",
    "plane_motion": f"""WITH {q.TRACK}, p AS (SELECT *, (lon + 93.30) * 10000 AS x, (lat - 44.95) * 10000 AS y FROM pt), a AS (SELECT *, {q.gradient('x')} AS vx, {q.gradient('y')} AS vy FROM p), b AS (SELECT *, {q.gradient('vx')} AS ax, {q.gradient('vy')} AS ay, sqrt(pow(vx, 2) + pow(vy, 2)) AS plane_speed FROM a)
      SELECT track_id, pt_idx, {q.rounded(plane_speed='plane_speed', plane_accel='sqrt(pow(ax, 2) + pow(ay, 2))', plane_curvature='abs(vx * ay - vy * ax) / (pow(plane_speed, 3) + 1e-8)')} FROM b""",
    "sphere_motion": f"""WITH {q.TRACK}, a AS (SELECT *, {q.bearing(q.lag('lat'), q.lag('lon'), 'lat', 'lon')} AS into_b, {q.bearing(q.lag('lat'), q.lag('lon'), q.lead('lat'), q.lead('lon'))} AS chord, {q.haversine(q.lag('lat'), q.lag('lon'), 'lat', 'lon', '1.0')} AS a FROM pt)
      SELECT track_id, pt_idx, {q.rounded(circle_deviation='coalesce(abs(asin(sin(a) * sin(radians(into_b - chord)))), 0.0)')} FROM a""",
    "sun_features": f"""WITH {q.TRACK}, a AS (SELECT *, hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0 AS h, dayofyear(ts) AS day FROM pt), b AS (SELECT *, 2 * 3.141592653589793 / 365 * (day - 1 + (h - 12) / 24) AS g FROM a),
      c AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec FROM b),
      e AS (SELECT *, radians((h * 60 + eq + 4 * lon) / 4 - 180) AS ang FROM c), g AS (SELECT *, degrees(asin(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(ang))) AS el, degrees(atan2(sin(ang), cos(ang) * sin(radians(lat)) - tan(dec) * cos(radians(lat)))) AS az FROM e)
      SELECT track_id, pt_idx, {q.r('el', 4)} AS sun_elevation, {q.r(q.pmod('az + 180'), 4)} AS sun_azimuth, {q.r('(sin(2 * 3.141592653589793 * (h - 6) / 24) + 1) / 2', 4)} AS time_of_day_score, {q.r('(sin(2 * 3.141592653589793 * (day - 80) / 365) + 1) / 2', 4)} AS season_score,
             CAST(el > 0 AS INTEGER) AS daylight, CAST(el BETWEEN -4 AND 6 AS INTEGER) AS golden_hour, CAST(el >= -6 AND el < -4 AS INTEGER) AS blue_hour FROM g""",
    "smoothing": f"""WITH {q.TRACK}, a AS (SELECT *, count(*) {T} AS n, first(elevation) OVER (PARTITION BY track_id ORDER BY pt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e0, last(elevation) OVER (PARTITION BY track_id ORDER BY pt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e1 FROM pt)
      SELECT track_id, pt_idx, {q.rounded(padded=f'(sum(elevation) OVER {q.frame(-2, 2)} + e0 * greatest(0, 2 - pt_idx) + e1 * greatest(0, 2 - (n - 1 - pt_idx))) / 5', convolved=f'sum(elevation) OVER {q.frame(-2, 2)} / 5', exposure=f"1 / (1 + abs(elevation - {q.lag('elevation')}))")} FROM a""",
    "downsampled": f"""WITH {q.TRACK}, a AS (SELECT track_id, count(*) AS n FROM pt GROUP BY track_id), k AS (SELECT DISTINCT track_id, k * (n - 1) // 19 AS pt_idx FROM a, range(20) AS z(k))
      SELECT pt.track_id, pt.pt_idx FROM pt JOIN a USING (track_id) LEFT JOIN k ON k.track_id = pt.track_id AND k.pt_idx = pt.pt_idx WHERE a.n <= 20 OR k.pt_idx IS NOT NULL""",
    "every_tenth": f"WITH {q.FEATURES} SELECT track_id, pt_idx, {q.cols('bearing')} FROM f WHERE pt_idx % 10 = 0",
    "track_summary": f"WITH {q.FEATURES} SELECT track_id, {q.rounded(start_s='min(epoch_s)', duration_s='max(epoch_s) - min(epoch_s)', distance_mi='sum(step_mi)', max_speed='max(speed_mph)', avg_speed='avg(speed_mph)')}, count(*) AS point_count FROM f GROUP BY track_id",
    "track_profile": f"""WITH {q.FEATURES}, g AS (SELECT track_id, avg(speed_mph) AS mean, stddev_pop(speed_mph) AS std, min(speed_mph) AS low, max(speed_mph) AS high, count(*) AS n, quantile_cont(speed_mph, [0.25, 0.5, 0.75, 0.9, 0.95]) AS p FROM f GROUP BY track_id)
      SELECT track_id, {q.cols('mean', 'std', 'low', 'high')}, n, {q.rounded(p25='p[1]', median='p[2]', p75='p[3]', p90='p[4]', p95='p[5]', iqr='p[3] - p[1]', cv='CASE WHEN mean <> 0 THEN std / mean ELSE 0.0 END')} FROM g""",
    "track_signature": f"""WITH {q.FEATURES}, a AS (SELECT *, abs(speed_mph - {q.lag('speed_mph')}) AS tv FROM f)
      SELECT track_id, {q.rounded(mean='avg(speed_mph)', std='stddev_pop(speed_mph)', p25='quantile_cont(speed_mph, 0.25)', median='median(speed_mph)', p75='quantile_cont(speed_mph, 0.75)', total_variation='coalesce(sum(tv), 0.0)')}, count(*) AS n FROM a GROUP BY track_id""",
    "motion_statistics": f"""WITH {q.FEATURES}, a AS (SELECT *, elevation - {q.lag('elevation')} AS de, CASE WHEN speed_mph > 0 THEN speed_mph END AS v FROM f)
      SELECT track_id, {q.rounded(speed_mean='avg(v)', speed_std='stddev_pop(v)', speed_min='min(v)', speed_max='max(v)', speed_median='median(v)', turn_mean='avg(turn_angle)', turn_std='stddev_pop(turn_angle)', turn_max='max(turn_angle)', turn_total='sum(turn_angle)', climb='sum(greatest(de, 0.0))', descent='sum(greatest(-de, 0.0))')} FROM a GROUP BY track_id""",
    "direction_metrics": f"""WITH {q.TRACK}, a AS (SELECT *, {q.bearing(q.lag('lat'), q.lag('lon'), 'lat', 'lon')} AS ib, {q.planar(q.lag('lat'), q.lag('lon'), 'lat', 'lon')} AS seg FROM pt), b AS (SELECT *, {q.lag('ib')} AS pb FROM a), c AS (SELECT *, {q.angle_diff('ib', 'pb')} AS ch FROM b),
      g AS (SELECT track_id, sum(ch) AS total_change, avg(ch) AS avg_change, max(ch) AS max_change, sum(seg) AS len, {q.planar('arg_min(lat, pt_idx)', 'arg_min(lon, pt_idx)', 'arg_max(lat, pt_idx)', 'arg_max(lon, pt_idx)')} AS chord FROM c GROUP BY track_id)
      SELECT track_id, {q.cols('total_change', 'avg_change', 'max_change')}, {q.rounded(sinuosity='CASE WHEN chord <> 0 THEN coalesce(len / chord, 1.0) ELSE 1.0 END', straightness='CASE WHEN len <> 0 THEN coalesce(chord / len, 0.0) ELSE 0.0 END')} FROM g""",
    "fractal_dimension": f"""WITH {q.TRACK}, a AS (SELECT track_id, lon - min(lon) {T} AS x, lat - min(lat) {T} AS y FROM pt), b AS (SELECT track_id, box, count(DISTINCT (floor(x / box), floor(y / box))) AS met FROM a, (SELECT unnest([0.001, 0.002, 0.005, 0.01, 0.02])::DOUBLE AS box) GROUP BY track_id, box)
      SELECT track_id, {q.rounded(fractal_dimension='-regr_slope(ln(met), ln(box))')} FROM b GROUP BY track_id""",
    "robust_spread": f"WITH {q.FEATURES}, a AS (SELECT *, median(speed_mph) {T} AS med FROM f) SELECT track_id, {q.rounded(median='min(med)', mad='median(abs(speed_mph - med))', mad_scaled='median(abs(speed_mph - med)) * 1.4826')} FROM a GROUP BY track_id",
    "first_times": f"WITH {q.TRACK} SELECT track_id, epoch_us(arg_min(ts, pt_idx)) AS first_us FROM pt GROUP BY track_id",
    "track_bounds": f"WITH {q.TRACK} SELECT track_id, {q.rounded(south='min(lat)', north='max(lat)', west='min(lon)', east='max(lon)')}, count(*) FILTER (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND lat <> 0 AND lon <> 0) AS valid, count(*) FILTER (NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND lat <> 0 AND lon <> 0)) AS invalid FROM pt GROUP BY track_id",
    "destinations": f"""WITH {q.FEATURES}, a AS (SELECT *, elevation / 6371000.0 AS d, radians(bearing) AS b, radians(lat) AS p FROM f), c AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b)) AS t FROM a)
      SELECT track_id, pt_idx, {q.rounded(to_lat='degrees(t)', to_lon='degrees(radians(lon) + atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(t)))', seen=q.angle_diff('bearing', '350.0'), pixel=q.pmod('elevation / 100.0 * 360'))} FROM c""",
}
