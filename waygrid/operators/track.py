"""Track cleaning and features: window expressions over one partitioning (track_id, pt_idx).

Spark sorts a track once for all features that are asked for together. A track's points
beyond the first and last have neighbours; where a formula needs one that isn't there, the
edge rule of the numerical original is spelled out (one-sided gradients, clamped or cut windows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import DEFAULT, EngineConfig
from waygrid.functions import geo

KEY, ORDER = "track_id", "pt_idx"


def whole():
    """All rows of a track."""
    return W.partitionBy(KEY)


def path():
    """A track's rows in order. (Windows need a session, so they are made when asked for.)"""
    return W.partitionBy(KEY).orderBy(ORDER)


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x) -> Column:
    return F.lag(c(x)).over(path())


def lead(x) -> Column:
    return F.lead(c(x)).over(path())


def gradient(x) -> Column:
    """Central differences, one-sided at the ends; 0 for a single point."""
    return F.coalesce((lead(x) - lag(x)) / 2, lead(x) - c(x), c(x) - lag(x), F.lit(0.0))


def centred(w: int):
    """The rows of a centred window of w rows, cut at the ends."""
    return path().rowsBetween(-(w // 2), (w - 1) // 2)


def rolling(x, agg: Callable[[Column], Column], most: int, part: int, n: str = "n") -> Column:
    """agg over a centred window of min(most, n // part) rows; NULL where that is under 2."""
    out = None
    for w in range(2, most + 1):
        test = F.floor(F.col(n) / part) == w if w < most else F.floor(F.col(n) / part) >= w
        value = agg(c(x)).over(centred(w))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def convolved(x, w: int) -> Column:
    """Moving sum over w, always divided by w: zeros beyond the ends."""
    return F.sum(c(x)).over(centred(w)) / w


def edge_padded_mean(x, w: int = 5) -> Column:
    """Moving mean where the ends repeat beyond the track."""
    half = w // 2
    first, last = F.first(c(x)).over(path().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.last(c(x)).over(path().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    total = F.sum(c(x)).over(path().rowsBetween(-half, half))
    before = F.greatest(F.lit(0), half - (F.row_number().over(path()) - 1))
    after = F.greatest(F.lit(0), half - (F.count("*").over(whole()) - F.row_number().over(path())))
    return (total + first * before + last * after) / w


# ---- cleaning


def sized(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.count("*").over(whole()))


def within_sigma(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Points within `sigma` sample deviations of the track's mean, in both coordinates; tracks
    of under 3 points stay as they are."""
    near = lambda x: F.abs(F.col(x) - F.avg(x).over(whole())) <= cfg.sigma * F.stddev_samp(x).over(whole())
    kept = df.withColumn("ok", (F.count("*").over(whole()) < 3) | (near("lat") & near("lon")))
    return kept.where("ok").drop("ok")


def seconds_since_last(cfg: EngineConfig = DEFAULT, t: str = "epoch_s") -> Column:
    """Time step: 1 for the first point, else within [0.1, 3600]."""
    d = F.col(t) - lag(t)
    return F.when(d.isNull(), 1.0).otherwise(F.least(F.greatest(d, F.lit(cfg.min_dt_s)), F.lit(cfg.max_dt_s)))


def step_miles() -> Column:
    return F.coalesce(geo.haversine(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")), F.lit(0.0))


def step_meters() -> Column:
    return F.coalesce(geo.haversine_m(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")), F.lit(0.0))


def within_speed(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Points reached at no more than `max_speed_mph` from the one before."""
    fast = df.withColumn("v", step_miles() * 3600 / seconds_since_last(cfg))
    return fast.where(F.col("v") <= cfg.max_speed_mph).drop("v")


def smoothed(df: DataFrame) -> DataFrame:
    """Positions by a moving mean over min(5, n / 3) points."""
    df = sized(df)
    return df.withColumns({x: F.coalesce(rolling(x, F.avg, 5, 3), F.col(x)) for x in ("lat", "lon")}).drop("n")


def cleaned(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return smoothed(within_speed(within_sigma(df, cfg), cfg))


def interval_speeds(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Speeds (m/s) of the n - 1 intervals at their middle, those under the limit."""
    dt = F.col("epoch_s") - lag("epoch_s")
    out = df.withColumn("dt", dt).withColumn("meters", step_meters()).where("dt > 0")
    out = out.withColumn("speed_mps", F.col("meters") / F.col("dt")).withColumn("t_mid", F.col("epoch_s") - F.col("dt") / 2)
    return out.where(F.col("speed_mps") < cfg.max_speed_mps).select(KEY, ORDER, "t_mid", "speed_mps")


def iqr_filtered(df: DataFrame, x: str = "speed_mps", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Values under q75 + 2 IQR; if that keeps under 40 % of a track, those under the fallback."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).over(whole())
    df = df.withColumn("q", q).withColumn("ok", F.col(x) < F.col("q")[1] + cfg.iqr_factor * (F.col("q")[1] - F.col("q")[0]))
    share = F.avg(F.col("ok").cast("int")).over(whole())
    return df.withColumn("share", share).where(F.when(F.col("share") >= cfg.iqr_min_share, F.col("ok")).otherwise(F.col(x) < cfg.iqr_fallback_mps)).drop("q", "ok", "share")


def iqr_clipped(x: str, factor: float = 1.5, over=None) -> Column:
    """x within [q25 - 1.5 IQR, q75 + 1.5 IQR] of its track, for tracks of over 10 points."""
    w = over if over is not None else whole()
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).over(w)
    iqr = q[1] - q[0]
    return F.when(F.count(x).over(w) > 10, F.least(F.greatest(F.col(x), q[0] - factor * iqr), q[1] + factor * iqr)).otherwise(F.col(x))


def every_kth(df: DataFrame, k: int, order: str = ORDER) -> DataFrame:
    return df.where(F.pmod(F.col(order), F.lit(k)) == 0)


def downsampled(df: DataFrame, most: int) -> DataFrame:
    """At most `most` points a track, at the places of an even division."""
    n, i = F.col("n"), F.col("rn")
    df = sized(df).withColumn("rn", F.row_number().over(path()) - 1)
    # i is kept if it is floor(k (n - 1) / (most - 1)) for some k
    k = F.ceil(i * (most - 1) / F.greatest(n - 1, F.lit(1)))
    return df.where((n <= most) | (F.floor(k * (n - 1) / F.lit(most - 1)) == i)).drop("n", "rn")


# ---- features


def motion_features(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """dt, step, bearing, speed, acceleration, jerk, turn, curvature, speed change, consistency."""
    lat, lon = F.col("lat"), F.col("lon")
    df = sized(df).withColumns({"dt": seconds_since_last(cfg), "step_mi": step_miles(), "bearing": F.coalesce(geo.bearing(lag("lat"), lag("lon"), lat, lon), F.lit(0.0))})
    df = df.withColumn("speed_mph", F.when(F.col("dt") > 0, F.col("step_mi") * 3600 / F.col("dt")).otherwise(0.0))
    safe_dt = F.greatest(F.col("dt"), F.lit(1e-8))
    df = df.withColumns({"accel": gradient("speed_mph") / safe_dt, "db": F.abs(gradient("bearing")), "dv": F.abs(gradient("speed_mph"))})
    df = df.withColumns({"jerk": gradient("accel") / safe_dt, "turn_angle": F.least(F.col("db"), 360 - F.col("db"))})
    df = df.withColumns({"curvature": F.coalesce(F.try_divide(F.col("turn_angle"), F.col("step_mi") * 111000), F.lit(0.0)), "speed_change_rate": F.col("dv") / F.greatest(F.col("speed_mph"), F.lit(1e-8))})
    spread, mean = rolling("speed_mph", F.stddev_samp, 5, 3), rolling("speed_mph", F.avg, 5, 3)
    df = df.withColumn("consistency", F.coalesce(1 / (1 + F.coalesce(spread, F.lit(0.0)) / (mean + 1e-8)), F.lit(0.0)))
    return df.drop("db", "dv")


def step_variants(df: DataFrame) -> DataFrame:
    """The other conventions: bearing to the next point, signed bearing, plain differences."""
    lat, lon = F.col("lat"), F.col("lon")
    ahead = geo.bearing(lat, lon, lead("lat"), lead("lon"))
    df = df.withColumn("bearing_ahead", ahead)
    df = df.withColumns(
        {
            "bearing_forward": F.coalesce(F.col("bearing_ahead"), lag("bearing_ahead"), F.lit(0.0)),
            "bearing_signed": geo.bearing_signed(lag("lat"), lag("lon"), lat, lon),
            "step_m": step_meters(),
        }
    )
    df = df.withColumn("mph_1s", F.col("step_m") * 2.237)
    return df.withColumns({"accel_diff": F.coalesce(F.col("mph_1s") - lag("mph_1s"), F.lit(0.0)), "turn": geo.bearing_change(F.col("bearing_forward"), lag("bearing_forward"))}).drop("bearing_ahead")


def extra_motion(df: DataFrame) -> DataFrame:
    """From motion_features: stop probability, spread over the last 10 rows, path complexity."""
    last10 = path().rowsBetween(-9, 0)
    df = df.withColumns({"stop_probability": F.exp(-F.col("speed_mph") / 2), "turn": geo.bearing_change(F.col("bearing"), lag("bearing"))})
    return df.withColumns({"speed_var10": F.var_pop("speed_mph").over(last10), "path_complexity": F.coalesce(F.stddev_pop("turn").over(last10), F.lit(0.0))})


def elevation_features(df: DataFrame) -> DataFrame:
    """From motion_features: vertical speed, gain and loss (m/min), roughness, grade, variance, and
    uphill, downhill and flat flags. Time steps are whole seconds, the first like the second."""
    whole_s = F.floor(F.col("epoch_s") - lag("epoch_s")).cast("double")
    df = sized(df).withColumns({"de": gradient("elevation"), "ws": whole_s})
    df = df.withColumns({"dde": gradient("de"), "secs": F.greatest(F.coalesce(F.col("ws"), lead("ws"), F.lit(1.0)), F.lit(1e-8)), "bar": 0.5 * F.stddev_pop("de").over(whole())})
    de = F.col("de")
    df = df.withColumns(
        {
            "vertical_speed": de / F.col("secs"),
            "gain_rate": F.when(de > 0, de * 60 / F.col("secs")).otherwise(0.0),
            "loss_rate": F.when(de < 0, -de * 60 / F.col("secs")).otherwise(0.0),
            "roughness": F.abs("dde"),
            "smoothness": 1 / (1 + F.abs("dde")),
            "grade_percent": de / F.greatest(F.col("step_mi"), F.lit(1e-8)) * 100,
            "elevation_variance": F.coalesce(rolling("elevation", F.var_samp, 10, 5), F.lit(0.0)),
            "uphill": (de > F.col("bar")).cast("int"),
            "downhill": (de < -F.col("bar")).cast("int"),
            "flat": (F.abs(de) <= F.col("bar")).cast("int"),
        }
    )
    return df.drop("de", "dde", "ws", "secs", "bar")


def terrain_features(df: DataFrame) -> DataFrame:
    """Turn density, straightness, route complexity and tortuosity over five points each way."""
    ahead = df.withColumn("b", geo.bearing(F.col("lat"), F.col("lon"), lead("lat"), lead("lon")))
    df = sized(ahead).withColumn("b", F.coalesce(F.col("b"), lag("b"), F.lit(0.0)))
    df = df.withColumns({"g": F.abs(gradient("b")), "ge": F.abs(gradient("elevation")), "seg": F.coalesce(geo.planar(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")), F.lit(0.0))})
    df = df.withColumns({"g": F.least(F.col("g"), 360 - F.col("g")), "cum": F.sum("seg").over(path().rowsBetween(W.unboundedPreceding, 0))})
    around = path().rowsBetween(-5, 5)
    ends = {k: (F.first(k).over(around), F.last(k).over(around)) for k in ("lat", "lon", "cum")}
    straight = geo.planar(ends["lat"][0], ends["lon"][0], ends["lat"][1], ends["lon"][1])
    df = df.withColumns({"turn_density": F.coalesce(rolling("g", F.sum, 10, 5), F.lit(0.0)), "straightaway": 1 / (1 + F.col("g")), "route_complexity": F.col("g") + F.col("ge") * 0.1, "straight": straight, "along": ends["cum"][1] - ends["cum"][0]})
    df = df.withColumn("tortuosity", F.when((F.col("n") >= 10) & (F.col("straight") > 1e-8), F.col("along") / F.col("straight")).otherwise(0.0))
    return df.drop("b", "g", "ge", "seg", "cum", "straight", "along")


def stop_features(df: DataFrame) -> DataFrame:
    """From motion_features: stop and start events at a tenth of the mean speed, and pauses: from a
    stop to the next start, in seconds, on all rows between (of the latest stop before)."""
    df = sized(df).withColumn("stopped", (F.col("speed_mph") <= 0.1 * F.avg("speed_mph").over(whole())).cast("int"))
    turn = lead("stopped") - F.col("stopped")
    df = df.withColumns({"stop_event": F.coalesce((turn == 1).cast("int"), F.lit(0)), "start_event": F.coalesce((turn == -1).cast("int"), F.lit(0))})
    after = path().rowsBetween(1, W.unboundedFollowing)
    upto = path().rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("next_start_s", F.min(F.when(F.col("start_event") == 1, F.col("epoch_s"))).over(after))
    mark = F.when(F.col("stop_event") == 1, F.struct("epoch_s", "next_start_s"))
    df = df.withColumn("last_stop", F.last(mark, ignorenulls=True).over(upto))
    inside = F.col("epoch_s") < F.col("last_stop.next_start_s")
    df = df.withColumns({"pause_s": F.coalesce(F.when(inside, F.col("last_stop.next_start_s") - F.col("last_stop.epoch_s")), F.lit(0.0)), "speed_variance": F.coalesce(rolling("speed_mph", F.var_samp, 10, 5), F.lit(0.0))})
    return df.drop("stopped", "next_start_s", "last_stop")


def shape_features(df: DataFrame) -> DataFrame:
    """Curvature of the circle through three points (rows 2 to n - 3), and path efficiency: how
    straight the way is between the ends of a window of min(20, n / 3) points."""
    side = geo.planar
    lat, lon = F.col("lat"), F.col("lon")
    df = sized(df).withColumns({"i": F.row_number().over(path()) - 1, "sa": side(lag("lat"), lag("lon"), lat, lon), "sb": side(lat, lon, lead("lat"), lead("lon")), "sc": side(lag("lat"), lag("lon"), lead("lat"), lead("lon"))})
    a, b, d = F.col("sa"), F.col("sb"), F.col("sc")
    s = (a + b + d) / 2
    df = df.withColumn("area", F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - d))))
    inner = F.col("i").between(2, F.col("n") - 3) & (F.col("n") >= 10)
    df = df.withColumn("local_curvature", F.when(inner & (a > 1e-10) & (b > 1e-10) & (d > 1e-10) & (F.col("area") > 1e-10), 4 * F.col("area") / (a * b * d)).otherwise(0.0))
    value = None
    for w in range(3, 21):
        half = w // 2
        test = (F.floor(F.col("n") / 3) == w) if w < 20 else (F.floor(F.col("n") / 3) >= w)
        along = F.sum("sb").over(path().rowsBetween(-half, half - 2)) if half >= 1 and -half <= half - 2 else F.lit(0.0)  # one segment short of the window's end
        straight = side(F.lag("lat", half).over(path()), F.lag("lon", half).over(path()), F.lead("lat", half).over(path()), F.lead("lon", half).over(path()))
        here = F.col("i").between(w, F.col("n") - w - 1) & (along > 1e-10)
        x = F.when(here, straight / along).otherwise(0.0)
        value = F.when(test, x) if value is None else value.when(test, x)
    df = df.withColumn("path_efficiency", F.when(F.col("n") >= 10, F.coalesce(value, F.lit(0.0))).otherwise(0.0))
    return df.drop("i", "sa", "sb", "sc", "area")


def events(df: DataFrame, x: str) -> DataFrame:
    """peak: x rises above mean + std here; burst: its step exceeds mean + 2 std of the steps;
    local_max: above 0.1 and both neighbours."""
    level = F.avg(x).over(whole()) + F.stddev_pop(x).over(whole())
    df = df.withColumns({"above": (F.col(x) > level).cast("int"), "step": F.abs(F.col(x) - lag(x))})
    bar = F.avg("step").over(whole()) + 2 * F.stddev_pop("step").over(whole())
    df = df.withColumns({"peak": F.coalesce(((F.col("above") == 1) & (lag("above") == 0)).cast("int"), F.lit(0)), "burst": F.coalesce((F.col("step") > bar).cast("int"), F.lit(0)), "local_max": F.coalesce(((F.col(x) > lag(x)) & (F.col(x) > lead(x)) & (F.col(x) > 0.1)).cast("int"), F.lit(0))})
    return df.drop("above", "step")


def plane_motion(df: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Speed, acceleration and curvature of a path in the plane, by gradients."""
    df = df.withColumns({"vx": gradient(x), "vy": gradient(y)})
    df = df.withColumns({"ax": gradient("vx"), "ay": gradient("vy"), "plane_speed": F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)})
    bend = F.abs(F.col("vx") * F.col("ay") - F.col("vy") * F.col("ax"))
    return df.withColumns({"plane_accel": F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2), "plane_curvature": bend / (F.pow("plane_speed", 3) + 1e-8)}).drop("vx", "vy", "ax", "ay")


def sphere_motion(df: DataFrame) -> DataFrame:
    """Spherical curvature (turn by way) and deviation from the great circle through the neighbours."""
    lat, lon = F.col("lat"), F.col("lon")
    into, out = geo.bearing(lag("lat"), lag("lon"), lat, lon), geo.bearing(lat, lon, lead("lat"), lead("lon"))
    one = lambda *p: geo.haversine(*p, radius=1.0)
    a, b = one(lag("lat"), lag("lon"), lat, lon), one(lat, lon, lead("lat"), lead("lon"))
    chord = geo.bearing(lag("lat"), lag("lon"), lead("lat"), lead("lon"))
    cross = F.abs(F.asin(F.sin(a) * F.sin(F.radians(into - chord))))
    return df.withColumns({"sphere_curvature": F.coalesce(F.try_divide(F.radians(geo.angle_diff(into, out)), (a + b) / 2), F.lit(0.0)), "circle_deviation": F.coalesce(cross, F.lit(0.0))})


def sun_features(df: DataFrame) -> DataFrame:
    """Place of the sun by the NOAA equations for UTC times, daylight, golden and blue hour, season
    and time-of-day scores."""
    hour = F.hour("ts") + F.minute("ts") / 60.0 + F.second("ts") / 3600.0
    day = F.dayofyear("ts")
    g = 2 * F.lit(3.141592653589793) / 365 * (day - 1 + (hour - 12) / 24)
    eq = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    dec = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    angle = F.radians((hour * 60 + eq + 4 * F.col("lon")) / 4 - 180)
    lat = F.radians("lat")
    up = F.asin(F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(angle))
    east = F.atan2(F.sin(angle), F.cos(angle) * F.sin(lat) - F.tan(dec) * F.cos(lat))
    df = df.withColumns({"sun_elevation": F.degrees(up), "sun_azimuth": F.pmod(F.degrees(east) + 180, F.lit(360.0))})
    e = F.col("sun_elevation")
    return df.withColumns(
        {
            "daylight": (e > 0).cast("int"),
            "golden_hour": e.between(-4, 6).cast("int"),
            "blue_hour": ((e >= -6) & (e < -4)).cast("int"),
            "shadow_length": F.when(e > 0, F.least(1 / F.tan(F.radians(e)), F.lit(100.0))).otherwise(0.0),
            "time_of_day_score": (F.sin(2 * F.lit(3.141592653589793) * (hour - 6) / 24) + 1) / 2,
            "season_score": (F.sin(2 * F.lit(3.141592653589793) * (day - 80) / 365) + 1) / 2,
        }
    )


def exposure(df: DataFrame, x: str = "brightness") -> DataFrame:
    return df.withColumn("exposure_consistency", F.coalesce(1 / (1 + F.abs(F.col(x) - lag(x))), F.lit(1.0)))


def top_k(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows a group before it shuffles (WindowGroupLimit)."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
