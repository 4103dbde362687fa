"""Track and object aggregates. All combine before the shuffle but the exact percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.functions import geo
from waygrid.operators.track import lag, whole


def track_summary(features: DataFrame) -> DataFrame:
    """One row a track: span, distance, speeds, count."""
    return features.groupBy("track_id").agg(F.min("epoch_s").alias("start_s"), F.max("epoch_s").alias("end_s"), (F.max("epoch_s") - F.min("epoch_s")).alias("duration_s"), F.sum("step_mi").alias("distance_mi"), F.count("*").alias("point_count"), F.max("speed_mph").alias("max_speed"), F.avg("speed_mph").alias("avg_speed"))


def first_time(points: DataFrame) -> DataFrame:
    """Time of a track's first point that has one, in document order."""
    return points.where("ts is not null").groupBy("track_id").agg(F.min_by("ts", "pt_idx").alias("first_ts"))


def profile(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """mean, std, median, IQR, quartiles, extremes and count of a feature."""
    q = F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95))))
    d = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), q.alias("q"), F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n"))
    names = ("p25", "median", "p75", "p90", "p95")
    return d.select(*keys, "mean", "std", "low", "high", "n", *[F.col("q")[i].alias(s) for i, s in enumerate(names)], (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.coalesce(F.try_divide("std", "mean"), F.lit(0.0)).alias("cv"))


def signature(df: DataFrame, x: str) -> DataFrame:
    """The nine figures of a series: those of profile, total variation and length."""
    moved = df.withColumn("tv", F.abs(F.col(x) - lag(x)))
    total = moved.groupBy("track_id").agg(F.coalesce(F.sum("tv"), F.lit(0.0)).alias("total_variation"))
    return profile(df, x, "track_id").select("track_id", "mean", "std", "low", "high", "p25", "median", "p75", "n").join(total, "track_id")


def motion_statistics(features: DataFrame) -> DataFrame:
    """Speeds above 0, turns, climb and descent of each track."""
    f = features.withColumn("de", F.col("elevation") - lag("elevation"))
    v = F.when(F.col("speed_mph") > 0, F.col("speed_mph"))
    return f.groupBy("track_id").agg(
        F.avg(v).alias("speed_mean"), F.stddev_pop(v).alias("speed_std"), F.min(v).alias("speed_min"), F.max(v).alias("speed_max"), F.median(v).alias("speed_median"),
        F.avg("turn_angle").alias("turn_mean"), F.stddev_pop("turn_angle").alias("turn_std"), F.max("turn_angle").alias("turn_max"), F.sum("turn_angle").alias("turn_total"),
        F.sum(F.greatest("de", F.lit(0.0))).alias("climb"), F.sum(F.greatest(-F.col("de"), F.lit(0.0))).alias("descent"),
    )


def direction_metrics(df: DataFrame) -> DataFrame:
    """Direction changes, sinuosity and straightness by planar lengths."""
    into = geo.bearing(lag("lat"), lag("lon"), F.col("lat"), F.col("lon"))
    d = df.withColumns({"into": into, "seg": geo.planar(lag("lat"), lag("lon"), F.col("lat"), F.col("lon"))})
    d = d.withColumn("change", geo.angle_diff(F.col("into"), lag("into")))
    g = d.groupBy("track_id").agg(F.sum("change").alias("total_change"), F.avg("change").alias("avg_change"), F.max("change").alias("max_change"), F.sum("seg").alias("length"), F.min_by(F.struct("lat", "lon"), "pt_idx").alias("a"), F.max_by(F.struct("lat", "lon"), "pt_idx").alias("b"))
    g = g.withColumn("chord", geo.planar(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")))
    return g.select("track_id", "total_change", "avg_change", "max_change", F.coalesce(F.try_divide("length", "chord"), F.lit(1.0)).alias("sinuosity"), F.coalesce(F.try_divide("chord", "length"), F.lit(0.0)).alias("straightness"))


BOXES = (0.001, 0.002, 0.005, 0.01, 0.02)


def fractal_dimension(df: DataFrame, boxes: tuple[float, ...] = BOXES) -> DataFrame:
    """Box counting: minus the slope of log(boxes met) over log(size)."""
    d = df.withColumns({"x": F.col("lon") - F.min("lon").over(whole()), "y": F.col("lat") - F.min("lat").over(whole())})
    d = d.withColumn("box", F.explode(F.array(*map(F.lit, boxes))))
    counts = d.groupBy("track_id", "box").agg(F.countDistinct(F.floor(F.col("x") / F.col("box")), F.floor(F.col("y") / F.col("box"))).alias("met"))
    return counts.groupBy("track_id").agg((-F.regr_slope(F.log("met"), F.log("box"))).alias("fractal_dimension"))


def mad(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """Median and median absolute deviation (also scaled to a normal's deviation)."""
    med = df.groupBy(*keys).agg(F.median(x).alias("median"))
    return df.join(med, [*keys]).groupBy(*keys).agg(F.first("median").alias("median"), F.median(F.abs(F.col(x) - F.col("median"))).alias("mad")).withColumn("mad_scaled", F.col("mad") * 1.4826)


def robust_normalised(df: DataFrame, x: str) -> DataFrame:
    m = mad(df, x, "track_id").select("track_id", "median", "mad")
    return df.join(m, "track_id").withColumn(f"{x}_robust", F.when(F.col("mad") > 1e-8, (F.col(x) - F.col("median")) / F.col("mad")).otherwise(F.col(x) - F.col("median"))).drop("median", "mad")


def mean_signature(df: DataFrame, key: str, idx: str, *features: str) -> DataFrame:
    """Element-wise mean of several event signatures."""
    total = sum((F.col(f) for f in features), F.lit(0.0)) / len(features)
    return df.select(key, idx, total.alias("signature"))


# ---- objects


def traffic_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("video_id", "object_class").agg(F.count("*").alias("total_count"))


def object_summary(det: DataFrame, moving_px: float = 20.0) -> DataFrame:
    """Per video and object: frames seen, last place, idle or moving (mean step above 20 px)."""
    w = W.partitionBy("video_id", "object_class").orderBy("det_idx")
    cx, cy = geo.centroid(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    d = det.withColumns({"cx": cx, "cy": cy})
    step = F.sqrt((F.col("cx") - F.lag("cx").over(w)) ** 2 + (F.col("cy") - F.lag("cy").over(w)) ** 2)
    g = d.withColumn("step", step).groupBy("video_id", "object_class").agg(F.count("*").alias("frames_seen"), F.max_by("cx", "det_idx").alias("last_x"), F.max_by("cy", "det_idx").alias("last_y"), F.avg("step").alias("mean_step"))
    return g.withColumn("motion", F.when(F.col("mean_step") > moving_px, "moving").otherwise("idle")).drop("mean_step")


def keyed_summary(det: DataFrame) -> DataFrame:
    """Per video and (hashed) key: mean place, first frame and class seen, greatest confidence."""
    cx, cy = geo.centroid(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return det.withColumns({"cx": cx, "cy": cy}).groupBy("video_id", "frame_second").agg(F.avg("cx").alias("mean_x"), F.avg("cy").alias("mean_y"), F.min("det_idx").alias("first_idx"), F.min_by("object_class", "det_idx").alias("first_class"), F.max("confidence").alias("max_confidence"))


def object_motion(det: DataFrame) -> DataFrame:
    """Step in pixels, pixel bearing, and speed by a reference speed of 1 for 100 px. A step of no
    length has a bearing of 180, atan2(0, -0), which Spark's atan2 doesn't tell from atan2(0, 0). What
    is short of 360 by less than the digits hold is 0."""
    w = W.partitionBy("video_id", "object_class").orderBy("det_idx")
    cx, cy = geo.centroid(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    d = det.withColumns({"cx": cx, "cy": cy})
    d = d.withColumns({"dx": F.col("cx") - F.lag("cx").over(w), "dy": F.col("cy") - F.lag("cy").over(w)})
    px = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    angle = F.when((F.col("dx") == 0) & (F.col("dy") == 0), 180.0).otherwise(F.degrees(F.atan2("dx", -F.col("dy"))))
    return d.select("video_id", "object_class", "det_idx", F.coalesce(px, F.lit(0.0)).alias("step_px"), F.coalesce(((angle + 360) % 360 + 360) % 360, F.lit(0.0)).alias("px_bearing"), F.coalesce(px / 100, F.lit(0.0)).alias("ref_speed"))


def travel_direction(det: DataFrame) -> DataFrame:
    """Where an object went, from its first to its last box: left, right, toward or away, or still."""
    cx, cy = geo.centroid(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    g = det.groupBy("video_id", "object_class").agg(F.min_by(F.struct(cx.alias("x"), cy.alias("y")), "det_idx").alias("a"), F.max_by(F.struct(cx.alias("x"), cy.alias("y")), "det_idx").alias("b"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    across = F.when(dx > 0, "right").otherwise("left")
    return g.select("video_id", "object_class", dx.alias("dx"), dy.alias("dy"), F.when((dx == 0) & (dy == 0), "still").when(F.abs(dx) >= F.abs(dy), across).when(dy > 0, "toward").otherwise("away").alias("direction"))
