"""Grades, parsers and other scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import ADAPTIVE, ENSEMBLE, QUALITY, QUALITY_LEVELS

# ---- numbers


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def sigmoid(x: Column, steepness: float = 10.0, centre: float = 0.5) -> Column:
    return 1 / (1 + F.exp(-F.lit(steepness) * (x - F.lit(centre))))


def number_or(x: Column, default: float = 0.0, kind: str = "double") -> Column:
    """Text as a number, or the default."""
    return F.coalesce(x.try_cast(kind), F.lit(default).cast(kind))


def positive_or_next(*columns: Column) -> Column:
    """The first that is a positive number, else 0: stream value, container value, nothing."""
    tries = [c.try_cast("double") for c in columns]
    return F.coalesce(*[F.when(t > 0, t) for t in tries], F.lit(0.0))


def nan_inf_filled(values: Column, inf: float = 1.0) -> Column:
    """Array with 0 for NULL and NaN and `inf` for infinities."""
    return F.transform(values, lambda v: F.when(v.isNull() | F.isnan(v), 0.0).when(F.abs(v) == float("inf"), inf).otherwise(v))


def padded(values: Column, length: int) -> Column:
    """Array cut or filled with zeros to a length."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), length)), 1, length)


def every(values: Column, step: int) -> Column:
    return F.filter(values, lambda _, i: F.pmod(i, F.lit(step)) == 0)


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length; 0 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda x: F.slice(x, 1, n)
    dot = F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.when(n > 0, F.coalesce(F.try_divide(dot, norm(cut(a)) * norm(cut(b))), F.lit(0.0))).otherwise(0.0)


# ---- normalisation over a set of rows


def minmax(x: Column, over=None, inverse: bool = False) -> Column:
    """To 0..1 over the rows; 0.5 where all are equal."""
    w = over if over is not None else W.partitionBy()
    low, high = F.min(x).over(w), F.max(x).over(w)
    share = F.when(high > low, (x - low) / (high - low)).when(x.isNotNull(), 0.5)
    return 1 - share if inverse else share


def by_max(x: Column, over=None) -> Column:
    """x / max, 0 where the maximum isn't positive."""
    high = F.max(x).over(over if over is not None else W.partitionBy())
    return F.when(high > 0, x / high).otherwise(0.0)


# ---- grades


def steps(x: Column, bounds, otherwise: str, strict: bool = False) -> Column:
    """The first label whose bound x reaches (or, strict, exceeds)."""
    out = None
    for label, bound in bounds:
        test = x > bound if strict else x >= bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def quality_grade(score: Column) -> Column:
    return steps(score, QUALITY, "very_poor")


def quality_level(grade: Column) -> Column:
    """very_poor 0 to excellent 5; 0 for anything else."""
    return F.greatest(F.array_position(F.array(*map(F.lit, QUALITY_LEVELS)), grade) - 1, F.lit(0)).cast("int")


def confidence_band(score: Column) -> Column:
    return steps(score, (("excellent", 0.6), ("high", 0.4), ("medium", 0.25), ("low", 0.15)), "very_low", strict=True)


def sync_grade(correlation: Column, refined: Column) -> Column:
    """Grade of a refined offset; one that wasn't refined stays poor."""
    r = F.abs(correlation)
    return F.when(~refined | r.isNull(), "poor").when(r >= 0.7, "excellent").when(r >= 0.5, "good").otherwise("fair")


def weighted_mean(scores: dict[str, Column], weights: dict[str, float], default: float | None = None) -> tuple[Column, Column]:
    """(mean over the finite scores by weight, share of scores that were finite); NULL-safe, 0 for none."""
    total, weight, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for name, x in scores.items():
        w = weights.get(name, default)
        if w is None:
            continue
        ok = finite(x)
        total, weight, n = total + F.when(ok, x * w).otherwise(0.0), weight + F.when(ok, w).otherwise(0.0), n + F.when(ok, 1).otherwise(0)
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0)), n / F.lit(float(len(scores)))


def ensemble_score(scores: dict[str, Column], weights: dict[str, float] = ENSEMBLE) -> tuple[Column, Column]:
    """(score over 0..1, confidence): components that are NaN, NULL or negative don't count, the
    others' weights share the whole."""
    mean, share = weighted_mean({k: F.when(x >= 0, x) for k, x in scores.items()}, weights)
    return clip(mean, 0.0, 1.0), share


def half_up(x: Column, digits: int) -> Column:
    """A finite number rounded as DuckDB does: the product with a power of ten, halves away from 0.
    (Spark's round works on the decimals that are printed, which may lie on the other side of a half.)"""
    y = F.abs(x) * 10.0**digits
    whole = F.floor(y)
    return F.signum(x) * (whole + F.when(y - whole >= 0.5, 1).otherwise(0)) / 10.0**digits


def adaptive_score(scores: dict[str, Column]) -> Column:
    return weighted_mean(scores, ADAPTIVE, default=0.5)[0]


# ---- duration


def duration_ratio(track_s: Column, video_s: Column) -> Column:
    return F.when((video_s > 0) & (track_s > 0), track_s / video_s)


def temporal_quality(r: Column, excellent=(0.85, 1.15), good=(0.75, 1.35), fair=(0.65, 1.5)) -> Column:
    return F.when(r.between(*excellent), "excellent").when(r.between(*good), "good").when(r.between(*fair), "fair").when(r.isNotNull(), "poor").otherwise("invalid")


def duration_score(r: Column) -> Column:
    return F.coalesce(F.exp(-2 * F.abs(r - 1)), F.lit(0.0))


def duration_weighted(base: Column, r: Column, quality: Column) -> Column:
    """base by the temporal quality's weight; an excellent one above 0.6 gets up to 0.1 more."""
    weight = F.when(quality == "excellent", 1.0).when(quality == "good", 0.95).when(quality == "fair", 0.85).when(quality == "poor", 0.7).otherwise(0.5)
    bonus = F.when((quality == "excellent") & (base > 0.6), duration_score(r) * 0.1).otherwise(0.0)
    return F.when((quality == "excellent") & (base > 0.6), F.least(base * weight + bonus, F.lit(1.0))).otherwise(base * weight)


def duration_grade(score: Column, quality: Column, r: Column) -> Column:
    """The grade, lower by 1 for a fair, 2 for a poor and 3 for no temporal quality; at most
    poor where it would be very good or better though the durations are worlds apart."""
    down = F.when(quality.isin("excellent", "good"), 0).when(quality == "fair", 1).when(quality == "poor", 2).otherwise(3)
    level = F.greatest(F.lit(0), quality_level(quality_grade(score)) - down)
    grade = F.element_at(F.array(*map(F.lit, QUALITY_LEVELS)), (level + 1).cast("int"))
    return F.when(((r < 0.3) | (r > 3.0)) & grade.isin("very_good", "excellent"), "poor").otherwise(grade)


# ---- media


#: Words in file names that speak for or against a panorama.
WORDS_360 = ("360", "vr", "spherical", "equirect", "panoramic", "insta360", "theta", "ricoh")
WORDS_FLAT = ("flat", "standard", "normal", "regular")


def is_360(width: Column, height: Column) -> Column:
    return F.coalesce(F.try_divide(width, height).between(1.8, 2.2), F.lit(False))


def video_type(width: Column, height: Column, name: Column) -> Column:
    """struct(type, confidence) by shape, then words in the name, then resolution. Each hint
    that agrees adds to the confidence, one that doesn't turns the type around."""
    shape = F.try_divide(width, height)
    state = F.when(shape.between(1.8, 2.2), F.struct(F.lit("360").alias("type"), F.lit(0.8).alias("confidence"))).when(shape.between(0.45, 0.55), F.struct(F.lit("360").alias("type"), F.lit(0.7).alias("confidence"))).otherwise(F.struct(F.lit("flat").alias("type"), F.lit(0.0).alias("confidence")))
    low = F.lower(name)
    hints = [
        (low.rlike("|".join(WORDS_360)), "360", 0.6, 0.15),
        (low.rlike("|".join(WORDS_FLAT)), "flat", 0.6, 0.15),
        ((width >= 3840) & (height >= 1920), "360", 0.5, 0.1),
    ]
    for test, kind, fresh, more in hints:
        agree = F.struct(F.lit(kind).alias("type"), F.least(F.lit(0.95), state["confidence"] + more).alias("confidence"))
        turned = F.struct(F.lit(kind).alias("type"), F.lit(fresh).alias("confidence"))
        state = F.when(test, F.when(state["type"] == kind, agree).otherwise(turned)).otherwise(state)
    return state


# Codecs that decode fast, and those that need conversion.
FRIENDLY_CODECS = ("avc1", "h264", "mp4v", "mpeg4")
PROBLEM_CODECS = ("av1", "h265", "hevc", "vp8", "vp9")


def codec_grade(codec: Column, width: Column, height: Column, pixel_format: Column) -> Column:
    hd, uhd = (width <= 1920) & (height <= 1080), (width <= 3840) & (height <= 2160)
    deep = F.lower(pixel_format).rlike("10bit|10le")
    return (
        F.when(F.lower(codec).isin(*FRIENDLY_CODECS), F.when(hd, "excellent").when(uhd, "good").otherwise("fair"))
        .when(F.lower(codec).isin(*PROBLEM_CODECS), F.when(deep, "poor").when(hd, "fair").otherwise("poor"))
        .otherwise("unknown")
    )


def admitted(grade: Column, width: Column, height: Column, mode: str = "ultra") -> Column:
    """Strict admission: ultra wants a known, fair grade and at most 3840 x 2160; strict only a processable codec."""
    if mode == "ultra":
        return ~grade.isin("poor", "incompatible", "unknown") & (width <= 3840) & (height <= 2160)
    return grade != "incompatible" if mode == "strict" else F.lit(True)


def work_weight(size_bytes: Column, width: Column, height: Column) -> Column:
    """How heavy a video is to process, 1 to 5: a hint for partitioning."""
    mb, pixels = size_bytes / F.lit(1024.0 * 1024.0), width * height
    base = F.when(mb > 1000, 3.0).when(mb > 500, 2.0).when(mb > 100, 1.5).otherwise(1.0)
    wide = F.when(F.try_divide(width, height) >= 1.8, 1.8).otherwise(1.0)
    return F.least(base * wide * F.when(pixels > 8000000, 1.5).when(pixels > 2000000, 1.2).otherwise(1.0), F.lit(5.0))


def processing_minutes(mean_duration_s: Column, n_videos: Column, workers: int) -> Column:
    """Estimate: a tenth of the videos' time, shared by the workers."""
    return mean_duration_s * n_videos * 0.1 / workers / 60


def light_color(hue: Column) -> Column:
    """Signal colour of a dominant hue (0 to 180)."""
    return F.when(hue.between(0, 10) | hue.between(160, 180), "red").when(hue.between(15, 35), "yellow").when(hue.between(36, 89), "green").otherwise("unknown")


def decibels(level: Column) -> Column:
    """Level to 2 digits; silence (none, or minus infinity) is -100."""
    return F.when(level.isNull() | F.isnan(level) | (level == float("-inf")), -100.0).otherwise(F.round(level, 2))


def noise_level(rms: Column) -> Column:
    return rms * 100


def scene_complexity(edge_density: Column, texture: Column, gradient: Column) -> Column:
    return (edge_density + texture / 10000 + gradient / 100) / 3


def gaussian_weight(row: Column, height: Column, spread: float = 0.25) -> Column:
    """Weight of an image row, most at the middle."""
    return F.exp(-F.pow((row - height / 2) / (height * spread), 2) / 2)


def latitude_weight(row: Column, height: Column) -> Column:
    """Cosine weight of an equirectangular row."""
    return F.cos((row / height - 0.5) * F.lit(3.141592653589793))


# ---- text


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w\-_.]", "_")


def location_key(lat: Column, lon: Column) -> Column:
    """Key of a place to five digits."""
    return F.concat_ws(",", F.format_string("%.5f", lat.cast("double")), F.format_string("%.5f", lon.cast("double")))


def time_of(text: Column) -> Column:
    """Timestamp of an ISO text, NULL if it is none."""
    return F.try_to_timestamp(text)


def camera_time(name: Column) -> Column:
    """Timestamp in a camera file's name, VID_YYYYMMDD_HHMMSS_..."""
    digits = F.regexp_replace(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), "_", "")
    return F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyyMMddHHmmss"))


def hashed_id(text: Column, salt: str, length: int = 16) -> Column:
    """Salted id of a personal value; the value itself isn't kept."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lower(F.trim(text))), 256), 1, length)


def clean_label(text: Column, low: int = 3, high: int = 10) -> Column:
    """Upper case letters and digits of a text, NULL unless there are low to high of them."""
    x = F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")
    return F.when(F.length(x).between(low, high), x)


# Colours of object classes on the map.
COLORS = {
    "bicycle": "#00CED1", "boat": "#1E90FF", "bus": "#FF8C00", "car": "#FF0000", "fire hydrant": "#FFD700", "motorcycle": "#FF1493",
    "pedestrian": "#00FF00", "person": "#00FF00", "skateboard": "#FF69B4", "skis": "#87CEEB", "traffic light": "#FFFF00", "truck": "#8B0000",
}


def class_color(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lit("#808080"))


def bbox_array(text: Column) -> Column:
    """[x1, y1, x2, y2] written as text."""
    return F.from_json(text, "array<double>")
