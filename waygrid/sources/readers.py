"""Readers: GPX, the CSV family, match documents, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.functions.scalar import bbox_array
from waygrid.sources.schemas import ALIGNED, AUDIO_WINDOW, MATCH_MAP, MERGED, STOPLIGHT, normalise

GPX = "trkseg array<struct<trkpt:array<struct<_lat:double,_lon:double,ele:double,time:string>>>>"


def plain_path(path: Column) -> Column:
    """One spelling of a local path, which Spark's sources give as file:/x, file:///x, with %20."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "%20", " ")


def gpx_points(spark: SparkSession, path) -> DataFrame:
    """Track points of GPX files in document order. One row of the scan is one <trk>; broken
    files give no points (see gpx_rejects)."""
    raw = spark.read.format("xml").option("rowTag", "trk").option("mode", "PERMISSIVE").schema(GPX).load(path)
    seg = raw.select(plain_path(F.input_file_name()).alias("track_id"), F.monotonically_increasing_id().alias("trk"), F.posexplode("trkseg").alias("segment_idx", "seg"))
    pt = seg.select("track_id", "trk", "segment_idx", F.posexplode("seg.trkpt").alias("k", "p"))
    order = W.partitionBy("track_id").orderBy("trk", "segment_idx", "k")
    return pt.select("track_id", "segment_idx", (F.row_number().over(order) - 1).alias("pt_idx"), F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("elevation"), F.try_to_timestamp(F.col("p.time")).alias("ts"))


def gpx_tracks(spark: SparkSession, path, min_points: int = 10) -> DataFrame:
    """Points with a time, elevation 0 where missing, of tracks that have min_points of them."""
    pts = gpx_points(spark, path).where("ts is not null and lat is not null and lon is not null").withColumn("elevation", F.coalesce("elevation", F.lit(0.0)))
    return pts.withColumn("n", F.count("*").over(W.partitionBy("track_id"))).where(F.col("n") >= min_points).drop("n")


def gpx_seconds(points: DataFrame, per_segment: bool = False) -> DataFrame:
    """second: the point's index in the track, or in its segment."""
    keys = ["track_id"] + ["segment_idx"] * per_segment
    return points.withColumn("second", F.row_number().over(W.partitionBy(*keys).orderBy("pt_idx")) - 1)


def relative_seconds(points: DataFrame) -> DataFrame:
    first = F.min_by(F.unix_micros("ts"), "pt_idx").over(W.partitionBy("track_id"))
    return points.withColumn("t", (F.unix_micros("ts") - first) / 1e6)


def advancing(points: DataFrame) -> DataFrame:
    """Points whose time is later than that of all before them in document order: those that
    a scan keeps which skips points without progress."""
    before = F.max("ts").over(W.partitionBy("track_id").orderBy("pt_idx").rowsBetween(W.unboundedPreceding, -1))
    return points.where("ts is not null").withColumn("b", before).where("b is null or ts > b").drop("b")


def gpx_rejects(spark: SparkSession, path, min_points: int = 10) -> DataFrame:
    """path, reason of the files that gave too few points; files are never moved or deleted."""
    files = listing(spark, path).select(F.col("path"))
    good = gpx_points(spark, path).where("ts is not null").groupBy("track_id").count()
    joined = files.join(good, files["path"] == good["track_id"], "left")
    return joined.select("path", F.when(F.col("count").isNull(), "no points").when(F.col("count") < min_points, "too few points").alias("reason")).where("reason is not null")


def csv_table(spark: SparkSession, path, schema: str) -> DataFrame:
    """A CSV with any of the known headers as the given schema. Headers decide, never
    inferred types."""
    return normalise(spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path), schema)


def merged_csv(spark: SparkSession, path) -> DataFrame:
    return csv_table(spark, path, MERGED)


def aligned_csv(spark: SparkSession, path) -> DataFrame:
    return csv_table(spark, path, ALIGNED)


def stoplight_csv(spark: SparkSession, path, most: int | None = None) -> DataFrame:
    """Signals; `most` rows at most where a report asks for it."""
    df = csv_table(spark, path, STOPLIGHT)
    return df if most is None else df.limit(most)


def audio_csv(spark: SparkSession, path) -> DataFrame:
    return csv_table(spark, path, AUDIO_WINDOW)


def detection_csv(spark: SparkSession, path, most: int | None = None) -> DataFrame:
    """Detections; the box is a quoted list."""
    kinds = "frame_second int, object_class string, bbox string, confidence double, lat double, lon double, gps_time string, video_type string"
    df = csv_table(spark, path, kinds).withColumn("bbox", bbox_array(F.col("bbox")))
    return df if most is None else df.limit(most)


def any_map_csv(spark: SparkSession, path) -> tuple[str, DataFrame]:
    """(kind, rows) by the header: enhanced detections, aligned points, or generic places."""
    names = {c.lower() for c in spark.read.option("header", True).csv(path).columns}
    if {"object_class", "confidence"} <= names:
        return "enhanced", detection_csv(spark, path)
    if "second" in names and names & {"speed_mph", "speed"}:
        return "aligned", aligned_csv(spark, path)
    return "generic", csv_table(spark, path, "lat double, lon double, object_class string")


def match_documents(spark: SparkSession, path) -> DataFrame:
    """video_id, rank, and the fields of every match, from documents with `results` or the bare map."""
    text = spark.read.text(path, wholetext=True)
    doc = F.coalesce(F.get_json_object("value", "$.results"), F.col("value"))
    entries = text.select(F.explode(F.from_json(doc, MATCH_MAP)).alias("video_id", "entry"))
    return entries.select("video_id", F.posexplode("entry.matches").alias("pos", "m")).select("video_id", (F.col("pos") + 1).alias("rank"), "m.*")


def listing(spark: SparkSession, path, pattern: str = "*") -> DataFrame:
    """path, modified, length of files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(plain_path(F.col("path")).alias("path"), F.col("modificationTime").alias("modified"), "length").distinct()


def by_age(files: DataFrame, priority: Column | None = None) -> DataFrame:
    """First come, first served; files of the priority lane before the others."""
    lane = F.when(priority, 0).otherwise(1) if priority is not None else F.lit(0)
    return files.withColumn("lane", lane).orderBy("lane", "modified", "path")


def from_yesterday(files: DataFrame, today: Column | None = None) -> DataFrame:
    day = today if today is not None else F.current_date()
    return files.where((F.col("modified") >= F.date_sub(day, 1)) & (F.col("modified") < day.cast("timestamp")))


def large_enough(files: DataFrame, video: int = 1024, gpx: int = 100) -> DataFrame:
    """Files that can hold what their name says: over 1024 bytes, GPX over 100."""
    return files.where(F.when(F.lower("path").endswith(".gpx"), F.col("length") > gpx).otherwise(F.col("length") > video))


def owned(files: DataFrame, user_id: str) -> DataFrame:
    """Files of a user, by the folder's name."""
    return files.where(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).startswith(user_id))


def orphans(files: DataFrame) -> DataFrame:
    """Folders with a video but no GPX or the other way round: a report, nothing is deleted."""
    dirs = files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"))
    has = dirs.agg(F.bool_or(F.lower("path").rlike(r"\.(mp4|mov|avi|mkv)$")).alias("has_video"), F.bool_or(F.lower("path").endswith(".gpx")).alias("has_gpx"))
    return has.where("has_video != has_gpx")
