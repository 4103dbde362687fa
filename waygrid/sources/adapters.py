"""The star schema's `events` and `embeddings` as tables of the domain: a user's events are a
track, a video's motion series, and its detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("uid"), n.alias("n"), "ts", (F.unix_micros("ts") / 1e6).alias("epoch_s"), "value", k.alias("k"), "event_type", "event_id")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, pt_idx, ts, epoch_s, lat, lon, elevation"""
    e = numbered_events(spark, sf_dir)
    return e.select(F.col("uid").alias("track_id"), F.col("n").alias("pt_idx"), "ts", "epoch_s", (F.lit(44.95) + F.col("value") / 10000.0).alias("lat"), (F.lit(-93.30) + F.col("k") / 10000.0).alias("lon"), F.col("value").alias("elevation"))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, idx, t, motion_magnitude"""
    e = numbered_events(spark, sf_dir)
    t = F.col("epoch_s") - F.min("epoch_s").over(W.partitionBy("uid"))
    return e.select(F.col("uid").alias("video_id"), F.col("n").alias("idx"), t.alias("t"), F.col("value").alias("motion_magnitude"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, det_idx, frame_second, object_class, confidence and a box"""
    e = numbered_events(spark, sf_dir)
    v = F.col("value")
    return e.select(F.col("uid").alias("video_id"), F.col("n").alias("det_idx"), F.hour("ts").alias("frame_second"), F.col("event_type").alias("object_class"), (F.col("k") / 100.0).alias("confidence"), v.alias("x1"), (v / 2).alias("y1"), (v + F.col("k")).alias("x2"), (v / 2 + F.col("k")).alias("y2"))
