"""Schemas of the domain's tables, and one step that brings other spellings to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACK_POINT = "track_id string, segment_idx int, pt_idx int, lat double, lon double, elevation double, ts timestamp"
VIDEO = "video_id string, width int, height int, fps double, frame_count int, duration_s double, is_360 boolean, type string, type_confidence double"
VIDEO_MOTION = "video_id string, idx int, t double, motion_magnitude double, color_variance double, edge_density double"
ALIGNED = "second int, lat double, lon double, speed_mph double"
MERGED = "second int, lat double, lon double, speed_mph double, gpx_time timestamp"
DETECTION = "frame_second int, object_class string, bbox array<double>, confidence double, lat double, lon double, gps_time string, video_type string"
RAW_DETECTION = "video_id string, frame int, object_id int, object_type string, x1 double, y1 double, x2 double, y2 double, conf double, frame_h int"
STOPLIGHT = "stoplight string, second int, lat double, lon double, gpx_time timestamp"
FRAME_NOISE = "frame int, gpx_time timestamp, lat double, lon double, noise double"
AUDIO_WINDOW = "second int, rms_energy double, spectral_centroid double, zero_crossing_rate double, noise_level double, lat double, lon double, gps_time string"
SCENE = "second int, edge_density double, texture_variance double, color_variance double, gradient_magnitude double, complexity_score double, lat double, lon double, gps_time string"
PROGRESS = "path string, status string, processed_at timestamp, best_match_score double, best_match_path string, error_message string"
MATCH = "struct<path:string,combined_score:double,motion_score:double,temporal_score:double,statistical_score:double,optical_flow_score:double,cnn_feature_score:double,advanced_dtw_score:double,quality:string,confidence:double,distance:double,duration:double,avg_speed:double,is_360_video:boolean,processing_mode:string,error:string,temporal_offset_seconds:double,offset_confidence:double,offset_method:string,sync_quality:string>"
MATCH_MAP = f"map<string,struct<matches:array<{MATCH}>>>"

#: Other spellings of columns.
ALIASES = {"lat": ("lat", "latitude", "cam lat", "cam_lat"), "lon": ("lon", "long", "lng", "longitude", "cam lon", "cam_lon"), "second": ("second", "seconds", "frame_second"), "object_class": ("object_class", "object type", "object_type", "type"), "confidence": ("confidence", "conf")}


def fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ", 1)) for x in schema.split(",") if "<" not in x]


def normalise(df: DataFrame, schema: str, keep_rest: bool = False) -> DataFrame:
    """df with the columns of a schema: names matched without regard to case and by their other
    spellings, values by try_cast, missing ones NULL."""
    have = {c.lower().strip(): c for c in df.columns}
    taken, out = set(), []
    for name, kind in fields(schema):
        found = next((have[a] for a in (name, *ALIASES.get(name, ())) if a in have and have[a] not in taken), None)
        if found:
            taken.add(found)
            out.append(F.col(f"`{found}`").try_cast(kind).alias(name))
        else:
            out.append(F.lit(None).cast(kind).alias(name))
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if keep_rest and c not in taken])


def missing_columns(df: DataFrame, required) -> list[str]:
    """Required columns that df lacks; empty if it can be admitted."""
    return sorted(set(required) - set(df.columns))
