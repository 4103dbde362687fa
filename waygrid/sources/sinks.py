"""Sinks: committed by Spark's protocol, idempotent where a run may repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest(df: DataFrame, keys: list[str], order: str = "processed_at") -> DataFrame:
    """One row a key, the latest: what INSERT OR REPLACE leaves. Aggregates before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), *[F.to_json(F.struct(*rest))])).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str = "processed_at") -> DataFrame:
    return latest(old.unionByName(new, allowMissingColumns=True), keys, order)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of a key's rows are new ones where there are any: a merge of whole match lists."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_per_video(df: DataFrame, path: str, fmt: str = "csv", key: str = "video_id") -> None:
    """A folder for each video that has rows. Arrays become JSON text in CSV."""
    flat = df.select(*[F.to_json(c).alias(c) if fmt == "csv" and t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    writer = flat.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def match_report(matches: DataFrame) -> DataFrame:
    """One row a video: value = {"video_id": ..., "matches": [best first]}."""
    rest = [c for c in matches.columns if c != "video_id"]
    ordered = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in ("rank", *[x for x in rest if x != "rank"])])))
    return matches.groupBy("video_id").agg(ordered.alias("matches")).select(F.to_json(F.struct("video_id", "matches")).alias("value"))


def summary_json(counts: DataFrame) -> DataFrame:
    """Per video: total and by class, as one JSON text."""
    per = counts.groupBy("video_id").agg(F.sum("total_count").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("object_type", "total_count")))).alias("by_type"))
    return per.select("video_id", F.to_json(F.struct("total", "by_type")).alias("summary"))


def combined(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows with a source column; columns that a part lacks are NULL."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("source_name", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def serving_names(files: DataFrame) -> DataFrame:
    """Names under which a folder serves files: a name that several folders have gets its
    folder's name in front."""
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    many = F.count("*").over(W.partitionBy("name")) > 1
    return named.withColumn("served", F.when(many, F.concat_ws("_", "folder", "name")).otherwise(F.col("name")))


def prefix_groups(files: DataFrame, least: int = 2) -> DataFrame:
    """Prefixes (before the first underscore) that at least `least` files share."""
    prefix = F.regexp_extract("path", r"([^/_]+)_[^/]*$", 1)
    return files.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("files")).where((F.col("prefix") != "") & (F.col("files") >= least))


def synthetic_match(videos: DataFrame) -> DataFrame:
    """Match documents for videos whose track was merged before: score 1, a grade of its own."""
    match = F.struct(F.col("path"), F.lit(1.0).alias("combined_score"), F.lit("synthetic_conversion").alias("quality"))
    return videos.select(F.to_json(F.create_map("video_id", F.struct(F.array(match).alias("matches")))).alias("value"))


def rejects(df: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason against them, the others with it)."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
