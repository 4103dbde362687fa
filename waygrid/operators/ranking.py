"""Filters and ranks of matches, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.functions.scalar import confidence_band, quality_level


def best_then_filter(matches: DataFrame, score: float = 0.7, level: int = 4) -> DataFrame:
    """The best match of each video, if it is good enough."""
    return matches.where((F.col("rank") == 1) & (F.col("score") >= score) & (quality_level(F.col("quality")) >= level))


def filter_then_best(matches: DataFrame, score: float = 0.5, level: int = 2) -> DataFrame:
    """The first good enough match of each video. (The order matters: not the same as above.)"""
    ok = matches.where((F.col("score") >= score) & (quality_level(F.col("quality")) >= level))
    rest = [c for c in matches.columns if c != "video_id"]
    return ok.groupBy("video_id").agg(F.min_by(F.struct(*rest), "rank").alias("m")).select("video_id", "m.*")


def top_above(matches: DataFrame, n: int = 10, score: float = 0.3) -> DataFrame:
    return matches.where((F.col("rank") <= n) & (F.col("score") >= score))


def share(df: DataFrame, part: int, parts: int, *order: Column) -> DataFrame:
    """Every parts-th row in a total order. (For contracts that name it; Spark splits work itself.)"""
    return df.withColumn("rn", F.row_number().over(W.orderBy(*order)) - 1).where(F.pmod("rn", F.lit(parts)) == part).drop("rn")


def chunks(df: DataFrame, size: int, *order: Column) -> DataFrame:
    return df.withColumn("chunk", F.floor((F.row_number().over(W.orderBy(*order)) - 1) / size))


def balanced(df: DataFrame, weight: str, parts: int, key: str) -> DataFrame:
    """part of each row, the heaviest dealt first, back and forth."""
    n = F.row_number().over(W.orderBy(F.desc(weight), key)) - 1
    lap, at = F.floor(n / parts), F.pmod(n, F.lit(parts))
    return df.withColumn("part", F.when(F.pmod(lap, F.lit(2)) == 0, at).otherwise(parts - 1 - at))


def best_match(matches: DataFrame, offsets: bool = False) -> DataFrame:
    """One row a video: its best match by score, the first on ties; NO_GOOD_MATCH where no score is known."""
    known = F.when(F.col("score").isNotNull(), F.struct(F.col("score"), -F.col("rank")))
    g = matches.groupBy("video_id").agg(F.max_by(F.struct("track_id", "score", "quality"), known).alias("m"))
    return g.select("video_id", F.coalesce("m.track_id", F.lit("NO_GOOD_MATCH")).alias("best_track"), F.col("m.score").alias("score"), F.col("m.quality").alias("quality"))


def sorted_best(best: DataFrame) -> DataFrame:
    return best.orderBy(F.desc_nulls_last("score"), "video_id")


def confidence_report(matches: DataFrame) -> DataFrame:
    """Videos by the confidence band of their best score."""
    return matches.where("rank = 1").groupBy(confidence_band(F.col("score")).alias("band")).agg(F.count("*").alias("videos"))


def score_report(matches: DataFrame) -> DataFrame:
    best = matches.where("rank = 1")
    return best.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("low"), F.max("score").alias("high"), F.median("score").alias("median"))


def run_summary(matches: DataFrame) -> DataFrame:
    b = matches.where("rank = 1")
    q = F.col("quality")
    return b.agg(F.count("*").alias("videos"), F.count_if(F.col("score") > 0.1).alias("successful"), F.count_if(q == "excellent").alias("excellent"), F.count_if(q.isin("good", "very_good")).alias("good"), F.avg(F.when(F.col("score") > 0, F.col("score"))).alias("mean_positive"), F.median(F.when(F.col("score") > 0, F.col("score"))).alias("median_positive"), F.try_divide(F.count_if(F.col("score") > 0.1), F.count("*")).alias("success_rate"))


def progress_summary(state: DataFrame, *keys: str) -> DataFrame:
    """completed, failed, total, remaining, completion and success rate (processed / max(processed + failed, 1) %)."""
    s = F.col("status")
    g = state.groupBy(*keys) if keys else state.groupBy()
    d = g.agg(F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.count("*").alias("total"))
    return d.withColumns({"remaining": F.col("total") - F.col("completed"), "completion_rate": F.try_divide("completed", "total"), "success_rate": F.col("completed") * 100 / F.greatest(F.col("completed") + F.col("failed"), F.lit(1))})


def validation_report(v: DataFrame) -> DataFrame:
    """status counts and success rate of checked files."""
    s = F.col("status")
    return v.agg(F.count_if(s == "valid").alias("valid"), F.count_if(s == "corrupted").alias("corrupted"), F.count_if(s == "rejected").alias("rejected"), F.try_divide(F.count_if(s == "valid"), F.count("*")).alias("success_rate"))


def distribution(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def ratio_report(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("quality").agg(F.count("*").alias("n"), F.min("ratio").alias("low"), F.max("ratio").alias("high"), F.avg("ratio").alias("mean"))


def merged_runs(parts: DataFrame) -> DataFrame:
    """Totals of several workers: sums, the slowest's time, and the speed-up over one after the other."""
    return parts.agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.max("seconds").alias("seconds"), F.try_divide(F.sum("seconds"), F.max("seconds")).alias("speedup"))
