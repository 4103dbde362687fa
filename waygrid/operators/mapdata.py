"""What the map shows: groups of places, heat layers, paths, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.functions import geo


def speed_heat(df: DataFrame, scale: float = 50.0) -> DataFrame:
    """Mean speed at each exact place, as a share of `scale`."""
    return df.groupBy("lat", "lon").agg((F.avg("speed_mph") / scale).alias("heat"))


def signal_groups(df: DataFrame) -> DataFrame:
    """Signals at one place (five digits): count and percentage of each status."""
    g = df.groupBy(F.round("lat", 5).alias("lat5"), F.round("lon", 5).alias("lon5"), F.lower("status").alias("status")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.col("n") * 100 / F.sum("n").over(W.partitionBy("lat5", "lon5")))


def object_paths(df: DataFrame, low: float, high: float) -> DataFrame:
    """Objects' points within a time range, in order, with both ends."""
    d = df.where(F.col("second").between(low, high))
    g = d.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("second", "det_idx", "x", "y"))).alias("path"), F.count("*").alias("points"))
    return g.select("object_id", "points", F.transform("path", lambda p: F.concat_ws(":", p["second"].cast("string"), p["det_idx"].cast("string"))).alias("order"), F.col("path")[0]["x"].alias("start_x"), F.element_at("path", -1)["x"].alias("end_x"))


def bounds(df: DataFrame) -> DataFrame:
    ok = geo.in_range(F.col("lat"), F.col("lon")) & geo.nonzero(F.col("lat"), F.col("lon"))
    pick = lambda c: F.when(ok, F.col(c))
    return df.agg(F.min(pick("lat")).alias("south"), F.max(pick("lat")).alias("north"), F.min(pick("lon")).alias("west"), F.max(pick("lon")).alias("east"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def layers(df: DataFrame, value: str, key: str = "layer") -> DataFrame:
    """The three normalisations of a heat layer. Extremes are aggregated and joined, as a few layers
    may hold all rows."""
    ends = df.groupBy(F.col(key).alias("__key")).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    x, low, high = F.col(value), F.col("__low"), F.col("__high")
    share = F.when(high > low, (x - low) / (high - low)).when(x.isNotNull(), 0.5)
    joined = df.join(ends, F.col(key).eqNullSafe(F.col("__key")))
    return joined.withColumns({"minmax": share, "inverse": 1 - share, "by_max": F.when(high > 0, x / high).otherwise(0.0)}).drop("__key", "__low", "__high")


def signal_kind(df: DataFrame, group: str, kind: str) -> DataFrame:
    """Groups whose markers are signals: any of them is a traffic light."""
    return df.groupBy(group).agg(F.bool_or(F.lower(kind) == "traffic light").alias("is_signal"), F.array_sort(F.collect_set(kind)).alias("kinds"))


def payload(**layer_frames: DataFrame) -> DataFrame:
    """One row with an array of structs for each layer; for layers of a bounded viewport."""
    out = None
    for name, df in layer_frames.items():
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
