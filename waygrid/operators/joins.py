"""Joins that the domain needs beside the plain ones.

Small sides are broadcast by Spark itself where their measured size allows; nothing here forces it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def per_second(gps: DataFrame, key: str = "video_id", order: str = "ord", first: bool = False) -> DataFrame:
    """One position a second: the last row of it, or the first."""
    pick = F.min_by if first else F.max_by
    rest = [c for c in gps.columns if c not in (key, "second", order)]
    return gps.groupBy(key, "second").agg(pick(F.struct(*rest), order).alias("p")).select(key, "second", "p.*")


def with_positions(frames: DataFrame, gps: DataFrame, key: str = "video_id", inner: bool = False, first: bool = False) -> DataFrame:
    """Frames or detections with the position of their second; NULL where there is none (inner: those go)."""
    seconds = per_second(gps, key, first=first)
    return frames.join(seconds, [key, "second"], "inner" if inner else "left")


def position_or_zero(df: DataFrame) -> DataFrame:
    """For writers whose readers expect 0 for a missing position."""
    return df.withColumns({"lat": F.coalesce("lat", F.lit(0.0)), "lon": F.coalesce("lon", F.lit(0.0))})


def shifted(series: DataFrame, track: DataFrame, shift: int, keys: list[str], second: str = "second", point: str = "pt_idx") -> DataFrame:
    """Second s of the series meets point s + shift of the track; what falls outside goes."""
    return series.withColumn(point, F.col(second) + shift).join(track, [*keys, point])


def _first_within(left: np.ndarray, right: np.ndarray, order: np.ndarray, tolerance: float) -> np.ndarray:
    """Of each left point (lat, lon) the place of the right point within the tolerance in both
    coordinates whose order is least, or -1. Right points lie in cells just wider than the
    tolerance, by order; a left point follows its own cell and the eight around it, each until the
    first hit or an order beyond its best."""
    by = np.argsort(order, kind="stable")
    low = np.minimum(left.min(0), right.min(0))
    cells = [np.floor((x - low) / (1.001 * tolerance)).astype(np.int64) + 1 for x in (left, right[by])]
    wide = max(c[:, 1].max() for c in cells) + 2
    at = [c[:, 0] * wide + c[:, 1] for c in cells]
    by_cell = np.argsort(at[1], kind="stable")
    by, keys = by[by_cell], at[1][by_cell]
    points, ranks = right[by], order[by]
    found = np.full(len(left), -1)
    for step in (0, -1, 1, -wide, wide, -wide - 1, -wide + 1, wide - 1, wide + 1):
        place, end = (np.searchsorted(keys, at[0] + step, side) for side in ("left", "right"))
        live = np.flatnonzero(place < end)
        while len(live):
            c = place[live]
            better = (found[live] < 0) | (ranks[c] < ranks[found[live]])
            live, c = live[better], c[better]
            hit = (np.abs(left[live] - points[c]) <= tolerance).all(1)
            found[live[hit]] = c[hit]
            live = live[~hit]
            place[live] += 1
            live = live[place[live] < end[live]]
    return np.where(found < 0, -1, by[found])


def band(left: DataFrame, right: DataFrame, tolerance: float = 1e-4, order: str = "ord", key: str = "row_id") -> DataFrame:
    """Each left row with the first right row within the tolerance in both coordinates, or NULL.

    Rows of one place are one: of right rows the first counts, and left rows share what their place
    has found. Places meet in tiles of eight tolerances, right ones also in the tiles that they
    reach into; no pair of places becomes a row."""
    size = 8 * tolerance
    tile = lambda x: F.floor(x / F.lit(size)).cast("long")
    reach = lambda x: F.explode(F.sequence(tile(F.col(x) - 1.01 * tolerance), tile(F.col(x) + 1.01 * tolerance)))
    known = lambda d: d.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("lat", "lon")))
    rest = [c for c in right.columns if c not in ("lat", "lon", order)]
    r = known(right).groupBy("lat", "lon").agg(F.min_by(F.struct(order, *rest), order).alias("r")).select("lat", "lon", f"r.{order}", F.struct(*[F.col(f"r.{c}") for c in rest]).alias("r"))
    r = r.withColumn("cx", reach("lat")).withColumn("cy", reach("lon"))
    places = known(left).select("lat", "lon").distinct().withColumns({"cx": tile(F.col("lat")), "cy": tile(F.col("lon"))})

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        numbers = lambda t: np.stack([t[c].to_numpy() for c in ("lat", "lon")], 1).astype(float)
        found = _first_within(numbers(a), numbers(b), b[order].to_numpy(), tolerance) if a.num_rows and b.num_rows else np.full(a.num_rows, -1)
        a, r = a.filter(pa.array(found >= 0)), b["r"].take(pa.array(found[found >= 0]))
        return pa.table([a["lat"], a["lon"], r], ["lat", "lon", "r"])

    kinds = dict(left.dtypes) | {"r": dict(r.dtypes)["r"]}
    first = places.groupBy("cx", "cy").cogroup(r.groupBy("cx", "cy")).applyInArrow(meet, ", ".join(f"{c} {kinds[c]}" for c in ("lat", "lon", "r")))
    return left.join(first, ["lat", "lon"], "left").select(*left.columns, "r.*")


def neighbours(points: DataFrame, size: float, key: str = "row_id") -> DataFrame:
    """How many other points stand in a point's cell and the eight around it. Cells are counted
    first, so that a crowded cell is one row."""
    at = points.withColumns({"cx": F.floor(F.col("lat") / size).cast("long"), "cy": F.floor(F.col("lon") / size).cast("long")})
    count = at.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = count.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    total = spread.groupBy((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy")).agg(F.sum("n").alias("around"))
    return at.join(total, ["cx", "cy"]).select(key, (F.col("around") - 1).alias("neighbours"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the latest value of right at or before its time: one union and one window."""
    both = left.select(key, time, F.lit(None).cast(dict(right.dtypes)[value]).alias("v"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"))
    both = both.unionByName(right.select(key, time, F.col(value).alias("v"), F.lit(0).alias("side"), F.lit(None).cast(both.schema["row"].dataType).alias("row")))
    w = W.partitionBy(key).orderBy(time, "side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1").select("row.*", F.col("v").alias(f"{value}_asof"))


def interpolated(samples: DataFrame, grid: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """key, time, value of the samples' straight lines at the grid's times; the ends' values beyond them."""
    both = samples.select(key, time, F.col(value).alias("v"), F.lit(0).alias("side")).unionByName(grid.select(key, time, F.lit(None).cast("double").alias("v"), F.lit(1).alias("side")))
    order = W.partitionBy(key).orderBy(time, "side")
    point = F.when(F.col("v").isNotNull(), F.struct(F.col(time).alias("t"), "v"))
    back, ahead = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    d = both.withColumns({"a": F.last(point, ignorenulls=True).over(back), "b": F.first(point, ignorenulls=True).over(ahead)}).where("side = 1")
    a, b, t = F.col("a"), F.col("b"), F.col(time)
    line = a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / (b["t"] - a["t"])
    return d.select(key, time, F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).when(b["t"] == a["t"], a["v"]).otherwise(line).alias(value))


def second_grid(df: DataFrame, key: str, second: str = "second") -> DataFrame:
    """Every second from 0 to each key's last."""
    return df.groupBy(key).agg(F.max(second).alias("n")).select(key, F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias(second))


def filled_seconds(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Rows for all seconds: straight lines between, the first and last value beyond."""
    grid = second_grid(df, key).withColumn("second", F.col("second").cast("double"))
    out = grid
    for v in values:
        out = out.join(interpolated(df.withColumn("second", F.col("second").cast("double")), grid, key, "second", v), [key, "second"])
    return out


def nearest_event(events: DataFrame, others: DataFrame, key: str, time: str = "t", first: int = 5, within: float = 30.0) -> DataFrame:
    """For the first few events of each key the time to the nearest of the others, and the share
    within the limit. Both sides pass one window, so no pairs are made."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(time))
    e = events.withColumn("rank", rank).where(F.col("rank") <= first)
    both = e.select(key, time, F.lit(1).alias("side")).unionByName(others.select(key, time, F.lit(0).alias("side")))
    o = F.when(F.col("side") == 0, F.col(time))
    w = W.partitionBy(key).orderBy(time, "side")
    before, after = F.last(o, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(o, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    d = both.withColumn("gap", F.least(F.col(time) - before, after - F.col(time))).where("side = 1")
    return d.groupBy(key).agg(F.count("*").alias("events"), F.avg("gap").alias("mean_gap"), (F.count_if(F.col("gap") < within) / F.count("*")).alias("aligned_share"))


def kept_or(original: DataFrame, processed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """original with the processed values where there are any: joined by key, never by position."""
    p = processed.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    rest = [c for c in original.columns if c not in columns]
    return original.join(p, keys, "left").select(*rest, *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in columns])


def prefixed(df: DataFrame, dim: DataFrame, key: str, prefix: str = "match_") -> DataFrame:
    return df.join(dim.select(key, *[F.col(c).alias(prefix + c) for c in dim.columns if c != key]), key, "left")


def only_known(df: DataFrame, known: DataFrame, key) -> DataFrame:
    return df.join(known, key, "left_semi")


def remaining(tasks: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Tasks that aren't completed; failed ones come again."""
    return tasks.join(progress.where("status = 'completed'").select(key), key, "left_anti")
