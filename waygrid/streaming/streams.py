"""Streams: new files as they arrive, windows over event time, state per object.

A checkpoint folder makes every query restartable; sinks are idempotent by key or by Spark's own
file log. `available_now` runs what is there and stops, which is the nightly batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waygrid.sources.sinks import upserted


def work_dir(spark: SparkSession) -> str:
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        import tempfile

        place = tempfile.mkdtemp(prefix="waygrid-stream-")
    return f"{place.rstrip('/')}/stream-{uuid.uuid4().hex}"


def arriving(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 1000, oldest_first: bool = True, pattern: str | None = None) -> DataFrame:
    """Rows of files that appear below a folder, oldest first. (A priority lane is a second stream.)"""
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", not oldest_first)
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path)


def tumbling(df: DataFrame, size: str, *keys: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Count and sum of value in fixed windows; rows later than `late` don't count any more."""
    return df.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def half_seconds(df: DataFrame, time: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Audio windows of half a second."""
    return tumbling(df, "500 milliseconds", time=time, late=late)


def stops(df: DataFrame, key: str, gap: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Episodes: rows of a key with no gap longer than `gap` between them."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


TRACK = "video_id string, frame long, object_class string, object_id long, moved double"
STATE = "next long, ids array<long>, kinds array<string>, xs array<double>, ys array<double>, seen array<long>"


def _tracked(reach: float, keep: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, live = 0, []  # live: [id, class, x, y, frame]
        if state.exists:
            nxt, *lists = state.get
            live = [list(x) for x in zip(*lists)]
        rows: list[tuple[Any, ...]] = []
        data = pd.concat(list(batches)).sort_values(["frame", "x", "y"])
        for frame, group in data.groupby("frame"):
            live = [p for p in live if frame - p[4] <= keep]
            free = {p[0] for p in live}
            for kind, x, y in zip(group["object_class"], group["x"], group["y"]):
                near = [(((p[2] - x) ** 2 + (p[3] - y) ** 2) ** 0.5, p[0], p) for p in live if p[1] == kind and p[0] in free]
                d, i, p = min(near, default=(None, None, None))
                if d is not None and d <= reach:
                    free.discard(i)
                    p[2:] = [x, y, frame]
                else:
                    i, d, nxt = nxt, 0.0, nxt + 1
                    live.append([i, kind, x, y, frame])
                rows.append((key[0], int(frame), kind, int(i), float(d)))
        state.update((nxt, *[[p[k] for p in live] for k in range(5)]))
        yield pd.DataFrame(rows, columns=["video_id", "frame", "object_class", "object_id", "moved"])

    return step


def tracked(df: DataFrame, reach: float = 100.0, keep: int = 30) -> DataFrame:
    """Numbers the objects of each video: a detection (video_id, frame, object_class, x, y) goes to
    the nearest free object of its class within `reach` pixels, or becomes a new one. State per
    video: the objects seen within `keep` frames. Works on streams and, run once, on tables."""
    return df.groupBy("video_id").applyInPandasWithState(_tracked(reach, keep), TRACK, STATE, "append", GroupStateTimeout.NoTimeout)


def tracked_table(df: DataFrame, reach: float = 100.0, keep: int = 30) -> DataFrame:
    """The same over a table. One task holds one video's detections."""

    class Once:
        exists = False

        def update(self, _):
            pass

    def run(key, pdf):
        return next(_tracked(reach, keep)(key, iter([pdf]), Once()))

    return df.groupBy("video_id").applyInPandas(run, TRACK)


def upsert_sink(spark: SparkSession, path: str, keys: list[str], order: str = "processed_at"):
    """foreachBatch writer: the table at path holds the latest row of each key. Each batch writes a
    new version beside the old one, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        new, old = f"{path}/v{number}", f"{path}/v{number - 1}"
        merged = upserted(spark.read.parquet(old), batch, keys, order) if number else upserted(batch.limit(0), batch, keys, order)
        merged.write.mode("overwrite").parquet(new)

    return write


def available_now(df: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives its output as a table."""
    at = work_dir(spark)
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def run_batches(df: DataFrame, writer, checkpoint: str) -> None:
    q = df.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
