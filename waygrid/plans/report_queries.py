"""Queries on detections, the map, reports, sequences, streams, and the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.functions import geo, scalar
from waygrid.operators import aggregates, blocks, mapdata, ranking, sequence
from waygrid.plans import sql as q
from waygrid.plans.match_queries import LEVELS, QUALITY, _tracks, _videos
from waygrid.plans.track_queries import features, out
from waygrid.sources import adapters, sinks
from waygrid.streaming import streams


def confident_detections(s, d):
    return out(adapters.detections(s, d).where((F.col("confidence") >= 0.05) & F.col("object_class").isin("view", "click")), "video_id", "det_idx", "object_class", "confidence")


def traffic_counts(s, d):
    return aggregates.traffic_counts(adapters.detections(s, d))


def object_summary(s, d):
    return out(aggregates.object_summary(adapters.detections(s, d)), "video_id", "object_class", "frames_seen", "motion", "last_x", "last_y")


def keyed_summary(s, d):
    return out(aggregates.keyed_summary(adapters.detections(s, d)), "video_id", "frame_second", "mean_x", "mean_y", "first_idx", "first_class", "max_confidence")


def object_motion(s, d):
    return out(aggregates.object_motion(adapters.detections(s, d)), "video_id", "object_class", "det_idx", "step_px", "px_bearing", "ref_speed")


def travel_direction(s, d):
    return out(aggregates.travel_direction(adapters.detections(s, d)), "video_id", "object_class", "dx", "dy", "direction")


def first_signal(s, d):
    """The first signal of each frame that the bearing gate lets pass, by hue."""
    det = adapters.detections(s, d)
    seen = geo.pixel_bearing((F.col("x1") + F.col("x2")) / 2, F.lit(500.0))
    ok = det.where(geo.angle_diff(F.lit(90.0), seen) <= 20)
    hue = F.pmod((F.col("confidence") * 200).cast("int"), F.lit(181))
    return ok.groupBy("video_id", "frame_second").agg(F.min_by(scalar.light_color(hue), "det_idx").alias("color"), F.min("det_idx").alias("det_idx"))


def box_distance(s, d):
    det = adapters.detections(s, d).where("y2 - y1 > 0")
    return out(det.withColumns({"m": geo.bbox_distance(F.col("y2") - F.col("y1"), F.lit(1024.0)), "side": geo.region_bearing(F.lit(100.0), F.when(F.col("det_idx") % 2 == 0, "left").otherwise("back"))}), "video_id", "det_idx", m=F.round("m", 1), side=True)


def speed_heat(s, d):
    t = features(s, d).withColumn("lat", F.round("lat", 3)).withColumn("lon", F.round("lon", 3))
    return out(mapdata.speed_heat(t), "lat", "lon", heat=True)


def signal_groups(s, d):
    t = adapters.numbered_events(s, d).select((F.lit(44.95) + F.floor(F.col("value") / 50) / 100000.0).alias("lat"), F.lit(-93.3).alias("lon"), F.upper("event_type").alias("status"))
    return out(mapdata.signal_groups(t), "lat5", "lon5", "status", "n", "percent")


def object_paths(s, d):
    t = adapters.detections(s, d).select(F.concat_ws("/", "video_id", "object_class").alias("object_id"), F.col("frame_second").alias("second"), "det_idx", F.col("x1").alias("x"), F.col("y1").alias("y"))
    p = mapdata.object_paths(t, 5, 12)
    return p.select("object_id", "points", F.array_join("order", " ").alias("way"), "start_x", "end_x")


def map_bounds(s, d):
    t = adapters.tracks(s, d).withColumn("lat", F.when(F.col("pt_idx") % 9 == 0, F.lit(0.0)).when(F.col("pt_idx") % 11 == 0, F.lit(120.0)).otherwise(F.col("lat")))
    return out(mapdata.bounds(t), "south", "north", "west", "east", "valid", "invalid")


def heat_layers(s, d):
    e = adapters.numbered_events(s, d).select("event_id", F.col("event_type").alias("layer"), "value")
    return out(mapdata.layers(e, "value"), "event_id", "minmax", "inverse", "by_max")


def signal_kinds(s, d):
    return mapdata.signal_kind(adapters.detections(s, d).withColumn("kind", F.when((F.col("object_class") == "error") & (F.col("confidence") > 0.95), "Traffic Light").otherwise(F.col("object_class"))), "video_id", "kind").select("video_id", "is_signal", F.size("kinds").alias("kinds"))


def audio_windows(s, d):
    e = adapters.numbered_events(s, d)
    x = e.select("uid", F.floor(F.col("n") * 0.5).cast("int").alias("second"), (F.col("value") / 500).alias("rms"), F.col("k"))
    g = x.groupBy("uid", "second").agg(F.avg("rms").alias("rms"), F.max(scalar.decibels(F.when(F.col("k") > 0, F.log10(F.col("k") / 100.0) * 20))).alias("db"))
    return out(g.withColumn("noise", scalar.noise_level(F.col("rms"))), "uid", "second", "rms", "db", "noise")


def scene_scores(s, d):
    e = adapters.numbered_events(s, d)
    v, k = F.col("value"), F.col("k")
    return out(e.select("event_id", scalar.scene_complexity(k / 100.0, v, v / 2).alias("complexity"), scalar.gaussian_weight(k.cast("double"), F.lit(100.0)).alias("row_weight"), scalar.latitude_weight(k.cast("double"), F.lit(100.0)).alias("lat_weight"), scalar.sigmoid(k / 100.0).alias("stretched")), "event_id", "complexity", "row_weight", "lat_weight", "stretched")


# ---- matches


def _matches(s, d):
    """Synthetic matches from orders: a customer's orders are a video's matches by price."""
    o = adapters.read(s, d, "orders")
    score = F.round(F.pmod(F.col("o_totalprice"), F.lit(1.0)) * 0.6 + F.col("o_orderkey") % 41 / 100.0, 4)
    m = o.select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").cast("string").alias("track_id"), score.alias("score"))
    m = m.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("score"), "track_id")))
    return m.withColumn("quality", scalar.quality_grade(F.col("score")))


def best_then_filter(s, d):
    return ranking.best_then_filter(_matches(s, d), 0.7, 4)


def filter_then_best(s, d):
    return ranking.filter_then_best(_matches(s, d).where("rank > 1"), 0.5, 2)


def top_above(s, d):
    return ranking.top_above(_matches(s, d))


def best_match(s, d):
    m = _matches(s, d)
    return ranking.best_match(m.withColumn("score", F.when(F.col("video_id") % 5 != 0, F.col("score"))))


def confidence_report(s, d):
    return ranking.confidence_report(_matches(s, d))


def score_report(s, d):
    return out(ranking.score_report(_matches(s, d)), "mean", "std", "low", "high", "median")


def run_summary(s, d):
    return out(ranking.run_summary(_matches(s, d)), "videos", "successful", "excellent", "good", "mean_positive", "median_positive", "success_rate")


def modulo_share(s, d):
    return ranking.share(adapters.read(s, d, "part").select("p_partkey", "p_name"), 1, 4, F.col("p_partkey")).select("p_partkey", "p_name")


def work_chunks(s, d):
    return ranking.chunks(adapters.read(s, d, "supplier").select("s_suppkey"), 16, F.col("s_suppkey")).groupBy("chunk").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))


def balanced_parts(s, d):
    return ranking.balanced(adapters.read(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 4, "p_partkey").groupBy("part").agg(F.count("*").alias("n"))


def progress_report(s, d):
    o = adapters.read(s, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending").alias("status"))
    return out(ranking.progress_summary(o, "o_orderpriority"), "o_orderpriority", "completed", "failed", "total", "remaining", "completion_rate", "success_rate")


def latest_status(s, d):
    o = adapters.read(s, d, "orders").select("o_custkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("at"))
    x = o.select("o_custkey", "o_orderstatus", (F.unix_micros(F.col("at.o_orderdate").cast("timestamp")) * 1 + F.col("at.o_orderkey")).alias("processed_at"))
    return sinks.latest(x, ["o_custkey"])


def replaced_lists(s, d):
    o = adapters.read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return out(sinks.replaced(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 7 = 1"), "o_custkey"), "o_custkey", "o_orderkey", "o_totalprice")


def video_types(s, d):
    p = adapters.read(s, d, "part").select("p_partkey", "p_name", (F.col("p_size") * 100).cast("double").alias("w"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 50).otherwise(F.col("p_size") * 75).cast("double").alias("h"), F.element_at(F.array(*map(F.lit, ("h264", "hevc", "mpeg4", "wmv"))), F.col("p_partkey").cast("int") % 4 + 1).alias("codec"))
    t = scalar.video_type(F.col("w"), F.col("h"), F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, "_360").otherwise("")))
    g = scalar.codec_grade(F.col("codec"), F.col("w"), F.col("h"), F.lit("yuv420p"))
    return out(p.withColumns({"kind": t["type"], "confidence": t["confidence"], "panorama": scalar.is_360(F.col("w"), F.col("h")), "grade": g, "admitted": scalar.admitted(g, F.col("w"), F.col("h")), "weight": scalar.work_weight(F.col("p_partkey") * 5e6, F.col("w"), F.col("h"))}), "p_partkey", "kind", "panorama", "grade", "admitted", "confidence", "weight")


def text_functions(s, d):
    p = adapters.read(s, d, "part")
    path = F.concat(F.lit("/data/in put/"), "p_name", F.lit(".v1.mp4"))
    return p.select("p_partkey", scalar.stem(path).alias("stem"), scalar.basename(path).alias("base"), scalar.safe_filename(F.col("p_name")).alias("safe"), scalar.clean_label(F.col("p_brand"), 3, 7).alias("label"), scalar.number_or(F.substring("p_brand", 7, 9), -1, "int").alias("number"), scalar.class_color(F.when(F.col("p_size") > 25, "Car").otherwise(F.col("p_name"))).alias("color"), scalar.quality_level(F.lit("good")).alias("level"), F.unix_micros(scalar.camera_time(F.format_string("VID_202401%02d_1000%02d_00_001.mp4", F.col("p_partkey") % 28 + 1, F.col("p_partkey") % 60))).alias("camera_us"))


# ---- sequences


def sequence_scores(s, d):
    return blocks.expanded(out(sequence.pair_scores(_videos(s, d), _tracks(s, d, y="speed_mph"), "x", "y", merge=blocks.MERGE), "video_ids", "track_ids", "lag", "dtw", "fft", "phase", "lag_score", "combined"))


def sequence_offsets(s, d):
    return blocks.expanded(out(sequence.pair_offsets(_videos(s, d), _tracks(s, d, y="speed_mph"), "x", "y", merge=blocks.MERGE), "video_ids", "track_ids", "dtw_offset", "score", "offset", "height", "scaled_offset", "scaled_height"))


def offset_search(s, d):
    """The time offset between each recording and its own track, moved by three seconds."""
    m = adapters.motion(s, d).withColumn("t", F.col("idx").cast("double"))
    a = sequence.series(m, "video_id", "idx", vt="t", v="motion_magnitude")
    b = sequence.series(m.withColumn("t", F.col("t") - 3), "video_id", "idx", gt="t", g="motion_magnitude")
    return out(sequence.offsets(a.join(b, "video_id"), ["video_id"]), "video_id", "offset_method", "sync_quality", "temporal_offset_seconds", "offset_confidence")


def spectra(s, d):
    x = sequence.series(features(s, d), "track_id", "pt_idx", x="speed_mph")
    r = sequence.spectra(x, ["track_id"], "x")
    return out(r.select("track_id", "rhythm", F.col("peaks")[0].alias("peak"), F.size("smooth").alias("n"), F.col("smooth")[5].alias("smooth5")), "track_id", "n", "rhythm", "peak", "smooth5")


# ---- streams


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(s, d):
    return streams.arriving(s, f"{d.rstrip('/')}", EVENTS, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_minutes(s, d):
    """Counts by hour and kind from a stream of files, all windows that the watermark closed or not."""
    w = streams.tumbling(_stream(s, d), "1 hour", "event_type")
    t = _complete(w, s)
    return t.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", (F.round("total", 4) + 0.0).alias("total"))


def stream_sessions(s, d):
    t = _complete(streams.stops(_stream(s, d), "user_id", "6 hours"), s)
    return t.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def _complete(df, s):
    """The stream's final state: each batch's windows replace what they were."""
    at = streams.work_dir(s)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/out")

    q = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(df.schema).parquet(f"{at}/out")


def tracked_objects(s, d):
    det = adapters.detections(s, d).select("video_id", F.col("det_idx").cast("long").alias("frame"), "object_class", F.col("x1").alias("x"), F.col("y1").alias("y"))
    t = streams.tracked_table(det)
    return out(t, "video_id", "frame", "object_class", "object_id", "moved")


# ---- star tables (extensions)


def pricing_summary(s, d):
    li = adapters.read(s, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))
    return out(g, "l_returnflag", "l_linestatus", "n", sum_qty=True, revenue=F.round("revenue", 2), avg_disc=True)


def region_revenue(s, d):
    r = lambda n: adapters.read(s, d, n)
    j = r("lineitem").join(r("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(r("customer"), F.col("o_custkey") == F.col("c_custkey")).join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(r("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = j.rollup("r_name", "n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))
    return out(g, "r_name", "n_name", "orders", revenue=F.round("revenue", 2))


QUERIES = [
    confident_detections, traffic_counts, object_summary, keyed_summary, object_motion, travel_direction, first_signal, box_distance, speed_heat, signal_groups, object_paths, map_bounds, heat_layers, signal_kinds,
    audio_windows, scene_scores, best_then_filter, filter_then_best, top_above, best_match, confidence_report, score_report, run_summary, modulo_share, work_chunks, balanced_parts, progress_report, latest_status,
    replaced_lists, video_types, text_functions, sequence_scores, sequence_offsets, offset_search, spectra, stream_minutes, stream_sessions, tracked_objects, pricing_summary, region_revenue,
]

DW = "(PARTITION BY video_id, object_class ORDER BY det_idx)"
MATCH = f"""m0 AS (SELECT o_custkey AS video_id, CAST(o_orderkey AS VARCHAR) AS track_id, round((o_totalprice % 1.0) * 0.6 + (o_orderkey % 41) / 100.0::DOUBLE, 4) AS score FROM orders),
m AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, track_id) AS rank, {QUALITY.format('score')} AS quality FROM m0)"""
LEVEL = f"(list_position({LEVELS}, quality) - 1)"
EVN = "ev AS (SELECT *, CAST(user_id AS VARCHAR) AS uid, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"
NAME360 = "CASE WHEN p_partkey % 5 = 0 THEN p_name || '_360' ELSE p_name END"
OK = "(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND lat <> 0 AND lon <> 0)"

SQL = {
    "confident_detections": f"WITH {q.DET} SELECT video_id, det_idx, object_class, {q.cols('confidence')} FROM det WHERE confidence >= 0.05 AND object_class IN ('view', 'click')",
    "traffic_counts": f"WITH {q.DET} SELECT video_id, object_class, count(*) AS total_count FROM det GROUP BY 1, 2",
    "object_summary": f"""WITH {q.DET}, c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM det), s AS (SELECT *, sqrt(pow(cx - {q.lag('cx', DW)}, 2) + pow(cy - {q.lag('cy', DW)}, 2)) AS st FROM c)
      SELECT video_id, object_class, count(*) AS frames_seen, CASE WHEN avg(st) > 20 THEN 'moving' ELSE 'idle' END AS motion, {q.rounded(last_x='arg_max(cx, det_idx)', last_y='arg_max(cy, det_idx)')} FROM s GROUP BY 1, 2""",
    "keyed_summary": f"WITH {q.DET} SELECT video_id, frame_second, {q.rounded(mean_x='avg((x1 + x2) / 2)', mean_y='avg((y1 + y2) / 2)', max_confidence='max(confidence)')}, min(det_idx) AS first_idx, arg_min(object_class, det_idx) AS first_class FROM det GROUP BY 1, 2",
    "object_motion": f"""WITH {q.DET}, c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM det), s AS (SELECT *, cx - {q.lag('cx', DW)} AS dx, cy - {q.lag('cy', DW)} AS dy FROM c)
      SELECT video_id, object_class, det_idx, {q.rounded(step_px='coalesce(sqrt(pow(dx, 2) + pow(dy, 2)), 0.0)', px_bearing='coalesce(' + q.pmod('degrees(atan2(dx, -dy)) + 360') + ', 0.0)', ref_speed='coalesce(sqrt(pow(dx, 2) + pow(dy, 2)) / 100, 0.0)')} FROM s""",
    "travel_direction": f"""WITH {q.DET}, g AS (SELECT video_id, object_class, arg_max((x1 + x2) / 2, det_idx) - arg_min((x1 + x2) / 2, det_idx) AS dx, arg_max((y1 + y2) / 2, det_idx) - arg_min((y1 + y2) / 2, det_idx) AS dy FROM det GROUP BY 1, 2)
      SELECT video_id, object_class, {q.cols('dx', 'dy')}, CASE WHEN dx = 0 AND dy = 0 THEN 'still' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx > 0 THEN 'right' ELSE 'left' END WHEN dy > 0 THEN 'toward' ELSE 'away' END AS direction FROM g""",
    "first_signal": f"""WITH {q.DET}, a AS (SELECT *, {q.pmod('(x1 + x2) / 2 / 500.0 * 360')} AS seen, CAST(trunc(confidence * 200) AS INTEGER) % 181 AS hue FROM det), b AS (SELECT *, CASE WHEN hue BETWEEN 0 AND 10 OR hue BETWEEN 160 AND 180 THEN 'red' WHEN hue BETWEEN 15 AND 35 THEN 'yellow' WHEN hue BETWEEN 36 AND 89 THEN 'green' ELSE 'unknown' END AS color FROM a WHERE {q.angle_diff('90.0', 'seen')} <= 20)
      SELECT video_id, frame_second, arg_min(color, det_idx) AS color, min(det_idx) AS det_idx FROM b GROUP BY 1, 2""",
    "box_distance": f"WITH {q.DET} SELECT video_id, det_idx, {q.r('round_even(1.7 / ((y2 - y1) / 1024.0), 2)', 1)} AS m, CASE WHEN det_idx % 2 = 0 THEN 10.0 ELSE 280.0 END::DOUBLE AS side FROM det WHERE y2 - y1 > 0",
    "speed_heat": f"WITH {q.FEATURES} SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, {q.rounded(heat='avg(speed_mph) / 50')} FROM f GROUP BY 1, 2",
    "signal_groups": f"""WITH a AS (SELECT round(44.95 + floor(value / 50) / 100000.0, 5) AS lat5, -93.3::DOUBLE AS lon5, lower(event_type) AS status, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT {q.r('lat5')} AS lat5, lon5, status, n, {q.rounded(percent='n * 100.0 / sum(n) OVER (PARTITION BY lat5, lon5)')} FROM a""",
    "object_paths": f"WITH {q.DET} SELECT video_id || '/' || object_class AS object_id, count(*) AS points, string_agg(frame_second || ':' || det_idx, ' ' ORDER BY frame_second, det_idx) AS way, arg_min(x1, frame_second * 100000 + det_idx) AS start_x, arg_max(x1, frame_second * 100000 + det_idx) AS end_x FROM det WHERE frame_second BETWEEN 5 AND 12 GROUP BY 1",
    "map_bounds": f"WITH {q.TRACK}, a AS (SELECT CASE WHEN pt_idx % 9 = 0 THEN 0.0 WHEN pt_idx % 11 = 0 THEN 120.0 ELSE lat END AS lat, lon FROM pt) SELECT {q.rounded(south=f'min(lat) FILTER {OK}', north=f'max(lat) FILTER {OK}', west=f'min(lon) FILTER {OK}', east=f'max(lon) FILTER {OK}')}, count(*) FILTER {OK} AS valid, count(*) FILTER (NOT {OK}) AS invalid FROM a",
    "heat_layers": f"SELECT event_id, {q.rounded(minmax='(value - min(value) OVER t) / (max(value) OVER t - min(value) OVER t)', inverse='1 - (value - min(value) OVER t) / (max(value) OVER t - min(value) OVER t)', by_max='value / max(value) OVER t')} FROM events WINDOW t AS (PARTITION BY event_type)",
    "signal_kinds": f"WITH {q.DET}, a AS (SELECT video_id, CASE WHEN object_class = 'error' AND confidence > 0.95 THEN 'Traffic Light' ELSE object_class END AS kind FROM det) SELECT video_id, bool_or(lower(kind) = 'traffic light') AS is_signal, CAST(count(DISTINCT kind) AS INTEGER) AS kinds FROM a GROUP BY 1",
    "audio_windows": f"WITH {EVN} SELECT uid, CAST(floor(n * 0.5) AS INTEGER) AS second, {q.rounded(rms='avg(value / 500)', db='max(CASE WHEN k > 0 THEN round(log10(k / 100.0::DOUBLE) * 20, 2) ELSE -100.0 END)', noise='avg(value / 500) * 100')} FROM ev GROUP BY 1, 2",
    "scene_scores": f"WITH {EVN} SELECT event_id, {q.rounded(complexity='(k / 100.0 + value / 10000 + value / 2 / 100) / 3', row_weight='exp(-pow((k - 50.0) / 25.0, 2) / 2)', lat_weight='cos((k / 100.0 - 0.5) * 3.141592653589793)', stretched='1 / (1 + exp(-10.0 * (k / 100.0 - 0.5)))')} FROM ev",
    "best_then_filter": f"WITH {MATCH} SELECT * FROM m WHERE rank = 1 AND score >= 0.7 AND {LEVEL} >= 4",
    "filter_then_best": f"WITH {MATCH} SELECT * FROM m WHERE rank > 1 AND score >= 0.5 AND {LEVEL} >= 2 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY rank) = 1",
    "top_above": f"WITH {MATCH} SELECT * FROM m WHERE rank <= 10 AND score >= 0.3",
    "best_match": f"WITH {MATCH}, a AS (SELECT video_id, track_id, rank, quality, CASE WHEN video_id % 5 <> 0 THEN score END AS score FROM m) SELECT video_id, coalesce(max(CASE WHEN rank = 1 AND score IS NOT NULL THEN track_id END), 'NO_GOOD_MATCH') AS best_track, max(score) AS score, max(CASE WHEN rank = 1 AND score IS NOT NULL THEN quality END) AS quality FROM a GROUP BY 1",
    "confidence_report": f"WITH {MATCH} SELECT CASE WHEN score > 0.6 THEN 'excellent' WHEN score > 0.4 THEN 'high' WHEN score > 0.25 THEN 'medium' WHEN score > 0.15 THEN 'low' ELSE 'very_low' END AS band, count(*) AS videos FROM m WHERE rank = 1 GROUP BY 1",
    "score_report": f"WITH {MATCH} SELECT {q.rounded(mean='avg(score)', std='stddev_pop(score)', low='min(score)', high='max(score)', median='median(score)')} FROM m WHERE rank = 1",
    "run_summary": f"WITH {MATCH} SELECT count(*) AS videos, count(*) FILTER (score > 0.1) AS successful, count(*) FILTER (quality = 'excellent') AS excellent, count(*) FILTER (quality IN ('good', 'very_good')) AS good, {q.rounded(mean_positive='avg(score) FILTER (score > 0)', median_positive='median(score) FILTER (score > 0)', success_rate='count(*) FILTER (score > 0.1) / count(*)')} FROM m WHERE rank = 1",
    "modulo_share": "SELECT p_partkey, p_name FROM part QUALIFY (row_number() OVER (ORDER BY p_partkey) - 1) % 4 = 1",
    "work_chunks": "WITH a AS (SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // 16 AS chunk FROM supplier) SELECT chunk, count(*) AS n, min(s_suppkey) AS first FROM a GROUP BY 1",
    "balanced_parts": "WITH a AS (SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS n FROM part) SELECT CASE WHEN (n // 4) % 2 = 0 THEN n % 4 ELSE 3 - n % 4 END AS part, count(*) AS n FROM a GROUP BY 1",
    "progress_report": f"WITH a AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) AS total FROM orders GROUP BY 1) SELECT o_orderpriority, completed, failed, total, total - completed AS remaining, {q.rounded(completion_rate='completed / total', success_rate='completed * 100 / greatest(completed + failed, 1)')} FROM a",
    "latest_status": "SELECT o_custkey, o_orderstatus, epoch_us(o_orderdate) + o_orderkey AS processed_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) + o_orderkey DESC) = 1",
    "replaced_lists": f"SELECT o_custkey, o_orderkey, {q.cols('o_totalprice')} FROM orders o WHERE o_orderkey % 7 = 1 OR (o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderkey % 7 = 1 AND n.o_custkey = o.o_custkey))" .replace("OR (o_orderkey % 2", "OR (o_orderkey % 2"),
    "text_functions": """SELECT p_partkey, p_name || '.v1' AS stem, p_name || '.v1.mp4' AS base, regexp_replace(p_name, '[^A-Za-z0-9_.-]', '_', 'g') AS safe, CASE WHEN length(regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g')) BETWEEN 3 AND 7 THEN regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') END AS label,
      coalesce(TRY_CAST(substr(p_brand, 7, 9) AS INTEGER), -1) AS number, CASE WHEN p_size > 25 THEN '#FF0000' ELSE '#808080' END AS color, 3 AS level, epoch_us(make_timestamp(2024, 1, p_partkey % 28 + 1, 10, 0, p_partkey % 60)) AS camera_us FROM part""",
    "video_types": f"""WITH a AS (SELECT p_partkey, {NAME360} AS name, p_size * 100.0::DOUBLE AS w, CASE WHEN p_partkey % 3 = 0 THEN p_size * 50.0 ELSE p_size * 75.0 END::DOUBLE AS h, ['h264', 'hevc', 'mpeg4', 'wmv'][p_partkey % 4 + 1] AS codec FROM part),
      b AS (SELECT *, w / h BETWEEN 1.8 AND 2.2 AS pano, regexp_matches(name, '360|vr|spherical|equirect|panoramic|insta360|theta|ricoh') AS k3, regexp_matches(name, 'flat|standard|normal|regular') AS kf, w >= 3840 AND h >= 1920 AS big FROM a),
      c1 AS (SELECT *, CASE WHEN pano OR k3 THEN '360' ELSE 'flat' END AS t1, CASE WHEN pano THEN CASE WHEN k3 THEN least(0.95, 0.8 + 0.15) ELSE 0.8 END WHEN k3 THEN 0.6 ELSE 0.0 END AS f1 FROM b),
      c2 AS (SELECT *, CASE WHEN kf THEN 'flat' ELSE t1 END AS t2, CASE WHEN kf THEN CASE WHEN t1 = 'flat' THEN least(0.95, f1 + 0.15) ELSE 0.6 END ELSE f1 END AS f2 FROM c1),
      c3 AS (SELECT *, CASE WHEN big THEN '360' ELSE t2 END AS kind, CASE WHEN big THEN CASE WHEN t2 = '360' THEN least(0.95, f2 + 0.1) ELSE 0.5 END ELSE f2 END AS confidence,
        CASE WHEN codec IN ('h264', 'mpeg4') THEN CASE WHEN w <= 1920 AND h <= 1080 THEN 'excellent' WHEN w <= 3840 AND h <= 2160 THEN 'good' ELSE 'fair' END WHEN codec = 'hevc' THEN CASE WHEN w <= 1920 AND h <= 1080 THEN 'fair' ELSE 'poor' END ELSE 'unknown' END AS grade,
        least(CASE WHEN p_partkey * 5e6 / 1048576 > 1000 THEN 3.0 WHEN p_partkey * 5e6 / 1048576 > 500 THEN 2.0 WHEN p_partkey * 5e6 / 1048576 > 100 THEN 1.5 ELSE 1.0 END * CASE WHEN w / h >= 1.8 THEN 1.8 ELSE 1.0 END * CASE WHEN w * h > 8000000 THEN 1.5 WHEN w * h > 2000000 THEN 1.2 ELSE 1.0 END, 5.0) AS weight FROM c2)
      SELECT p_partkey, kind, pano AS panorama, grade, grade NOT IN ('poor', 'incompatible', 'unknown') AND w <= 3840 AND h <= 2160 AS admitted, {q.rounded(confidence='confidence', weight='weight')} FROM c3""",
    "stream_minutes": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM a), c AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY 1, 2)
      SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, count(*) AS n, {q.rounded(sum_qty='sum(l_quantity)', avg_disc='avg(l_discount)')}, {q.r('sum(l_extendedprice * (1 - l_discount))', 2)} AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "region_revenue": f"SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, {q.r('sum(l_extendedprice * (1 - l_discount))', 2)} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
}
