"""Queries on pairs of series: matching, ranking, joins and alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.config import ENSEMBLE_BASIC
from waygrid.functions import scalar
from waygrid.operators import blocks, joins, similarity, track
from waygrid.plans import sql as q
from waygrid.plans.track_queries import features, out
from waygrid.sources import adapters


def _series(df, key: str, idx: str, span, **values) -> DataFrame:
    """key, its span in seconds, and an array a value, in the order of idx."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), *[F.col(v).cast("double").alias(n) for n, v in values.items()])))
    return df.groupBy(key).agg(span, rows.alias("r")).select(key, span_name(key), *[F.col("r")[n].alias(n) for n in values])


def span_name(key: str) -> str:
    return "video_s" if key == "video_id" else "track_s"


def _videos(s, d) -> DataFrame:
    """video_id, video_s, x: the motion series."""
    return _series(adapters.motion(s, d), "video_id", "idx", F.max("t").alias("video_s"), x="motion_magnitude")


def _tracks(s, d, **values) -> DataFrame:
    """track_id, track_s and arrays of features."""
    return _series(features(s, d), "track_id", "pt_idx", (F.max("epoch_s") - F.min("epoch_s")).alias("track_s"), **values)


def _spans(s, d) -> tuple[DataFrame, DataFrame]:
    m, t = adapters.motion(s, d), adapters.tracks(s, d)
    return m.groupBy("video_id").agg(F.max("t").alias("video_s")), t.groupBy("track_id").agg((F.max("epoch_s") - F.min("epoch_s")).alias("track_s"))


def match_top3(s, d):
    """The best three tracks of each recording by motion against speed, graded."""

    def score(a, b, fits):
        r, _ = blocks.correlation(blocks.matrix(a["x"]), blocks.matrix(b["speed"]))
        return blocks.picked(blocks.best(r, fits, 3), r)

    r = blocks.scored(_videos(s, d), _tracks(s, d, speed="speed_mph"), "score double", score).withColumn("score", F.round("score", 6) + 0.0)
    best = track.top_k(r, "video_id", 3, F.desc("score"), F.col("track_id"))
    return best.select("video_id", "track_id", "rank", "score", scalar.quality_grade(F.col("score")).alias("quality"))


def duration_pairs(s, d):
    def score(a, b, fits):
        v, t = a["video_s"].to_numpy()[:, None], b["track_s"].to_numpy()[None, :]
        return blocks.picked(fits, *np.broadcast_arrays(v, t))

    p = blocks.scored(*_spans(s, d), "video_s double, track_s double", score, merge=blocks.MERGE)
    ratio = scalar.duration_ratio(F.col("track_s"), F.col("video_s"))
    p = p.select("video_ids", "track_ids", ratio.alias("ratio"), scalar.temporal_quality(ratio).alias("quality"), scalar.duration_score(ratio).alias("duration_score"))
    hundredths = lambda factor: lambda x: F.pmod(x.cast("int") * factor, F.lit(100))
    p = blocks.parted(p, video_ids=hundredths(13), track_ids=hundredths(7))
    p = p.withColumn("base", F.pmod(F.col("track_ids_at") + F.col("video_ids_at"), F.lit(100)) / 100.0)
    p = p.withColumn("score", scalar.duration_weighted(F.col("base"), F.col("ratio"), F.col("quality")))
    p = p.withColumn("grade", scalar.duration_grade(F.col("score"), F.col("quality"), F.col("ratio")))
    return blocks.expanded(out(p, "video_ids", "track_ids", "quality", "grade", "ratio", "duration_score", "score"))


def ensemble_match(s, d):
    """Motion, temporal and statistical components, their ensemble, and the best five of each recording.

    motion is the greater correlation with speed and acceleration. temporal correlates the most varied
    steps of both sides, over six at least. statistical is the cosine of the robustly normalised
    profiles' common length: a recording has one feature, so of a track's only the first (speed)."""

    def score(a, b, fits):
        x, speed, accel, rate = blocks.matrix(a["x"]), *[blocks.matrix(b[c]) for c in ("speed", "accel", "rate")]
        motion = np.maximum(*[np.round(blocks.correlation(x, y)[0], 6) for y in (speed, accel)])
        temporal = np.round(blocks.correlation(np.diff(x), blocks.most_varied_steps(speed, accel, rate), 6)[0], 6)
        statistical = np.round(np.minimum(blocks.cosine(blocks.robust_profiles(x), blocks.robust_profiles(speed)), 1.0), 6)
        total = sum(w * c for w, c in zip(ENSEMBLE_BASIC.values(), (motion, temporal, statistical))) / sum(ENSEMBLE_BASIC.values())
        return blocks.picked(blocks.best(total, fits, 6, 5), motion, temporal, statistical)

    tracks = _tracks(s, d, speed="speed_mph", accel="accel", rate="speed_change_rate")
    c = blocks.scored(_videos(s, d), tracks, ", ".join(f"{k} double" for k in ENSEMBLE_BASIC), score, merge=blocks.MERGE, best=5)
    total, confidence = scalar.ensemble_score({k: F.col(k) for k in ENSEMBLE_BASIC}, ENSEMBLE_BASIC)
    c = c.withColumns({"score": scalar.half_up(total, 5), "confidence": confidence})
    return out(blocks.best_of(c, 5, "score"), "video_id", "track_id", "rank", "motion", "temporal", "statistical", "score", "confidence")


def adaptive_ensemble(s, d):
    e = adapters.numbered_events(s, d)
    x = scalar.adaptive_score({"dtw": F.col("k") / 100.0, "statistical": F.when(F.col("k") > 20, F.col("value") / 500), "unknown": F.when(F.col("k") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(0.25))})
    return out(e.withColumn("score", x), "event_id", "score")


def statistical_similarity(s, d):
    profiles = lambda key: similarity.statistical_profile(features(s, d), "track_id", ["speed_mph", "elevation"]).withColumnRenamed("track_id", key)
    videos, tracks = _spans(s, d)

    def score(a, b, fits):
        r = blocks.cosine(blocks.matrix(a["profile"]), blocks.matrix(b["profile"]))
        return blocks.picked(blocks.best(r, fits, 3), r)

    p = blocks.scored(videos.join(profiles("video_id"), "video_id"), tracks.join(profiles("track_id"), "track_id"), "statistical double", score)
    return out(track.top_k(p.withColumn("statistical", F.round("statistical", 6)), "video_id", 3, F.desc("statistical"), F.col("track_id")), "video_id", "track_id", "rank", "statistical")


def temporal_signature(s, d):
    f = features(s, d).select("track_id", F.col("pt_idx").alias("idx"), "speed_mph", "elevation")
    return out(similarity.most_varied(f, "track_id", "idx", ["speed_mph", "elevation"]), "track_id", "idx", "signature")


def multi_scale(s, d, scales=(1, 5, 10, 30)):
    """Mean |r| over every 1st, 5th, 10th and 30th point; scales with under three points don't count."""

    def score(a, b, fits):
        x, y = blocks.matrix(a["x"]), blocks.matrix(b["speed"])
        found = [blocks.correlation(x[:, ::k], y[:, ::k]) for k in scales]
        counts = sum((n >= 3).astype(int) for _, n in found)
        mean = sum(np.where(n >= 3, r, 0.0) for r, n in found) / np.maximum(counts, 1)
        return blocks.picked(fits & (counts > 0), mean)

    p = blocks.scored(_videos(s, d), _tracks(s, d, speed="speed_mph"), "multi_scale double", score, merge=blocks.MERGE)
    return blocks.expanded(out(p, "video_ids", "track_ids", "multi_scale"))


def directional(s, d):
    """Mean of |r| of the cosines and of the sines of two angles in degrees."""

    def score(a, b, fits):
        x, y = np.radians(blocks.matrix(a["x"])), np.radians(blocks.matrix(b["bearing"]))
        (c, n), (t, _) = blocks.correlation(np.cos(x), np.cos(y)), blocks.correlation(np.sin(x), np.sin(y))
        return blocks.picked(fits & (n > 0), (c + t) / 2)

    p = blocks.scored(_videos(s, d), _tracks(s, d, bearing="bearing"), "directional double", score, merge=blocks.MERGE)
    return blocks.expanded(out(p, "video_ids", "track_ids", "directional"))


def _self_pairs(s, d):
    f = features(s, d).select("track_id", F.col("pt_idx").alias("idx"), "elevation", "speed_mph")
    return f.select("track_id", "idx", F.col("elevation").alias("x")), f.select("track_id", "idx", F.col("speed_mph").alias("y"))


def lag_search(s, d):
    a, b = _self_pairs(s, d)
    r = similarity.lagged(a, b, ["track_id"], "x", "y")
    return out(r, "track_id", "score", "lag")


def cross_correlation(s, d):
    a, b = _self_pairs(s, d)
    r = similarity.cross_correlation(a.withColumn("x", F.col("x").cast("decimal(20,2)")), b.withColumn("y", F.round("y", 2).cast("decimal(20,2)")), ["track_id"], "x", "y")
    return r.select("track_id", F.col("peak").cast("double").alias("peak"), "offset")


def resampled(s, d):
    m = adapters.motion(s, d)
    # halves of the last of six digits do occur here: nine digits hold these values exactly
    return similarity.resampled(m, "video_id", "motion_magnitude", 64).select("video_id", "i", (F.round("motion_magnitude", 9) + 0.0).alias("motion_magnitude"))


def overlap_match(s, d):
    """Of a recording's tracks the one with the longest overlap, then the best score."""

    def score(a, b, fits):
        r, n = blocks.correlation(blocks.matrix(a["x"]), blocks.matrix(b["speed"]))
        r = np.round(r, 6)
        return blocks.picked(blocks.best(n + r / 2, fits & (n > 10), 1), n, r)

    r = blocks.scored(_videos(s, d), _tracks(s, d, speed="speed_mph"), "overlap long, score double", score)
    return similarity.best_by_overlap(r, "video_id").select("video_id", "overlap", "score")


def vector_cosine_top5(s, d):
    """A stated query set (vec_id divisible by 100) against all vectors, in blocks."""
    e = adapters.read(s, d, "embeddings").select(F.col("vec_id").alias("track_id"), F.lit(1.0).alias("track_s"), "embedding")
    q = adapters.read(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("video_id"), F.lit(0.0).alias("video_s"), "embedding")

    def score(a, b, fits):
        x, y = blocks.matrix(a["embedding"]), blocks.matrix(b["embedding"])
        r = (x @ y.T) / np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None, :])
        return blocks.picked(blocks.best(r, fits, 5), r)

    c = blocks.scored(q, e, "score double", score, least_s=0.0, size=2048).withColumn("score", F.round("score", 6) + 0.0)
    return track.top_k(c, "video_id", 5, F.desc("score"), F.col("track_id")).select(F.col("video_id").alias("query_id"), F.col("track_id").alias("vec_id"), "rank", "score")


# ---- joins


def _gps(s, d):
    t = adapters.tracks(s, d)
    return t.select(F.col("track_id").alias("video_id"), F.hour("ts").alias("second"), F.col("pt_idx").alias("ord"), "lat", "lon")


def _frames(s, d):
    return adapters.detections(s, d).select("video_id", "det_idx", (F.col("frame_second") + 1).alias("second"))


def frame_positions(s, d):
    return out(joins.with_positions(_frames(s, d), _gps(s, d)), "video_id", "det_idx", "second", "lat", "lon")


def frame_positions_first(s, d):
    return out(joins.with_positions(_frames(s, d), _gps(s, d), inner=True, first=True), "video_id", "det_idx", "second", "lat", "lon")


def shifted_join(s, d):
    m = adapters.motion(s, d).select(F.col("video_id").alias("track_id"), F.col("idx").alias("second"), "motion_magnitude")
    t = adapters.tracks(s, d).select("track_id", "pt_idx", "lat")
    return out(joins.shifted(m, t, 5, ["track_id"]), "track_id", "second", "pt_idx", "motion_magnitude", "lat")


def band_join(s, d):
    t = adapters.tracks(s, d)
    left = t.select(F.concat_ws(":", "track_id", "pt_idx").alias("row_id"), "lat", "lon")
    right = t.select("lat", "lon", (F.col("track_id").cast("int") * 1000 + F.col("pt_idx")).alias("ord"), F.unix_micros("ts").alias("gpx_us"))
    return joins.band(left, right).select("row_id", "gpx_us")


def cell_neighbours(s, d):
    t = adapters.tracks(s, d).select(F.concat_ws(":", "track_id", "pt_idx").alias("row_id"), "lat", "lon")
    return joins.neighbours(t, 0.00125)


def as_of_join(s, d):
    e = adapters.numbered_events(s, d)
    left, right = e.where("event_type = 'click'").select("uid", "epoch_s", "event_id"), e.where("event_type = 'view'").select("uid", "epoch_s", "value")
    return out(joins.as_of(left, right, "uid", "epoch_s", "value"), "event_id", "value_asof")


def interpolation(s, d):
    m = adapters.motion(s, d)
    grid = m.groupBy("video_id").agg(F.max("t").alias("n")).select("video_id", F.explode(F.sequence(F.lit(0), F.lit(50))).alias("i"), "n").select("video_id", (F.col("i") * F.col("n") / 49).alias("t"))
    return out(joins.interpolated(m, grid, "video_id", "t", "motion_magnitude"), "video_id", t=F.round("t", 3), motion_magnitude=F.round("motion_magnitude", 4))


def filled_seconds(s, d):
    g = adapters.detections(s, d).groupBy("video_id", F.col("frame_second").alias("second")).agg(F.avg("confidence").alias("c"))
    return out(joins.filled_seconds(g, "video_id", "c"), "video_id", "second", "c")


def event_gaps(s, d):
    e = adapters.numbered_events(s, d)
    a, b = e.where("event_type = 'error'").select("uid", F.col("epoch_s").alias("t")), e.where("event_type = 'view'").select("uid", F.col("epoch_s").alias("t"))
    return out(joins.nearest_event(a, b, "uid", within=20000.0), "uid", "events", mean_gap=F.round("mean_gap", 3), aligned_share=True)


def kept_or_processed(s, d):
    o = adapters.read(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    p = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return out(joins.kept_or(o, p, ["o_orderkey"], ["o_totalprice"]), "o_orderkey", "o_orderstatus", "o_totalprice")


def remaining_tasks(s, d):
    o = adapters.read(s, d, "orders")
    progress = o.select("o_custkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return joins.remaining(adapters.read(s, d, "customer").select("c_custkey", "c_mktsegment"), progress.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


def known_only(s, d):
    return joins.only_known(adapters.read(s, d, "supplier").select("s_suppkey"), adapters.read(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey")


def enriched_orders(s, d):
    n = adapters.read(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    return joins.prefixed(adapters.read(s, d, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey")


QUERIES = [
    match_top3, duration_pairs, ensemble_match, adaptive_ensemble, statistical_similarity, temporal_signature, multi_scale, directional, lag_search, cross_correlation, resampled, overlap_match,
    vector_cosine_top5, frame_positions, frame_positions_first, shifted_join, band_join, cell_neighbours, as_of_join, interpolation, filled_seconds, event_gaps, kept_or_processed, remaining_tasks, known_only, enriched_orders,
]

PAIRS = f"""{q.FEATURES}, {q.MOTION}, vid AS (SELECT video_id, max(t) AS video_s FROM mo GROUP BY video_id), trk AS (SELECT track_id, max(epoch_s) - min(epoch_s) AS track_s FROM pt GROUP BY track_id),
pairs AS (SELECT * FROM vid, trk WHERE track_s >= 5.0 AND (video_s <= 0 OR track_s BETWEEN video_s * 0.7 AND video_s * 2.0) AND video_id <> track_id)"""
ROWS = f"{PAIRS}, rws AS (SELECT p.video_id, p.track_id, mo.idx, mo.motion_magnitude, f.speed_mph, f.accel, f.bearing, f.turn_angle FROM pairs p JOIN mo USING (video_id) JOIN f ON f.track_id = p.track_id AND f.pt_idx = mo.idx)"


def _r(x: str, y: str, least: int = 3, counted: str = "*") -> str:
    return f"CASE WHEN count({counted}) < {least} OR stddev_pop({x}) < 1e-8 OR stddev_pop({y}) < 1e-8 THEN 0.0 ELSE abs(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y}))) END"


def _robust(name: str, table: str, key: str, x: str) -> str:
    """id, i, z: the four figures of a profile, by their median and median absolute deviation."""
    return f"""{name}0 AS (SELECT {key} AS id, unnest([avg({x}), stddev_pop({x}), median({x}), quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)]) AS v, unnest([1, 2, 3, 4]) AS i FROM {table} GROUP BY 1),
      {name}1 AS (SELECT *, v - median(v) OVER (PARTITION BY id) AS c FROM {name}0), {name} AS (SELECT id, i, c / CASE WHEN median(abs(c)) OVER (PARTITION BY id) > 1e-8 THEN median(abs(c)) OVER (PARTITION BY id) ELSE 1 END AS z FROM {name}1)"""


QUALITY = "CASE WHEN {0} >= 0.85 THEN 'excellent' WHEN {0} >= 0.70 THEN 'very_good' WHEN {0} >= 0.55 THEN 'good' WHEN {0} >= 0.40 THEN 'fair' WHEN {0} >= 0.25 THEN 'poor' ELSE 'very_poor' END"
LEVELS = "['very_poor', 'poor', 'fair', 'good', 'very_good', 'excellent']"
GPS = f"{q.TRACK}, {q.DET}, fr AS (SELECT video_id, det_idx, frame_second + 1 AS second FROM det), gp AS (SELECT track_id AS video_id, hour(ts) AS second, arg_{{0}}(lat, pt_idx) AS lat, arg_{{0}}(lon, pt_idx) AS lon FROM pt GROUP BY 1, 2)"
EV = "ev AS (SELECT CAST(user_id AS VARCHAR) AS uid, epoch_us(ts) / 1e6 AS epoch_s, * FROM events)"

SQL = {
    "match_top3": f"WITH {ROWS}, c AS (SELECT video_id, track_id, {q.r(_r('motion_magnitude', 'speed_mph'))} AS score FROM rws GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, track_id) AS rank FROM c) SELECT video_id, track_id, rank, score, {QUALITY.format('score')} AS quality FROM k WHERE rank <= 3",
    "duration_pairs": f"""WITH {PAIRS}, a AS (SELECT *, CASE WHEN video_s > 0 AND track_s > 0 THEN track_s / video_s END AS ratio, ((CAST(track_id AS INTEGER) * 7 + CAST(video_id AS INTEGER) * 13) % 100) / 100.0::DOUBLE AS base FROM pairs),
      b AS (SELECT *, CASE WHEN ratio BETWEEN 0.85 AND 1.15 THEN 'excellent' WHEN ratio BETWEEN 0.75 AND 1.35 THEN 'good' WHEN ratio BETWEEN 0.65 AND 1.5 THEN 'fair' WHEN ratio IS NOT NULL THEN 'poor' ELSE 'invalid' END AS quality, coalesce(exp(-2 * abs(ratio - 1)), 0.0) AS duration_score FROM a),
      c AS (SELECT *, CASE WHEN quality = 'excellent' AND base > 0.6 THEN least(base + duration_score * 0.1, 1.0) ELSE base * CASE quality WHEN 'excellent' THEN 1.0 WHEN 'good' THEN 0.95 WHEN 'fair' THEN 0.85 WHEN 'poor' THEN 0.7 ELSE 0.5 END END AS score FROM b),
      e AS (SELECT *, {LEVELS}[greatest(0, list_position({LEVELS}, {QUALITY.format('score')}) - 1 - CASE quality WHEN 'excellent' THEN 0 WHEN 'good' THEN 0 WHEN 'fair' THEN 1 WHEN 'poor' THEN 2 ELSE 3 END) + 1] AS g FROM c)
      SELECT video_id, track_id, quality, CASE WHEN (ratio < 0.3 OR ratio > 3.0) AND g IN ('very_good', 'excellent') THEN 'poor' ELSE g END AS grade, {q.cols('ratio', 'duration_score', 'score')} FROM e""",
    "ensemble_match": f"""WITH {PAIRS}, {_robust('vr', 'mo', 'video_id', 'motion_magnitude')}, {_robust('tr', 'f', 'track_id', 'speed_mph')},
      st AS (SELECT p.video_id, p.track_id, least(abs(sum(a.z * b.z)) / sqrt(sum(a.z * a.z) * sum(b.z * b.z)), 1.0) AS statistical FROM pairs p JOIN vr a ON a.id = p.video_id JOIN tr b ON b.id = p.track_id AND b.i = a.i GROUP BY 1, 2),
      ms AS (SELECT *, motion_magnitude - lag(motion_magnitude) OVER (PARTITION BY video_id ORDER BY idx) AS x FROM mo),
      f0 AS (SELECT *, speed_mph - {q.lag('speed_mph')} AS s, accel - {q.lag('accel')} AS a, speed_change_rate - {q.lag('speed_change_rate')} AS c FROM f),
      pk AS (SELECT track_id, var_pop(s) AS vs, var_pop(a) AS va, var_pop(c) AS vc FROM f0 GROUP BY 1),
      fs AS (SELECT f0.*, CASE greatest(vs, va, vc) WHEN vs THEN s WHEN va THEN a ELSE c END AS y FROM f0 JOIN pk USING (track_id)),
      rws AS (SELECT p.video_id, p.track_id, ms.motion_magnitude, fs.speed_mph, fs.accel, CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y FROM pairs p JOIN ms USING (video_id) JOIN fs ON fs.track_id = p.track_id AND fs.pt_idx = ms.idx),
      c AS (SELECT video_id, track_id, greatest({_r('motion_magnitude', 'speed_mph')}, {_r('motion_magnitude', 'accel')}) AS motion, {_r('x', 'y', 6, 'x')} AS temporal FROM rws GROUP BY 1, 2),
      e AS (SELECT video_id, track_id, round(motion, 6) AS motion, round(temporal, 6) AS temporal, round(statistical, 6) AS statistical FROM c JOIN st USING (video_id, track_id)),
      d AS (SELECT *, round(least(greatest((motion * 0.4 + temporal * 0.3 + statistical * 0.3) / (0.4 + 0.3 + 0.3), 0.0), 1.0), 5) AS score FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, track_id) AS rank FROM d)
      SELECT video_id, track_id, rank, {q.cols('motion', 'temporal', 'statistical', 'score')}, 1.0::DOUBLE AS confidence FROM k WHERE rank <= 5""",
    "adaptive_ensemble": f"""WITH a AS (SELECT event_id, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
      SELECT event_id, {q.rounded(score='(k / 100.0 * 1.2 + CASE WHEN k > 20 THEN value / 500 * 1.0 ELSE 0.0 END + CASE WHEN k % 2 <> 0 THEN 0.25 * 0.5 ELSE 0.0 END) / (1.2 + CASE WHEN k > 20 THEN 1.0 ELSE 0.0 END + CASE WHEN k % 2 <> 0 THEN 0.5 ELSE 0.0 END)')} FROM a""",
    "statistical_similarity": f"""WITH {PAIRS}, pr AS (SELECT track_id, [avg(speed_mph), stddev_pop(speed_mph), median(speed_mph), quantile_cont(speed_mph, 0.75) - quantile_cont(speed_mph, 0.25), avg(elevation), stddev_pop(elevation), median(elevation), quantile_cont(elevation, 0.75) - quantile_cont(elevation, 0.25)] AS p FROM f GROUP BY 1),
      c AS (SELECT p.video_id, p.track_id, {q.r('abs(list_cosine_similarity(a.p, b.p))')} AS statistical FROM pairs p JOIN pr a ON a.track_id = p.video_id JOIN pr b ON b.track_id = p.track_id), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY statistical DESC, track_id) AS rank FROM c) SELECT * FROM k WHERE rank <= 3""",
    "temporal_signature": f"""WITH {q.FEATURES}, a AS (SELECT track_id, pt_idx, speed_mph - {q.lag('speed_mph')} AS s, elevation - {q.lag('elevation')} AS e FROM f), v AS (SELECT track_id, var_pop(s) >= var_pop(e) AS pick FROM a WHERE s IS NOT NULL GROUP BY 1)
      SELECT a.track_id, a.pt_idx - 1 AS idx, {q.rounded(signature='CASE WHEN v.pick THEN s ELSE e END')} FROM a JOIN v USING (track_id) WHERE s IS NOT NULL""",
    "multi_scale": f"WITH {ROWS}, r AS (SELECT video_id, track_id, scale, {_r('motion_magnitude', 'speed_mph')} AS r, count(*) AS n FROM rws, (SELECT unnest([1, 5, 10, 30]) AS scale) WHERE idx % scale = 0 GROUP BY 1, 2, 3) SELECT video_id, track_id, {q.rounded(multi_scale='avg(r)')} FROM r WHERE n >= 3 GROUP BY 1, 2",
    "directional": f"WITH {ROWS} SELECT video_id, track_id, {q.rounded(directional='(' + _r('cos(radians(motion_magnitude))', 'cos(radians(bearing))') + ' + ' + _r('sin(radians(motion_magnitude))', 'sin(radians(bearing))') + ') / 2')} FROM rws GROUP BY 1, 2",
    "lag_search": f"""WITH {q.FEATURES}, r AS (SELECT a.track_id, lag, {_r('a.elevation', 'b.speed_mph')} AS r FROM f a, range(-20, 21) AS z(lag), f b WHERE abs(lag) <= a.n // 4 AND b.track_id = a.track_id AND b.pt_idx = a.pt_idx + lag GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY r DESC, abs(lag), lag) AS n FROM r) SELECT track_id, {q.rounded(score='r')}, lag FROM k WHERE n = 1""",
    "cross_correlation": f"""WITH {q.FEATURES}, r AS (SELECT a.track_id, a.pt_idx - b.pt_idx AS lag, sum(CAST(a.elevation AS DECIMAL(20,2)) * CAST(round(b.speed_mph, 2) AS DECIMAL(18,2))) AS s FROM f a JOIN f b USING (track_id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY s DESC, lag) AS n FROM r) SELECT track_id, CAST(s AS DOUBLE) AS peak, lag AS "offset" FROM k WHERE n = 1""",
    "resampled": f"""WITH {q.MOTION}, n AS (SELECT video_id, count(*) AS n FROM mo GROUP BY 1), g AS (SELECT video_id, n, i, least(greatest((i + 0.5::DOUBLE) * n / 64 - 0.5, 0.0), CAST(n - 1 AS DOUBLE)) AS at_p FROM n, range(64) AS z(i)), h AS (SELECT *, CAST(floor(at_p) AS BIGINT) AS lo FROM g)
      SELECT h.video_id, h.i, {q.r('a.motion_magnitude + (b.motion_magnitude - a.motion_magnitude) * (at_p - lo)', 9)} AS motion_magnitude FROM h JOIN mo a ON a.video_id = h.video_id AND a.idx = lo JOIN mo b ON b.video_id = h.video_id AND b.idx = least(lo + 1, n - 1)""",
    "overlap_match": f"WITH {ROWS}, c AS (SELECT video_id, track_id, count(*) AS overlap, {q.r(_r('motion_magnitude', 'speed_mph'))} AS score FROM rws GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY overlap DESC, score DESC) AS n FROM c WHERE overlap > 10) SELECT video_id, overlap, score FROM k WHERE n = 1",
    "vector_cosine_top5": f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT a.vec_id AS query_id, b.vec_id, {q.r('list_cosine_similarity(a.v, b.v)')} AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c) SELECT * FROM k WHERE rank <= 5",
    "frame_positions": f"WITH {GPS.format('max')} SELECT video_id, det_idx, second, {q.cols('lat', 'lon')} FROM fr LEFT JOIN gp USING (video_id, second)",
    "frame_positions_first": f"WITH {GPS.format('min')} SELECT video_id, det_idx, second, {q.cols('lat', 'lon')} FROM fr JOIN gp USING (video_id, second)",
    "shifted_join": f"WITH {q.TRACK}, {q.MOTION} SELECT track_id, idx AS second, pt_idx, {q.cols('motion_magnitude', 'lat')} FROM mo JOIN pt ON track_id = video_id AND pt_idx = idx + 5",
    "band_join": f"""WITH {q.TRACK}, l AS (SELECT track_id || ':' || pt_idx AS row_id, lat, lon FROM pt), r AS (SELECT lat, lon, CAST(track_id AS INTEGER) * 1000 + pt_idx AS ord, epoch_us(ts) AS us FROM pt)
      SELECT l.row_id, arg_min(us, ord) AS gpx_us FROM l LEFT JOIN r ON abs(l.lat - r.lat) <= 1e-4 AND abs(l.lon - r.lon) <= 1e-4 GROUP BY 1""",
    "cell_neighbours": f"""WITH {q.TRACK}, a AS (SELECT track_id || ':' || pt_idx AS row_id, CAST(floor(lat / 0.00125) AS BIGINT) AS cx, CAST(floor(lon / 0.00125) AS BIGINT) AS cy FROM pt), c AS (SELECT cx, cy, count(*) AS n FROM a GROUP BY 1, 2)
      SELECT row_id, CAST(sum(c.n) - 1 AS BIGINT) AS neighbours FROM a JOIN c ON c.cx BETWEEN a.cx - 1 AND a.cx + 1 AND c.cy BETWEEN a.cy - 1 AND a.cy + 1 GROUP BY 1""",
    "as_of_join": f"WITH {EV} SELECT l.event_id, {q.rounded(value_asof='r.value')} FROM (SELECT * FROM ev WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') r ON l.uid = r.uid AND l.epoch_s >= r.epoch_s",
    "interpolation": f"""WITH {q.MOTION}, g AS (SELECT video_id, i * max(t) / 49 AS t FROM mo, range(51) AS z(i) GROUP BY video_id, i), a AS (SELECT g.video_id, g.t, m.t AS t0, m.motion_magnitude AS v0 FROM g ASOF LEFT JOIN mo m ON m.video_id = g.video_id AND g.t >= m.t),
      b AS (SELECT a.*, m.t AS t1, m.motion_magnitude AS v1 FROM a ASOF LEFT JOIN mo m ON m.video_id = a.video_id AND a.t < m.t) SELECT video_id, {q.r('t', 3)} AS t, {q.r('CASE WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END', 4)} AS motion_magnitude FROM b""",
    "filled_seconds": f"""WITH {q.DET}, s AS (SELECT video_id, frame_second AS sec, avg(confidence) AS c FROM det GROUP BY 1, 2), g AS (SELECT video_id, unnest(range(0, max(sec) + 1)) AS sec FROM s GROUP BY 1),
      a AS (SELECT g.video_id, g.sec, s.sec AS s0, s.c AS c0 FROM g ASOF LEFT JOIN s ON s.video_id = g.video_id AND g.sec >= s.sec), b AS (SELECT a.*, s.sec AS s1, s.c AS c1 FROM a ASOF LEFT JOIN s ON s.video_id = a.video_id AND a.sec <= s.sec)
      SELECT video_id, CAST(sec AS DOUBLE) AS second, {q.rounded(c='CASE WHEN c0 IS NULL THEN c1 WHEN c1 IS NULL THEN c0 WHEN s0 = s1 THEN c0 ELSE c0 + (c1 - c0) * (sec - s0) / (s1 - s0) END')} FROM b""",
    "event_gaps": f"""WITH {EV}, e AS (SELECT uid, epoch_s, event_id FROM ev WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY epoch_s) <= 5), g AS (SELECT e.uid, e.event_id, min(abs(e.epoch_s - v.epoch_s)) AS gap FROM e LEFT JOIN ev v ON v.uid = e.uid AND v.event_type = 'view' GROUP BY 1, 2)
      SELECT uid, count(*) AS events, {q.r('avg(gap)', 3)} AS mean_gap, {q.rounded(aligned_share='count(*) FILTER (gap < 20000.0) / count(*)')} FROM g GROUP BY 1""",
    "kept_or_processed": f"SELECT o_orderkey, o_orderstatus, {q.rounded(o_totalprice='CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END')} FROM orders",
    "remaining_tasks": "SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')",
    "known_only": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
    "enriched_orders": "SELECT c_nationkey, c_custkey, n_name AS match_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
}
