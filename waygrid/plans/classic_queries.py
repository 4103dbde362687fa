"""Queries of the further matchers, reports and relational extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from waygrid.functions import scalar
from waygrid.operators import aggregates, blocks, classic, joins, ranking, track
from waygrid.plans import match_queries as m
from waygrid.plans import sql as q
from waygrid.plans.report_queries import MATCH, _matches
from waygrid.plans.track_queries import features, out
from waygrid.sources import adapters


def cnn_match(s, d):
    """Length of each frame's vector against speed, acceleration and consistency; the best three."""
    e = adapters.numbered_events(s, d)
    frames = classic.frame_norms(e.select("uid", "n", "epoch_s", F.array("value", F.col("k").cast("double")).alias("v")), "v")
    videos = m._series(frames.withColumnRenamed("uid", "video_id"), "video_id", "n", (F.max("epoch_s") - F.min("epoch_s")).alias("video_s"), x="norm")
    r = classic.largest_correlation(videos, m._tracks(s, d, a="speed_mph", b="accel", c="consistency"), ["x"], ["a", "b", "c"], 3, blocks.MERGE)
    return blocks.best_of(r.withColumn("score", F.round("score", 6) + 0.0), 3, "score").select("video_id", "track_id", "rank", "score")


def flow_match(s, d):
    """Motion energy warped onto curvature, turn angle and jerk; the best three."""
    r = classic.warped_similarity(m._videos(s, d), m._tracks(s, d, a="curvature", b="turn_angle", c="jerk"), [("x", "a"), ("x", "b"), ("x", "c")], 3, blocks.MERGE)
    return out(blocks.best_of(r.withColumn("score", F.round("score", 6)), 3, "score"), "video_id", "track_id", "rank", "score")


def environment_match(s, d):
    r = classic.environmental(m._videos(s, d), m._tracks(s, d, a="elevation", b="speed_mph"), {"motion_elevation": ("x", "a"), "stability_movement": ("x", "b")})
    return out(r.where("motion_elevation > 0 or stability_movement > 0"), "video_id", "track_id", "motion_elevation", "stability_movement")


def classic_scores(s, d):
    """The formulas of the older matchers over given part scores."""
    e = adapters.numbered_events(s, d)
    v, k = F.col("value") / 500, F.col("k") / 100.0
    parts = {"fft": v, "dtw": k, "stats": F.when(F.col("k") > 20, v * k), "temporal": F.when(F.col("k") > 60, k * k)}
    ratio = classic.plausibility(F.col("value"), F.col("k").cast("double"))
    c = classic.combined_score(parts, classic.ENHANCED, ratio)
    sig = classic.combined_score({"fft": v, "signal": k, "stats": v * k}, classic.SIGNATURE)
    scores = {"plausible": ratio, "enhanced": c, "aligned": classic.aligned_score(c, k), "signature": sig, "stretched": classic.stretched_best(v, k), "motion_accel": classic.motion_accel_score(v, k, ratio)}
    # halves of the sixth digit do occur here: twelve digits hold these values
    return e.select("event_id", *[(F.round(x, 12) + 0.0).alias(n) for n, x in scores.items()])


def accepted_match(s, d):
    o = adapters.read(s, d, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("track_id"), (F.col("o_orderkey") % 61).alias("overlap"), F.round(F.pmod(F.col("o_totalprice"), F.lit(1.0)), 4).alias("score"))
    return out(classic.best_by_score(o, "video_id"), "video_id", "track_id", "overlap", "score")


def distance_rank(s, d):
    o = adapters.read(s, d, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("track_id"), "o_totalprice")
    return classic.nearest_rank(o, "video_id", "o_totalprice").select("video_id", "track_id", "rank")


def first_matches(s, d):
    return classic.first_matches(_matches(s, d), 50).select("video_id", "track_id", "rank")


def distinct_keys(s, d):
    """Customers and suppliers by nation: a union of distinct keys."""
    return classic.all_paths(adapters.read(s, d, "customer").select(F.col("c_nationkey").alias("nation")), adapters.read(s, d, "supplier").select(F.col("s_nationkey").alias("nation")))


def contained_classes(s, d):
    g = adapters.detections(s, d).groupBy("video_id").agg(F.collect_set("object_class").alias("there"))
    all_, some = classic.containment(F.array(F.lit("view"), F.lit("error")), F.col("there"))
    return g.select("video_id", all_.alias("all_there"), some.alias("some_there"))


def offset_ranges(s, d):
    v, t = m._spans(s, d)
    j = v.join(t.withColumnRenamed("track_id", "video_id"), "video_id").withColumn("start", F.lit(0.0)).withColumn("off", F.col("video_s") % 60)
    r = classic.search_range(classic.gps_range(j, "start", "off", "video_s"), ("start", "video_s"), ("gps_start", "gps_end"))
    return out(r, "video_id", "gps_start", "gps_end", "low", "high")


def resampled_accel(s, d):
    """Values on whole hours and their gradient."""
    g = adapters.detections(s, d).groupBy("video_id", F.col("frame_second").alias("second")).agg(F.avg("confidence").alias("c"))
    f = joins.filled_seconds(g, "video_id", "c").withColumnsRenamed({"video_id": "track_id", "second": "pt_idx"})
    f = f.withColumn("c", F.round("c", 6) + 0.0)
    return f.select("track_id", "pt_idx", "c", (F.round(track.gradient("c"), 9) + 0.0).alias("accel"))


def full_gaps(s, d):
    """Customers without orders and orders' customers, with both sides kept."""
    c, o = adapters.read(s, d, "customer").select("c_custkey"), adapters.read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.join(o.where("n > 12"), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_custkey", "n")


def status_cube(s, d):
    return adapters.read(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def status_sets(s, d):
    o = adapters.read(s, d, "orders")
    return o.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def shared_nations(s, d):
    c, p = adapters.read(s, d, "customer").select("c_nationkey"), adapters.read(s, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    both, only = c.intersect(p).withColumn("side", F.lit("both")), c.subtract(p).withColumn("side", F.lit("customers"))
    return both.unionByName(only)


def approximate_counts(s, d):
    """Distinct customers within 5% (no SQL: the sketches differ)."""
    return adapters.read(s, d, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))


def type_counts(s, d):
    return ranking.distribution(adapters.detections(s, d), "object_class")


def ratio_report(s, d):
    p = m.duration_pairs(s, d).select("quality", "ratio")
    return out(ranking.ratio_report(p), "quality", "n", "low", "high", "mean")


def event_signature(s, d):
    return out(aggregates.mean_signature(features(s, d), "track_id", "pt_idx", "speed_mph", "elevation"), "track_id", "pt_idx", "signature")


def robust_series(s, d):
    return out(aggregates.robust_normalised(features(s, d), "elevation"), "track_id", "pt_idx", "elevation_robust")


def small_functions(s, d):
    e = adapters.numbered_events(s, d)
    v, k = F.col("value"), F.col("k")
    return e.select("event_id", scalar.location_key(F.lit(44.5), F.lit(-93.25)).alias("place"), scalar.sync_grade(k / 100.0, v > 100).alias("grade"), (F.round(scalar.processing_minutes(v, k, 4), 12) + 0.0).alias("minutes"), (F.round(scalar.positive_or_next(k - 50, v), 6) + 0.0).alias("seconds"), F.length(scalar.hashed_id(F.col("uid"), "salt")).alias("id_chars"))


QUERIES = [
    cnn_match, flow_match, environment_match, classic_scores, accepted_match, distance_rank, first_matches, distinct_keys, contained_classes, offset_ranges, resampled_accel, full_gaps, status_cube, status_sets, shared_nations,
    approximate_counts, type_counts, ratio_report, event_signature, robust_series, small_functions,
]

EV = "ev AS (SELECT event_id, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"
BEST3 = "k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, track_id) AS rank FROM c) SELECT video_id, track_id, rank, score FROM k WHERE rank <= 3"
SQL = {
    "cnn_match": f"""WITH {m.PAIRS}, fr AS (SELECT CAST(user_id AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, sqrt(value * value + pow(CAST(regexp_extract(props, '[0-9]+') AS INTEGER), 2)) AS x FROM events),
      c AS (SELECT p.video_id, p.track_id, {q.r('greatest(' + ', '.join(m._r('x', y) for y in ('speed_mph', 'accel', 'consistency')) + ')')} AS score FROM pairs p JOIN fr USING (video_id) JOIN f ON f.track_id = p.track_id AND f.pt_idx = fr.idx GROUP BY 1, 2), {BEST3}""",
    "environment_match": f"""WITH {m.ROWS}, n AS (SELECT track_id AS id, count(*) AS n FROM f GROUP BY 1), el AS (SELECT r.video_id, r.track_id, {m._r('r.motion_magnitude', 'f.elevation')} AS e, {m._r('r.motion_magnitude', 'f.speed_mph')} AS v FROM rws r JOIN f ON f.track_id = r.track_id AND f.pt_idx = r.idx GROUP BY 1, 2)
      SELECT video_id, track_id, {q.rounded(motion_elevation='e', stability_movement='v')} FROM el JOIN n a ON a.id = video_id JOIN n b ON b.id = track_id WHERE a.n = b.n AND (e > 0 OR v > 0)""",
    "classic_scores": f"""WITH {EV}, a AS (SELECT event_id, value / 500 AS v, k / 100.0::DOUBLE AS k, k > 20 AS s, k > 60 AS t, coalesce(least(value, k) / nullif(greatest(value, k), 0), 0.0) AS plausible FROM ev),
      b AS (SELECT *, CASE WHEN s AND t THEN (v * 0.25 + k * 0.25 + v * k * 0.15 + k * k * 0.15) / 0.8 WHEN s THEN (v * 0.25 + k * 0.25 + v * k * 0.15) / 0.65 WHEN t THEN (v * 0.25 + k * 0.25 + k * k * 0.15) / 0.65 ELSE (v + k) / 2 END * CASE WHEN plausible < 0.3 THEN 0.5 ELSE 1.0 END AS enhanced FROM a)
      SELECT event_id, {q.r('plausible', 12)} AS plausible, {q.r('enhanced', 12)} AS enhanced, {q.r('enhanced * (0.5 + 0.5 * k)', 12)} AS aligned, {q.r('v * 0.4 + k * 0.4 + v * k * 0.2', 12)} AS signature, {q.r('1 / (1 + exp(-10 * (greatest(v, k) - 0.5)))', 12)} AS stretched, {q.r('(0.6 * v + 0.4 * k) * plausible', 12)} AS motion_accel FROM b""",
    "accepted_match": f"WITH a AS (SELECT o_custkey AS video_id, o_orderkey AS track_id, o_orderkey % 61 AS overlap, round(o_totalprice % 1.0, 4) AS score FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, track_id) AS n FROM a WHERE overlap > 30) SELECT video_id, track_id, overlap, {q.cols('score')} FROM b WHERE n = 1 AND score >= 0.5",
    "distance_rank": "SELECT o_custkey AS video_id, o_orderkey AS track_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice NULLS LAST, o_orderkey) AS rank FROM orders",
    "first_matches": f"WITH {MATCH} SELECT video_id, track_id, rank FROM m ORDER BY video_id, rank LIMIT 50",
    "distinct_keys": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "contained_classes": "SELECT CAST(user_id AS VARCHAR) AS video_id, bool_or(event_type = 'view') AND bool_or(event_type = 'error') AS all_there, bool_or(event_type IN ('view', 'error')) AS some_there FROM events GROUP BY 1",
    "offset_ranges": f"""WITH {q.MOTION}, v AS (SELECT video_id, max(t) AS s FROM mo GROUP BY 1), a AS (SELECT video_id, s, s % 60 AS g0, s % 60 + s AS g1 FROM v), b AS (SELECT *, greatest(g0 - s, -90.0) AS low, least(g1, 90.0) AS high FROM a)
      SELECT video_id, {q.rounded(gps_start='g0', gps_end='g1', low='CASE WHEN low <= high THEN low END', high='CASE WHEN low <= high THEN high END')} FROM b""",
    "resampled_accel": f"WITH b AS ({m.SQL['filled_seconds']}) SELECT video_id AS track_id, second AS pt_idx, c, {q.r(q.gradient('c', '(PARTITION BY video_id ORDER BY second)'), 9)} AS accel FROM b",
    "full_gaps": "SELECT c_custkey, o_custkey, n FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12) o ON c_custkey = o_custkey",
    "status_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "status_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "shared_nations": "SELECT c_nationkey, 'both' AS side FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT c_nationkey, 'customers' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
    "type_counts": "SELECT event_type AS object_class, count(*) AS n FROM events GROUP BY 1",
    "ratio_report": f"WITH a AS ({m.SQL['duration_pairs']}) SELECT quality, count(*) AS n, {q.rounded(low='min(ratio)', high='max(ratio)', mean='avg(ratio)')} FROM a GROUP BY 1",
    "event_signature": f"WITH {q.FEATURES} SELECT track_id, pt_idx, {q.rounded(signature='(speed_mph + elevation) / 2')} FROM f",
    "robust_series": f"WITH {q.TRACK}, a AS (SELECT *, elevation - median(elevation) OVER (PARTITION BY track_id) AS c FROM pt), b AS (SELECT *, median(abs(c)) OVER (PARTITION BY track_id) AS mad FROM a) SELECT track_id, pt_idx, {q.rounded(elevation_robust='CASE WHEN mad > 1e-8 THEN c / mad ELSE c END')} FROM b",
    "small_functions": f"WITH {EV} SELECT event_id, '44.50000,-93.25000' AS place, CASE WHEN NOT value > 100 THEN 'poor' WHEN k >= 70 THEN 'excellent' WHEN k >= 50 THEN 'good' ELSE 'fair' END AS grade, {q.r('value * k * 0.1 / 4 / 60', 12)} AS minutes, {q.rounded(seconds='CASE WHEN k > 50 THEN k - 50 WHEN value > 0 THEN value ELSE 0 END')}, 16 AS id_chars FROM ev",
}
