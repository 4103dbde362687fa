"""What earlier rounds found wrong or too large, against the SQL and brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import assert_same
from waygrid import catalog
from waygrid.config import ENSEMBLE_BASIC
from waygrid.functions import arrays, scalar
from waygrid.operators import blocks, joins, sequence

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = datetime.datetime(2024, 3, 1)


def events(spark, path, rows) -> str:
    """A folder with events of (user, minute, type, value, k)."""
    spark.createDataFrame([(i, START + datetime.timedelta(minutes=m), u, kind, float(v), f'{{"k": {k}}}') for i, (u, m, kind, v, k) in enumerate(rows)], EVENTS).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_objects_that_stand_still(spark, tmp_path):
    d = events(spark, tmp_path, [(1, i, "view", v, k) for i, (v, k) in enumerate([(5, 3), (5, 3), (7, 3), (7, 3), (7, 1), (5, 1)])])
    r = [(x.step_px, x.px_bearing) for x in QUERIES["object_motion"](spark, d).orderBy("det_idx").collect()]
    assert r[0] == (0.0, 0.0) and r[1] == r[3] == (0.0, 180.0)
    assert_same(QUERIES["object_motion"](spark, d), SQL["object_motion"], d)


def test_ensemble_on_a_half(spark):
    d = "/root/testdata/sf0.01"  # recording 61 and track 119 score 0.374275
    assert_same(QUERIES["ensemble_match"](spark, d), SQL["ensemble_match"], d)


def test_scores_rounded_as_in_sql(spark):
    rng = random.Random(8)
    rows = [tuple(round(rng.random(), 6) for _ in range(3)) for _ in range(4000)] + [(0.161416, 0.047166, 0.985196)]
    total, _ = scalar.ensemble_score({k: F.col(k) for k in ENSEMBLE_BASIC}, ENSEMBLE_BASIC)
    df = spark.createDataFrame(rows, "motion double, temporal double, statistical double").select(scalar.half_up(total, 5).alias("score"))
    values = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in rows)
    assert_same(df, f"SELECT round((m * 0.4 + t * 0.3 + s * 0.3) / (0.4 + 0.3 + 0.3), 5) AS score FROM (VALUES {values}) z(m, t, s)")


def test_band_of_crowded_places(spark):
    """Many rows of one place, places a tolerance apart, none in reach, NULL and NaN: against brute force."""
    rng, near = random.Random(4), 1e-4
    spot = lambda: (44.95 + rng.randint(0, 60) * near / 4, -93.3 + rng.randint(0, 60) * near / 4)
    right = [(*spot(), i * 7919 % 5003) for i in range(400)] + [(44.95, -93.3, 6000 + i) for i in range(300)] + [(None, -93.3, -1), (float("nan"), -93.3, -2)]
    left = [(f"a{i}", *spot()) for i in range(400)] + [(f"b{i}", 44.95, -93.3) for i in range(300)] + [("far", 50.0, 10.0), ("none", None, -93.3), ("nan", float("nan"), -93.3)]
    a, b = spark.createDataFrame(left, "row_id string, lat double, lon double"), spark.createDataFrame(right, "lat double, lon double, ord long").withColumn("us", F.col("ord") * 10)
    plan = joins.band(a, b)
    found = {r.row_id: r.us for r in plan.collect()}
    reach = lambda x, y: x is not None and y is not None and abs(x - y) <= near
    for name, x, y in left:
        hits = [o for p, q, o in right if reach(x, p) and reach(y, q)]
        assert found[name] == (min(hits) * 10 if hits else None), name
    assert len(found) == len(left)


def test_band_makes_no_row_a_pair(spark, tmp_path):
    """9,000 points in reach of each other: 81 million pairs."""
    d = events(spark, tmp_path, [(u, i, "view", 100 + i % 3 / 10, 5) for u in (1, 2, 3) for i in range(3000)])
    df = QUERIES["band_join"](spark, d)
    assert "FlatMapCoGroupsInArrow" in str(df._jdf.queryExecution().executedPlan())  # places meet in tiles, not in a join
    assert [r["count"] for r in df.groupBy("gpx_us").count().collect()] == [9000]


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """Three recordings, five copies of each and one of a fourth; copies have the same points at the same times."""
    rng, rows = random.Random(9), []
    for u, n in enumerate((60, 66, 75, 70)):
        points = [(i + u, "view", round(rng.uniform(1, 300), 2), rng.randint(0, 99)) for i in range(n)]
        rows += [(10 * c + u, *p) for c in range(5 if u < 3 else 1) for p in points]
    return events(spark, tmp_path_factory.mktemp("copied"), rows)


def test_merged_series(spark):
    df = spark.createDataFrame([(str(i), 7.0, [1.0, float(i % 2), None]) for i in range(9)], "video_id string, video_s double, x array<double>")
    found = sorted((r.video_id, r.ids, r.least) for r in blocks.merged(df, "video_id", 2).collect())
    assert found == [("0", ["0", "2"], "0"), ("1", ["1", "3"], "1"), ("4", ["4", "6"], "0"), ("5", ["5", "7"], "1"), ("8", ["8"], "0")]


def test_parted_ids(spark):
    """A part for each remainder: what hangs on it is no work for each pair of ids."""
    df = spark.createDataFrame([(["1", "2", "11", "31"], ["5", "15", "7"], 0.5)], "video_ids array<string>, track_ids array<string>, z double")
    last = lambda x: F.pmod(x.cast("int"), F.lit(10))
    found = sorted((r.video_ids_at, r.video_ids, r.track_ids_at, r.track_ids, r.z) for r in blocks.parted(df, video_ids=last, track_ids=last).collect())
    assert found == [(v, a, t, b, 0.5) for v, a in ((1, ["1", "11", "31"]), (2, ["2"])) for t, b in ((5, ["5", "15"]), (7, ["7"]))]


@pytest.mark.parametrize("name", ["ensemble_match", "cnn_match"])
def test_copies_match_as_in_sql(spark, copied, name, monkeypatch):
    monkeypatch.setattr(blocks, "MERGE", 2)
    df = QUERIES[name](spark, copied)
    assert "video_ids" in df._jdf.queryExecution().toString()  # copies are scored once
    assert_same(df, SQL[name], copied)


@pytest.mark.parametrize("name", ["multi_scale", "directional", "duration_pairs"])
def test_copies_give_each_pair_a_row_as_in_sql(spark, copied, name, monkeypatch):
    monkeypatch.setattr(blocks, "MERGE", 2)
    df = QUERIES[name](spark, copied)
    assert "video_ids" in df._jdf.queryExecution().toString()  # copies are scored once
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()  # small inputs don't make few tasks
    assert df.count() == 16 * 15
    assert_same(df, SQL[name], copied)


def test_tiles_of_a_block(spark, monkeypatch):
    """29 videos and 40 tracks in one block of tiles of 8: every pair once."""
    monkeypatch.setattr(blocks, "BLOCKS", 1)
    v = spark.createDataFrame([(str(i), 10.0, float(i)) for i in range(29)], "video_id string, video_s double, x double")
    t = spark.createDataFrame([(str(i), 10.0, float(i)) for i in range(40)], "track_id string, track_s double, y double")
    product = lambda a, b, fits: blocks.picked(fits, a["x"].to_numpy()[:, None] * b["y"].to_numpy()[None, :])
    found = {(r.video_id, r.track_id): r.z for r in blocks.scored(v, t, "z double", product, size=8).collect()}
    assert found == {(str(i), str(j)): float(i * j) for i in range(29) for j in range(40) if i != j}


def test_copies_are_dealt_over_tasks(spark, monkeypatch):
    """40 equal videos and tracks, two to a row: a block would hold them all, but has a few of their ids."""
    monkeypatch.setattr(blocks, "IDS", 8)
    v = spark.createDataFrame([(str(i), 10.0, 1.0) for i in range(40)], "video_id string, video_s double, x double")
    t = spark.createDataFrame([(str(i), 10.0, 2.0) for i in range(40)], "track_id string, track_s double, y double")
    product = lambda a, b, fits: blocks.picked(fits, a["x"].to_numpy()[:, None] * b["y"].to_numpy()[None, :])
    pairs = blocks.scored(v, t, "z double", product, merge=2)
    assert pairs.select(F.spark_partition_id()).distinct().count() > 5
    assert sorted((r.video_id, r.track_id, r.z) for r in blocks.expanded(pairs).collect()) == sorted((str(i), str(j), 2.0) for i in range(40) for j in range(40) if i != j)


def _scan_one_by_one(offsets, vt, v, gt, g, grid, overlap, points, damp):
    best, best_r = None, 0.0
    for offset in offsets:
        first, last = max(vt[0], gt[0] + offset), min(vt[-1], gt[-1] + offset)
        t = np.arange(first, last, grid)
        if last - first < overlap or len(t) < points:
            continue
        r = arrays.pearson(np.interp(t, vt, v), np.interp(t, gt + offset, g))
        r *= damp if arrays.p_value(r, len(t)) > 0.05 else 1
        if abs(r) > abs(best_r):
            best, best_r = float(offset), r
    return best, best_r


@pytest.mark.parametrize("n,m,shift", [(66, 66, 3.0), (70, 40, -7.5), (30, 90, 12.0), (12, 12, 0.0), (9, 5, 0.0)])
def test_scan_of_all_offsets_at_once(n, m, shift, monkeypatch):
    rng = np.random.default_rng(n)
    vt, gt = np.cumsum(rng.uniform(0.5, 1.5, n)), np.arange(m) - shift
    v = rng.normal(size=n)
    g = np.interp(gt + shift, vt, v) + 0.2 * rng.normal(size=m)
    g[: m // 2] = g[0] if n == 30 else g[: m // 2]  # constant over many an overlap
    expected = _scan_one_by_one(np.arange(-1200, 1201) * 0.05, vt, v, gt, g, 0.2, 8.0, 20, 0.5)
    calls, interp = [], np.interp
    monkeypatch.setattr(np, "interp", lambda *a: calls.append(1) or interp(*a))
    found = arrays._scan(np.arange(-1200, 1201) * 0.05, vt, v, gt, g, 0.2, 8.0, 20, 0.5)
    assert found[0] == expected[0] and found[1] == pytest.approx(expected[1], abs=1e-9) and len(calls) < 50


@pytest.mark.parametrize("name", ["sequence_scores", "sequence_offsets", "flow_match"])
def test_copies_score_alike(spark, copied, name, monkeypatch):
    """Merged series give the rows that series on their own give."""
    columns = QUERIES[name](spark, copied).columns
    monkeypatch.setattr(blocks, "MERGE", 2)
    merged = QUERIES[name](spark, copied)
    assert "video_ids" in merged._jdf.queryExecution().toString()
    monkeypatch.setattr(blocks, "merged", lambda df, key, most: df.withColumn("ids", F.array(key)).withColumn("least", F.col(key)))
    alone = QUERIES[name](spark, copied)
    rows = [sorted(x.select(*columns).collect()) for x in (merged, alone)]
    assert len(rows[0]) == len(rows[1]) == (16 * 15 if name != "flow_match" else 16 * 3)
    for a, b in zip(*rows):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=2e-6)


def test_objects_that_go_straight_up(spark, tmp_path):
    """Steps whose dx is what rounding leaves of 0: bearings a hair short of 360."""
    d = events(spark, tmp_path, [(1, 0, "view", 29.26, 45), (1, 1, "view", 39.76, 24), (2, 0, "view", 34.68, 31), (2, 1, "view", 46.18, 8)])
    assert_same(QUERIES["object_motion"](spark, d), SQL["object_motion"], d)
    assert {r.px_bearing for r in QUERIES["object_motion"](spark, d).collect()} == {0.0}


def _series_of_many_lengths(rng, n):
    """Noise, ramps and steps of 0 to 40 values; each third is a stretched other."""
    out = [rng.normal(size=k) * 10.0 ** rng.integers(-3, 4) for k in rng.integers(0, 40, n)]
    out[4:9] = [np.arange(30.0), np.zeros(12), np.repeat([1.0, 5.0, 2.0], 9), np.array([3.0]), np.array([])]
    return [np.repeat(out[k - 1], 2)[:40] if k % 3 == 0 and k else x for k, x in enumerate(out)]


def test_warped_as_pair_by_pair(monkeypatch):
    """The distances of every pair at once, most shape distances not followed to their end."""
    rng, followed, warped = np.random.default_rng(6), [], blocks.warped
    xs, ys = ([arrays.robust(x) for x in _series_of_many_lengths(rng, n)] for n in (33, 41))
    rows, cols = np.nonzero(np.ones((33, 41)))

    def counted(x, *rest, **more):
        followed.append(x.shape[-1] if x.ndim == 3 else 0)
        return warped(x, *rest, **more)

    monkeypatch.setattr(blocks, "warped", counted)
    found = sequence.warped_apart(xs, ys, rows, cols)
    for r, c, d in zip(rows, cols, found):
        if len(xs[r]) and len(ys[c]):
            assert d == pytest.approx(min(arrays.dtw(xs[r], ys[c]), arrays.shape_dtw(xs[r], ys[c])), rel=1e-12, abs=1e-12)
    assert 0 < sum(followed) < len(rows) / 2


def test_nearest_points_are_no_farther(monkeypatch):
    rng = np.random.default_rng(7)
    xs, ys = ([arrays.shapes(x) for x in _series_of_many_lengths(rng, n)] for n in (21, 25))
    of_x, of_y = sequence.nearest(xs, ys)
    for r, p in enumerate(xs):
        for c, q in enumerate(ys):
            apart = np.sqrt(((p[:, None] - q[None, :]) ** 2).sum(2))
            assert not of_x[len(p) :, r, c].any() and not of_y[len(q) :, r, c].any()
            if apart.size:
                assert (of_x[: len(p), r, c] <= apart.min(1)).all() and (of_y[: len(q), r, c] <= apart.min(0)).all()


def test_ways_as_pair_by_pair():
    """Offsets along the cheapest ways by the steps kept, one byte a cell."""
    rng = np.random.default_rng(8)
    xs, ys = ([x for x in _series_of_many_lengths(rng, n) if len(x)] for n in (23, 29))
    xs[0], ys[0] = rng.integers(0, 3, 30).astype(float), rng.integers(0, 3, 34).astype(float)  # many ties
    rows, cols = np.nonzero(np.ones((len(xs), len(ys))))
    na, nb = np.array([*map(len, xs)])[rows], np.array([*map(len, ys)])[cols]
    cost, ways = blocks.warped(sequence._padded(xs)[:, rows], sequence._padded(ys)[:, cols], na, nb, keep=True)
    assert ways.dtype == np.uint8
    middle, length = blocks.warped_ways(ways, na, nb)
    for r, c, m, d in zip(rows, cols, middle, 1 / (1 + cost / length)):
        assert (m, d) == pytest.approx(arrays.dtw_offset(xs[r], ys[c]), rel=1e-12)
