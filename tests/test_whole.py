"""Matching and alignment over whole series: every recording, point, second and lag counts."""

import datetime
import random

import numpy as np
import pytest

from waygrid import catalog
from waygrid.functions import arrays
from waygrid.operators import similarity
from waygrid.plans.track_queries import features

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


CUTS = {"multi_scale": "video_id < '", "directional": "video_id < '", "frame_positions": "det_idx %", "frame_positions_first": "det_idx %", "band_join": "pt_idx %", "filled_seconds": "frame_second %", "cross_correlation": "range(", "lag_search": "range(-10"}


@pytest.mark.parametrize("name", sorted(CUTS))
def test_sql_covers_all_rows(name):
    assert CUTS[name] not in SQL[name]


@pytest.fixture(scope="module")
def four_tracks(spark, tmp_path_factory):
    """A folder with events of four users: 60 to 75 points a minute apart, and one user of 10."""
    rng, rows, start = random.Random(5), [], datetime.datetime(2024, 3, 1)
    for user, n in ((1, 60), (2, 75), (3, 66), (4, 10)):
        for i in range(n):
            rows.append((len(rows), start + datetime.timedelta(minutes=i + user), user, "view", round(rng.uniform(1, 300), 2), f'{{"k": {rng.randint(0, 99)}}}'))
    d = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    whole = {}
    for r in sorted(features(spark, d).select("track_id", "pt_idx", "elevation", "speed_mph").collect()):
        x, y = whole.setdefault(r.track_id, ([], []))
        x.append(r.elevation)
        y.append(r.speed_mph)
    return d, {k: (np.array(x), np.array(y)) for k, (x, y) in whole.items()}


PAIRS = {(v, t) for v in "123" for t in "123" if v != t}  # user 4's nine minutes fit no other's


def brute_warp(cost):
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for i in range(n):
        for j in range(m):
            total[i + 1, j + 1] = cost[i, j] + min(total[i, j], total[i, j + 1], total[i + 1, j])
    return total[1:, 1:]


def test_sequence_scores_of_whole_series(spark, four_tracks):
    d, whole = four_tracks
    found = {(r.video_id, r.track_id): r for r in QUERIES["sequence_scores"](spark, d).collect()}
    assert set(found) == PAIRS
    for (v, t), r in found.items():
        x, y = whole[v][0], whole[t][1]
        n = min(len(x), len(y))
        a, b = x[:n] - x[:n].mean(), y[:n] - y[:n].mean()
        fft = max(abs(sum(a[(i + k) % n] * b[i] for i in range(n))) for k in range(n)) / np.sqrt((a @ a) * (b @ b))
        a, b = arrays.robust(x), arrays.robust(y)
        p, q = arrays.shapes(a), arrays.shapes(b)
        plain, shape = np.abs(a[:, None] - b[None, :]), np.sqrt(((p[:, None] - q[None, :]) ** 2).sum(2))
        dtw = 1 / (1 + min(brute_warp(plain)[-1, -1], brute_warp(shape)[-1, -1]) / max(len(a), len(b)))
        assert (r.fft, r.dtw) == pytest.approx((fft, dtw), abs=1e-6)


def test_sequence_offsets_of_whole_series(spark, four_tracks):
    d, whole = four_tracks
    found = {(r.video_id, r.track_id): r for r in QUERIES["sequence_offsets"](spark, d).collect()}
    assert set(found) == PAIRS
    for (v, t), r in found.items():
        x, y = whole[v][0], whole[t][1]
        total = brute_warp(np.abs(x[:, None] - y[None, :]))
        i, j, way = len(x) - 1, len(y) - 1, []
        while i >= 0 and j >= 0:
            way.append(j - i)
            i, j = min([(p, q) for p, q in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p >= 0 and q >= 0], key=lambda s: total[s], default=(-1, -1))
        assert (r.dtw_offset, r.score) == pytest.approx((np.median(way), 1 / (1 + total[-1, -1] / len(way))), abs=1e-6)
        a, b = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
        c = {k: abs(sum(a[i + k] * b[i] for i in range(len(b)) if 0 <= i + k < len(a))) for k in range(1 - len(b), len(a))}
        at = max(c, key=c.get)
        assert r.height == pytest.approx(c[at] / np.sqrt((a @ a) * (b @ b)), abs=1e-6) and abs(r.offset - at) <= 0.5


def test_ensemble_of_three_components(spark, four_tracks):
    d, whole = four_tracks
    by = {}
    for r in sorted(features(spark, d).select("track_id", "pt_idx", "speed_mph", "accel", "speed_change_rate").collect()):
        by.setdefault(r.track_id, []).append(r[2:])

    def corr(a, b, least):
        n = min(len(a), len(b))
        return 0.0 if n < least or min(np.std(a[:n]), np.std(b[:n])) < 1e-8 else abs(np.corrcoef(a[:n], b[:n])[0, 1])

    profile = lambda x: arrays.robust(np.array([x.mean(), x.std(), np.median(x), np.subtract(*np.percentile(x, [75, 25]))]))
    found = {(r.video_id, r.track_id): r for r in QUERIES["ensemble_match"](spark, d).collect()}
    assert set(found) == PAIRS
    for (v, t), r in found.items():
        x, f = whole[v][0], np.array(by[t])
        steps = np.diff(f, axis=0)
        motion = max(corr(x, f[:, 0], 3), corr(x, f[:, 1], 3))
        temporal = corr(np.diff(x), steps[:, steps.var(0).argmax()], 6)
        p, q = profile(x), profile(f[:, 0])
        statistical = abs(p @ q) / np.sqrt((p @ p) * (q @ q))
        assert (r.motion, r.temporal, r.statistical) == pytest.approx((motion, temporal, statistical), abs=2e-6)
        assert r.score == pytest.approx(0.4 * motion + 0.3 * temporal + 0.3 * statistical, abs=2e-5) and r.confidence == 1.0
    for v in "123":
        order = sorted((t for a, t in PAIRS if a == v), key=lambda t: (-found[v, t].score, t))
        assert [found[v, t]["rank"] for t in order] == [1, 2]


def test_far_peak(spark, tmp_path):
    """One point stands out in elevation (the 70th), another in speed (the fifth)."""
    start = datetime.datetime(2024, 3, 1)
    rows = [(i, start + datetime.timedelta(minutes=i), 1, "view", 1000.0 * (i == 70), f'{{"k": {500_000 if i == 5 else 0}}}') for i in range(80)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    speed = [r.speed_mph for r in features(spark, str(tmp_path)).orderBy("pt_idx").collect()]
    (r,) = QUERIES["cross_correlation"](spark, str(tmp_path)).collect()
    top = np.round(speed, 2)
    assert r.offset == 70 - int(np.flatnonzero(top == top.max())[-1]) and r.offset > 60  # the least lag on ties
    assert r.peak == pytest.approx(1000 * max(speed), rel=1e-6)


def test_lags_within_a_quarter(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=90)
    for n, shift, found in ((80, 15, True), (20, 8, False)):
        a = spark.createDataFrame([("k", i, float(x[i])) for i in range(n)], "k string, idx int, x double")
        b = spark.createDataFrame([("k", i + shift, float(x[i])) for i in range(n - shift)], "k string, idx int, y double")
        r = similarity.lagged(a, b, ["k"], "x", "y").first()
        assert (r.lag == shift and r.score == pytest.approx(1)) == found and abs(r.lag) <= n // 4
