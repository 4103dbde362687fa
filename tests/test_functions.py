"""Hand-computed cases, so that an error which a query and its SQL share is seen."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waygrid.config import DEFAULT
from waygrid.functions import arrays, geo, scalar, sqlfuncs
from waygrid.operators import joins, similarity, track


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def d(x):
    return F.lit(None).cast("double") if x is None else F.lit(float(x))


@pytest.mark.parametrize("args, want", [((0, 0, 1, 0), 3958.8 * math.pi / 180), ((0, 0, 0, 1), 3958.8 * math.pi / 180), ((5, 5, 5, 5), 0.0), ((None, 0, 1, 0), None), ((0, 0, 0, 180), 3958.8 * math.pi)])
def test_haversine(spark, args, want):
    got = one(spark, geo.haversine(*map(d, args)))
    assert got is None if want is None else got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("to, want", [((1, 0), 0), ((0, 1), 90), ((-1, 0), 180), ((0, -1), 270)])
def test_bearing(spark, to, want):
    assert one(spark, geo.bearing(d(0), d(0), d(to[0]), d(to[1]))) == pytest.approx(want)


@pytest.mark.parametrize("a, b, want", [(350, 10, 20), (10, 350, 20), (0, 180, 180), (-30, 30, 60)])
def test_angle_diff(spark, a, b, want):
    assert one(spark, geo.angle_diff(d(a), d(b))) == pytest.approx(want)


def test_destination_is_haversines_inverse(spark):
    lat, lon = geo.destination(d(45), d(-93), d(37), d(5000))
    row = spark.range(1).select(geo.haversine_m(d(45), d(-93), lat, lon).alias("m"), geo.bearing(d(45), d(-93), lat, lon).alias("b")).first()
    assert row.m == pytest.approx(5000, rel=1e-9) and row.b == pytest.approx(37, abs=1e-6)


@pytest.mark.parametrize("score, want", [(0.85, "excellent"), (0.8499, "very_good"), (0.55, "good"), (0.4, "fair"), (0.25, "poor"), (0.1, "very_poor")])
def test_quality(spark, score, want):
    assert one(spark, scalar.quality_grade(d(score))) == want


def test_unknown_quality_level_is_lowest(spark):
    assert [one(spark, scalar.quality_level(F.lit(x))) for x in ("excellent", "very_poor", "strange")] == [5, 0, 0]


def test_ensemble_leaves_out_invalid_components(spark):
    score, share = scalar.ensemble_score({"motion": d(0.8), "temporal": F.lit(float("nan")), "statistical": d(None), "optical_flow": d(-1), "cnn_feature": d(0.4), "advanced_dtw": d(None)})
    row = spark.range(1).select(score.alias("s"), share.alias("c")).first()
    assert row.s == pytest.approx((0.8 * 0.25 + 0.4 * 0.15) / 0.40) and row.c == pytest.approx(2 / 6)


def test_ensemble_of_nothing_is_zero(spark):
    assert one(spark, scalar.ensemble_score({"motion": d(None)})[0]) == 0


@pytest.mark.parametrize("ratio, score, want", [(1.0, 0.9, "excellent"), (1.45, 0.9, "very_good"), (1.9, 0.9, "good"), (3.5, 0.99, "good"), (None, 0.9, "fair")])
def test_duration_grade(spark, ratio, score, want):
    assert one(spark, scalar.duration_grade(d(score), scalar.temporal_quality(d(ratio)), d(ratio))) == want


def test_silence_and_hue(spark):
    assert one(spark, scalar.decibels(d(None))) == -100 and one(spark, scalar.decibels(F.lit(float("-inf")))) == -100
    assert [one(spark, scalar.light_color(F.lit(h))) for h in (0, 10, 12, 20, 40, 170, 100)] == ["red", "red", "unknown", "yellow", "green", "red", "unknown"]


def test_minmax_of_equal_values_is_half(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r.x for r in df.select(scalar.minmax(F.col("v")).alias("x")).collect()] == [0.5, 0.5]


def test_arrays_as_columns(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([([1.0, nan, inf, None],)], "v array<double>")
    assert df.select(scalar.nan_inf_filled(F.col("v")).alias("x")).first().x == [1.0, 0.0, 1.0, 0.0]
    assert one(spark, scalar.padded(F.array(d(1)), 3)) == [1.0, 0.0, 0.0]
    assert one(spark, scalar.cosine(F.array(d(1), d(0)), F.array(d(0), d(1)))) == 0 and one(spark, scalar.cosine(F.array().cast("array<double>"), F.array(d(1)))) == 0


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    row = spark.sql("SELECT haversine_miles(0D, 0D, 1D, 0D) a, bearing_deg(0D, 0D, 0D, 1D) b, angle_difference(350D, 10D) c, quality_grade(0.6D) q").first()
    assert row.a == pytest.approx(69.0941, abs=1e-3) and row.b == pytest.approx(90) and row.c == 20 and row.q == "good"


def test_short_tracks(spark):
    rows = [("a", 0, 0.0, 0.0, 0.0, 1.0), ("b", 0, 0.0, 0.0, 0.0, 1.0), ("b", 1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "track_id string, pt_idx int, epoch_s double, lat double, lon double, elevation double")
    got = {(r.track_id, r.pt_idx): r for r in track.shape_features(track.stop_features(track.motion_features(df))).collect()}
    assert got["a", 0].step_mi == 0 and got["a", 0].accel == 0 and got["a", 0].dt == 1.0
    assert got["b", 1].dt == 0.1 and got["b", 1].step_mi == pytest.approx(69.0941, abs=1e-3)


@pytest.mark.parametrize("w", [4, 5])
def test_rolling_edges(spark, w):
    import pandas as pd

    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "track_id string, pt_idx int, v double")
    got = [r.m for r in df.select("pt_idx", F.avg("v").over(track.centred(w)).alias("m")).orderBy("pt_idx").collect()]
    assert got == pytest.approx(pd.Series(x).rolling(w, center=True, min_periods=1).mean().tolist())
    got = [r.m for r in df.select("pt_idx", track.convolved("v", w).alias("m")).orderBy("pt_idx").collect()]
    assert got == pytest.approx(np.convolve(x, np.ones(w) / w, "same").tolist())


def test_gradient_like_numpy(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "track_id string, pt_idx int, v double")
    assert [r.g for r in df.select("pt_idx", track.gradient("v").alias("g")).orderBy("pt_idx").collect()] == pytest.approx(np.gradient(x).tolist())


def test_band_join_across_cells(spark):
    left = spark.createDataFrame([(1, 0.00019999, 0.0), (2, 5.0, 5.0)], "row_id int, lat double, lon double")
    right = spark.createDataFrame([(0.00020001, 0.00009, 7, "late"), (0.00028, -0.00009, 3, "first")], "lat double, lon double, ord int, name string")
    assert {r.row_id: r.name for r in joins.band(left, right).collect()} == {1: "first", 2: None}


def test_last_row_of_a_second_wins(spark):
    gps = spark.createDataFrame([("v", 1, 0, 1.0, 0.0), ("v", 1, 1, 2.0, 0.0)], "video_id string, second int, ord int, lat double, lon double")
    frames = spark.createDataFrame([("v", 1), ("v", 2)], "video_id string, second int")
    assert {r.second: r.lat for r in joins.with_positions(frames, gps).collect()} == {1: 2.0, 2: None}
    assert [r.lat for r in joins.with_positions(frames, gps, inner=True, first=True).collect()] == [1.0]


def test_constant_series_have_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, float(i)) for i in range(5)], "k int, x double, y double")
    r = similarity.correlations(df, ["k"], {"flat": ("x", "y"), "same": ("y", "y")}).first()
    assert r.flat == 0 and r.same == pytest.approx(1)


def test_weights_follow_their_order(spark):
    df = spark.createDataFrame([(2, 0.5, 1.0), (1, 1.0, 0.5)], "ord int, a double, final double")
    assert similarity.weights_ema(df, ["a"]).first().a == pytest.approx((1.0 * 0.9 + 0.05) * 0.9 + 0.05)


# ---- sequences

values = st.lists(st.floats(-100, 100, allow_nan=False), min_size=1, max_size=24)


@settings(max_examples=60, deadline=None)
@given(values)
def test_dtw_of_itself_is_zero(x):
    x = np.array(x)
    assert arrays.dtw(x, x) == 0 and arrays.shape_dtw(x, x) == 0


@settings(max_examples=60, deadline=None)
@given(values, values)
def test_dtw_against_the_plain_recurrence(a, b):
    t = np.full((len(a) + 1, len(b) + 1), np.inf)
    t[0, 0] = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = abs(x - y) + min(t[i, j], t[i, j + 1], t[i + 1, j])
    assert arrays.dtw(np.array(a), np.array(b)) == pytest.approx(t[-1, -1] / max(len(a), len(b)))


def test_p_values():
    # t tables: |t| = 2.228 for 10 degrees of freedom is 5 %, 2.086 for 20
    for df, t in ((10, 2.228139), (20, 2.085963), (100, 1.983972)):
        r = t / math.sqrt(df + t * t)
        assert arrays.p_value(r, df + 2) == pytest.approx(0.05, abs=1e-5)


def test_offset_is_found():
    rng = np.random.default_rng(3)
    t = np.arange(0, 60, 0.2)
    v = np.convolve(rng.standard_normal(len(t)), np.ones(5) / 5, "same")
    offset, confidence, method, grade = arrays.offset_search(t, v, t - 3.0, v, DEFAULT)
    assert offset == pytest.approx(3.0, abs=0.011) and confidence > 0.99 and (method, grade) == ("refined", "excellent")
    assert arrays.offset_search(t, np.ones(len(t)), t, v, DEFAULT)[0] is None
    assert arrays.offset_search([], [], [], [], DEFAULT)[3] == "poor"


def test_low_pass_keeps_slow_and_stops_fast():
    t = np.arange(300)
    slow, fast = np.sin(2 * np.pi * t / 100), np.sin(2 * np.pi * t / 2.5)
    got = arrays.zero_phase(slow + fast)
    assert np.abs(got - slow)[20:-20].max() < 0.02
    b, a = arrays.butterworth(1, 0.5)
    assert b == pytest.approx([0.5, 0.5]) and a == pytest.approx([1, 0], abs=1e-12)


def test_other_sequences():
    x = np.sin(2 * np.pi * np.arange(64) / 8)
    assert arrays.dominant_frequency(x) == 8 / 32 and arrays.dominant_frequency(x[:15]) == 0
    assert arrays.circular_correlation(x, np.roll(x, 3)) == pytest.approx(1) and arrays.circular_correlation(x, np.ones(64)) == 0
    assert arrays.phase_correlation(x + np.arange(64) % 7, np.roll(x + np.arange(64) % 7, 5)) > 0.9
    assert arrays.best_lag(np.eye(1, 30, 10)[0], np.eye(1, 30, 7)[0])[0] == 3
    assert arrays.prominences(np.array([0, 3, 1, 2, 0.0])).tolist() == [3, 1]
    assert arrays.dtw_offset(np.eye(1, 20, 4)[0], np.eye(1, 20, 6)[0])[1] == pytest.approx(1)
    assert arrays.dtw_similarity(None, [1.0]) == 0 and arrays.fft_offset([], [])[0] == 0
    y = np.random.default_rng(1).standard_normal(80)
    assert abs(arrays.fft_offset(np.roll(y, 4), y, 0.5)[0] - 2.0) < 0.3
