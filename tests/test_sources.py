import json

import pytest
from pyspark.sql import functions as F

from waygrid.operators import ranking
from waygrid.sources import readers, schemas, sinks
from waygrid.streaming import streams


def gpx(points, ele=True):
    pts = "".join(f'<trkpt lat="{44 + i / 1000}" lon="-93.1">{f"<ele>{i}</ele>" if ele else ""}<time>2023-01-01T10:{i // 60:02d}:{i % 60:02d}Z</time></trkpt>' for i in range(points))
    return f'<?xml version="1.0"?><gpx version="1.1"><trk><trkseg>{pts}</trkseg><trkseg><trkpt lat="0" lon="0"></trkpt></trkseg></trk></gpx>'


@pytest.fixture()
def tracks(tmp_path):
    for name, n in (("long.gpx", 12), ("short.gpx", 4)):
        (tmp_path / name).write_text(gpx(n, ele=name == "long.gpx"))
    (tmp_path / "broken.gpx").write_text("<gpx><trk><trkseg><trkpt")
    return str(tmp_path)


def test_gpx(spark, tracks):
    got = readers.gpx_tracks(spark, f"{tracks}/*.gpx").orderBy("pt_idx").collect()
    assert len(got) == 12 and got[3].lat == pytest.approx(44.003) and got[3].elevation == 3 and got[0].track_id.endswith("long.gpx")
    assert [r.pt_idx for r in got] == list(range(12))
    rejects = {r.path.rsplit("/", 1)[1]: r.reason for r in readers.gpx_rejects(spark, tracks).collect()}
    assert rejects == {"short.gpx": "too few points", "broken.gpx": "no points"}


def test_gpx_seconds_and_times(spark, tracks):
    pts = readers.gpx_points(spark, f"{tracks}/long.gpx")
    assert pts.count() == 13  # the point on the equator stays
    per = readers.gpx_seconds(pts, per_segment=True).where("segment_idx = 1").first()
    assert per.second == 0 and readers.gpx_seconds(pts).agg(F.max("second")).first()[0] == 12
    assert readers.relative_seconds(pts.where("ts is not null")).agg(F.max("t")).first()[0] == 11
    twice = pts.unionByName(pts.withColumn("pt_idx", F.col("pt_idx") + 100))
    assert readers.advancing(twice).count() == 12


def test_csv_family(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Second,LAT,long,speed_mph,gpx_time\n1,44.5,-93.2,30,2023-01-01 10:00:00\nx,,,,\n")
    rows = readers.merged_csv(spark, str(tmp_path / "m.csv")).collect()
    assert rows[0].second == 1 and rows[0].lon == -93.2 and rows[1].second is None and rows[0].gpx_time is not None
    (tmp_path / "d.csv").write_text('frame_second,object_class,bbox,confidence,lat,lon\n3,car,"[1.0, 2.0, 3.0, 4.0]",0.5,1,2\n')
    kind, df = readers.any_map_csv(spark, str(tmp_path / "d.csv"))
    assert kind == "enhanced" and df.first().bbox == [1.0, 2.0, 3.0, 4.0]
    (tmp_path / "a.csv").write_text("second,lat,lon,speed_mph\n1,2,3,4\n")
    assert readers.any_map_csv(spark, str(tmp_path / "a.csv"))[0] == "aligned"
    (tmp_path / "g.csv").write_text("latitude,lng,type\n1,2,sign\n")
    kind, df = readers.any_map_csv(spark, str(tmp_path / "g.csv"))
    assert kind == "generic" and tuple(df.first()) == (1.0, 2.0, "sign")
    assert schemas.missing_columns(df, ["lat", "second"]) == ["second"]


@pytest.mark.parametrize("wrapped", [True, False])
def test_match_documents(spark, tmp_path, wrapped):
    doc = {"/a b/v.mp4": {"matches": [{"path": "t1.gpx", "combined_score": 0.9}, {"path": "t2.gpx", "combined_score": None}]}, "w.mp4": {"matches": []}}
    (tmp_path / "r.json").write_text(json.dumps({"results": doc, "info": 1} if wrapped else doc, indent=1))
    got = readers.match_documents(spark, str(tmp_path / "r.json")).orderBy("rank").collect()
    assert [(r.video_id, r["rank"], r.path) for r in got] == [("/a b/v.mp4", 1, "t1.gpx"), ("/a b/v.mp4", 2, "t2.gpx")] and got[1].combined_score is None


def test_files(spark, tmp_path):
    for folder, names in {"u1": ["a_1.mp4", "a_1.gpx"], "u2": ["a_1.mp4"], "x": ["b_2.gpx"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"x" * 2000)
    files = readers.listing(spark, str(tmp_path))
    assert files.count() == 4 and readers.large_enough(files).count() == 4 and readers.owned(files, "u").count() == 3
    assert {r.folder.rsplit("/", 1)[1] for r in readers.orphans(files).collect()} == {"u2", "x"}
    assert sorted(r.served for r in sinks.serving_names(files).collect()) == ["a_1.gpx", "b_2.gpx", "u1_a_1.mp4", "u2_a_1.mp4"]
    assert [(r.prefix, r.files) for r in sinks.prefix_groups(files).collect()] == [("a", 3)]
    assert readers.from_yesterday(files).count() == 0
    assert readers.from_yesterday(files, F.date_add(F.current_date(), 1)).count() == 4
    assert readers.by_age(files, F.col("path").contains("/x/")).first().path.endswith("b_2.gpx")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("v1", 1, [1.0]), ("v1", 2, None), ("v2", 3, [2.0])], "video_id string, n int, box array<double>")
    sinks.write_per_video(df, str(tmp_path / "out"))
    sinks.write_per_video(df.where("video_id = 'v2'"), str(tmp_path / "out"))  # only v2 is written again
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 3 and back.where("n = 1").first().box == "[1.0]"
    m = spark.createDataFrame([("v", 2, "b", 0.1), ("v", 1, "a", 0.9)], "video_id string, rank int, path string, score double")
    assert [x["path"] for x in json.loads(sinks.match_report(m).first().value)["matches"]] == ["a", "b"]
    counts = spark.createDataFrame([("v", "car", 2), ("v", "bus", 1)], "video_id string, object_type string, total_count long")
    assert json.loads(sinks.summary_json(counts).first().summary) == {"total": 3, "by_type": {"bus": 1, "car": 2}}
    assert sinks.combined({"a": m, "b": m.drop("score")}).where("source_name = 'b' and score is null").count() == 2
    good, bad = sinks.rejects(m, F.when(F.col("score") < 0.5, "low"))
    assert good.count() == 1 and bad.first().reason == "low"
    assert json.loads(sinks.synthetic_match(spark.createDataFrame([("v", "t.gpx")], "video_id string, path string")).first().value)["v"]["matches"][0]["quality"] == "synthetic_conversion"


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, processed_at int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 4, "w"), ("c", 1, "n")], "k string, processed_at int, v string")
    assert {r.k: r.v for r in sinks.upserted(old, new, ["k"]).collect()} == {"a": "z", "b": "y", "c": "n"}
    for i, df in enumerate((old, new)):
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    s = streams.arriving(spark, str(tmp_path / "in/*"), "k string, processed_at int, v string", files_per_trigger=1)
    streams.run_batches(s, streams.upsert_sink(spark, str(tmp_path / "t"), ["k"]), str(tmp_path / "cp"))
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()} == {"a": "z", "b": "y", "c": "n"}


def test_tracker_as_stream_and_table(spark, tmp_path):
    rows = [("v", 0, "car", 0.0, 0.0), ("v", 0, "bus", 10.0, 0.0), ("v", 1, "car", 50.0, 0.0), ("v", 2, "car", 500.0, 0.0), ("v", 40, "bus", 10.0, 0.0)]
    schema = "video_id string, frame long, object_class string, x double, y double"
    df = spark.createDataFrame(rows, schema)
    want = {(0, "car"): 0, (0, "bus"): 1, (1, "car"): 0, (2, "car"): 2, (40, "bus"): 3}
    assert {(r.frame, r.object_class): r.object_id for r in streams.tracked_table(df).collect()} == want
    df.where("frame = 0").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    df.where("frame > 0").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    got = streams.available_now(streams.tracked(streams.arriving(spark, str(tmp_path / "in/*"), schema, files_per_trigger=1)), spark)
    assert {(r.frame, r.object_class): r.object_id for r in got.collect()} == want


def test_windows(spark, tmp_path):
    spark.createDataFrame([(f"2024-01-01 00:00:0{s}", 1.0) for s in (0, 0, 1, 9)], "t string, value double").select(F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.arriving(spark, str(tmp_path / "in"), "ts timestamp, value double")
    assert [r.n for r in streams.available_now(streams.half_seconds(s, late="1 second"), spark).orderBy("window.start").collect()] == [2, 1]  # the last is still open


def test_reports(spark):
    state = spark.createDataFrame([("a", "completed"), ("b", "failed"), ("c", "pending")], "path string, status string")
    r = ranking.progress_summary(state).first()
    assert (r.completed, r.failed, r.total, r.remaining, r.success_rate) == (1, 1, 3, 2, 50)
    v = spark.createDataFrame([("valid",), ("corrupted",)], "status string")
    assert ranking.validation_report(v).first().success_rate == 0.5 and ranking.validation_report(v.limit(0)).first().success_rate is None
    runs = spark.createDataFrame([(3, 1, 10.0), (5, 0, 20.0)], "processed int, failed int, seconds double")
    assert tuple(ranking.merged_runs(runs).first()) == (8, 1, 20.0, 1.5)
