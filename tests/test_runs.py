"""Run folders read and written, detectors added, sizes resolved, sightings streamed."""

import json

import pytest
from pyspark.sql import functions as F

from touchline import engine
from touchline.sources import runs
from touchline.streaming.presence import presence_sessions


@pytest.fixture
def folder(tmp_path):
    def put(name, value):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(value))

    put("tracking/tracks.json", {"3": [{"track_id": 7, "bbox": [0, 1, 2, 3], "confidence": 0.5, "pitch_position": [1.5, -2.0]}, {"track_id": 8, "bbox": [0, 0, 1, 1], "confidence": 0.4}]})
    put("tracking/ball_tracks.json", {"3": {"confidence": 0.9, "pitch_position": [1.0, 2.0], "height": 0.2}, "4": {"confidence": 0.3}})
    return str(tmp_path), put


def test_raw_tracks_are_read_where_no_others_are(spark, folder):
    path, put = folder
    got = runs.read_tracks(spark, path, "m").orderBy("ord").collect()
    assert [(r.run_id, r.frame, r.ord, r.player_id, r.x, r.y2) for r in got] == [("m", 3, 0, "7", 1.5, 3.0), ("m", 3, 1, "8", None, 1.0)]
    put("track_consolidation/tracks.json", {"5": [{"track_id": "A-9", "player_id": "A-9", "bbox": [0, 0, 1, 1], "team": "team_A", "jersey_number": 9}]})
    put("track_consolidation/team_assignments.json", {"A-9": "team_A"})
    assert [(r.player_id, r.jersey_number) for r in runs.read_tracks(spark, path, "m").collect()] == [("A-9", 9)]
    assert [r.player_id for r in runs.read_tracks(spark, path, "m", prefer="tracking").orderBy("ord").collect()] == ["7", "8"]
    context = runs.match_context(spark, path, "m")
    assert [tuple(r) for r in context["teams"].collect()] == [("A-9", "team_A")] and context["events"].count() == 0
    assert [(r.frame, r.x, r.height) for r in context["ball"].orderBy("frame").collect()] == [(3, 1.0, 0.2), (4, None, None)]


def test_a_run_without_tracks_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        runs.match_context(spark, str(tmp_path), "m")


def test_events_are_read_as_written(spark, folder):
    path, _ = folder
    rows = [("goal_0001", "goal", 10, 0.40049, "A-9", [1.006, 2.0], 0.87654), ("pass_0001", "pass", 4, 0.16, None, None, 1.0)]
    events = spark.createDataFrame(rows, "event_id string, type string, frame long, match_time double, player_id string, start_position array<double>, confidence double")
    runs.write_events(events, path)
    got = {r.event_id: r for r in runs.read_events(spark, path, "m").collect()}
    assert got["goal_0001"].match_time == 0.4 and got["goal_0001"].start_position == [1.01, 2.0] and got["goal_0001"].confidence == 0.877
    lines = [json.loads(x.value) for x in spark.read.text(f"{path}/event_detection/events.json").collect()]
    assert all("player_id" not in x for x in lines if x["type"] == "pass")
    assert spark.read.json(f"{path}/event_detection/goals.json").count() == 1


def test_sizes():
    assert runs.resolve_sizes() == runs.DEFAULT_SIZES
    got = runs.resolve_sizes({"goal_length": 5}, {"pitch_type": "small", "pitch": {"pitch_width": 40}}, {"small": {"pitch_length": 60, "pitch_width": 45}}, {"goal_height": 2})
    assert got == {"pitch_length": 60.0, "pitch_width": 40.0, "goal_length": 5.0, "goal_height": 2.0}


def test_an_added_detector_is_run(spark):
    ball = spark.createDataFrame([(0, f, 0.0, 0.0, 0.9) for f in range(20)], "run_id long, frame long, x double, y double, confidence double")
    players = spark.createDataFrame([(0, f, 0, "A", 0.0, 0.0) for f in range(20)], "run_id long, frame long, ord long, player_id string, x double, y double")
    teams = spark.createDataFrame([("A", "team_A")], "player_id string, team string")
    try:
        engine.detector("kickoff")(lambda t, p: t["states"].groupBy("run_id").agg(F.min("frame").alias("frame")).withColumn("type", F.lit("kickoff")))
        got = engine.detect_events({"ball": ball, "players": players, "teams": teams})
        assert {(r.type, r.frame, r.player_id) for r in got.collect()} == {("possession", 0, "A"), ("kickoff", 0, None)}
        with pytest.raises(KeyError):
            engine.detect_events({"ball": ball, "players": players, "teams": teams}, names=("none",))
    finally:
        engine._DETECTORS.pop("kickoff", None)


def test_presence_over_a_stream(spark, tmp_path):
    rows = [("A", "2026-01-01 10:00:00"), ("A", "2026-01-01 10:00:00.5"), ("A", "2026-01-01 10:00:05"), ("B", "2026-01-01 10:00:00"), ("B", "2026-01-01 10:02:00")]
    table = spark.createDataFrame(rows, "player_id string, at string").select("player_id", F.to_timestamp("at").alias("ts"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = presence_sessions(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("presence").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    closed = {(r.player_id, r.n) for r in spark.table("presence").collect()}
    assert closed == {("A", 2), ("A", 1), ("B", 1)}  # the last sighting's stretch is still open
    assert sorted((r.player_id, r.n) for r in presence_sessions(table).collect()) == [("A", 1), ("A", 2), ("B", 1), ("B", 1)]
