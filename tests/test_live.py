"""Running speed and carrier: known cases, and a stream in three parts against the table."""

import pytest

from touchline.streaming import live


def streamed(spark, rows, function, folder, cuts):
    """Rows of function over rows as a stream, a file for each range of frames, in order."""
    low = -1
    for k, high in enumerate([*cuts, 1 << 40]):
        rows.where(f"frame > {low} AND frame <= {high}").coalesce(1).write.mode("append").parquet(folder)
        low = high
        import time

        time.sleep(1.1)  # files are taken by time
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = function(stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", folder + "-state").start()
    query.processAllAvailable()
    query.stop()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= len(cuts)
    return spark.table("live").collect()


@pytest.fixture(scope="module")
def sightings(spark):
    rows = [(1, 1, f, 0.2 * f, 0.0) for f in range(10)] + [(1, 1, f, 2.0 * f, 0.0) for f in range(36, 60)] + [(1, 2, f, 0.1 * f * f, 1.0) for f in range(0, 60, 2)] + [(2, 1, 5, 1.0, 1.0), (1, 3, 7, None, 1.0)]
    return spark.createDataFrame(rows, "run_id long, track_id long, frame long, x double, y double").repartition(3)


def test_running_speeds(spark, sightings, tmp_path):
    got = {(r.run_id, r.track_id, r.frame): r.speed for r in live.running_speeds(sightings).collect()}
    assert got[1, 1, 0] is None and got[1, 1, 1] == pytest.approx(5.0) and got[1, 1, 9] == pytest.approx(5.0)
    assert got[1, 1, 36] is None and got[1, 1, 37] == 15.0 and got[2, 1, 5] is None  # a new start after 27 frames; 50 m/s are cut
    assert got[1, 2, 2] == pytest.approx(5.0) and got[1, 2, 4] == pytest.approx(0.4 * 10.0 + 0.6 * 5.0) and (1, 3, 7) not in got
    rows = streamed(spark, sightings, live.running_speeds, f"file://{tmp_path}/speeds", [8, 40])
    assert {(r.run_id, r.track_id, r.frame): r.speed for r in rows} == got


def test_carriers(spark, tmp_path):
    near = "aaaaaa-aabbbbabbbbbbb"
    rows = spark.createDataFrame([(1, f, None if c == "-" else c) for f, c in enumerate(near)] + [(2, 0, "z")], "run_id long, frame long, player_id string").repartition(2)
    got = {(r.run_id, r.frame): r.carrier for r in live.carriers(rows).collect()}
    want = [None] * 4 + ["a", "a"] + [None] * 12 + ["b"] * 3
    # After the gap a and b both start to count anew, each time another is nearest.
    assert [got[1, f] for f in range(len(near))] == want and got[2, 0] is None
    assert {(r.run_id, r.frame): r.carrier for r in streamed(spark, rows, live.carriers, f"file://{tmp_path}/carriers", [4, 12])} == got


def test_nearest_carriers(spark):
    frames = spark.createDataFrame([(1, f) for f in range(4)], "run_id long, frame long")
    ball = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 0.0, 0.0)], "run_id long, frame long, x double, y double")
    players = spark.createDataFrame([(1, 0, 2, "b", 1.0, 0.0), (1, 0, 1, "a", -1.0, 0.0), (1, 0, 0, "keeper", 0.1, 0.0), (1, 1, 3, "ref", 0.0, 0.0), (1, 2, 1, "a", 2.1, 0.0), (1, 3, 1, "a", 0.0, 0.0)], "run_id long, frame long, ord long, player_id string, x double, y double")
    teams = spark.createDataFrame([("a", "team_A", None), ("b", "team_B", "player"), ("keeper", "team_A", "goalkeeper"), ("ref", "referee", None)], "player_id string, team string, role string")
    assert {r.frame: r.player_id for r in live.nearest_carriers(frames, ball, players, teams).collect()} == {0: "a", 1: None, 2: None, 3: None}


def test_keys_start_anew_in_any_deal(spark):
    """A null run is a key too, rows come from several parts, and no state is left over from one key to the next."""
    rows = [(run, f, "a") for run in (None, 1, 2, 3) for f in range(7)]
    near = spark.createDataFrame(rows, "run_id long, frame long, player_id string")
    for dealt in (near.repartition(5), near.coalesce(1), near.repartition(2, "run_id")):
        got = {(r.run_id, r.frame): r.carrier for r in live.carriers(dealt).collect()}
        assert got == {(run, f): None if f < 4 else "a" for run, f, _ in rows}
