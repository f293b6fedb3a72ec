"""Rules that queries once had wrong, each on a few rows."""

from pyspark.sql import functions as F

from touchline.operators import detections as B
from touchline.operators import stats as S
from touchline.operators import timelines as L
from touchline.operators import tracks as T
from touchline.sources import runs


def test_two_runs_may_share_track_ids(spark):
    tracks = spark.createDataFrame([(1, 5, 0), (2, 5, 0), (2, 6, 0)], "run_id long, track_id long, frame long")
    mapping = spark.createDataFrame([(1, 5, "A-9", "team_A", "player"), (2, 5, "B-1", "team_B", "goalkeeper")], "run_id long, track_id long, player_id string, team string, role string")
    got = {(r.run_id, r.track_id): (r.player_id, r.team, r.role) for r in runs.consolidated(tracks, mapping).collect()}
    assert got == {(1, 5): ("A-9", "team_A", "player"), (2, 5): ("B-1", "team_B", "goalkeeper"), (2, 6): ("unmapped-6", "unknown", "other")}


def test_rows_without_a_place_are_at_the_edge(spark):
    rows = [(1, f, "a", None if f % 2 else 0.0, None if f % 2 else 0.0) for f in range(10)] + [(1, f, "b", 49.6 if f == 0 else 49.5, 31.0) for f in range(3)]
    got = {r.player_id: r.edge_share for r in S.track_summary(spark.createDataFrame(rows, "run_id long, frame long, player_id string, x double, y double")).collect()}
    assert got == {"a": 0.5, "b": 0.333}


def test_totals_by_stage(spark):
    h = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(1, 0, 0, 0.9, 0, 0, 40, 60), (1, 0, 0, 0.2, 0, 0, 40, 60), (1, 1, 0, 0.9, 0, 0, 40, 10), (1, 1, 0, 0.9, 500, 0, 540, 60), (1, 2, 32, 0.9, 0, 0, 9, 9), (2, 0, 5, 0.9, 0, 0, 9, 9)]
    df = spark.createDataFrame(rows, "run_id long, frame long, class int, confidence double, x1 long, y1 long, x2 long, y2 long").select("*", *(F.col(c).cast("double").alias(f"_{c}") for c in ("x1",)))
    got = {tuple(r) for r in B.stage_totals(df.drop("_x1"), h).select("run_id", "n_frames", "raw_players", "raw_balls", "post_conf_players", "post_size_players", "post_pitch_players").collect()}
    assert got == {(1, 3, 4, 1, 3, 2, 0), (2, 1, 0, 0, 0, 0, 0)}


def test_each_of_three_triggers_asks_for_an_anchor(spark):
    still, far = ([1.0, 0.0, shift, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0] for shift in (0.0, 60.0))
    rows = [(1, 0, still, 0.9), (1, 1, far, 0.9), (2, 0, still, 0.9), (2, 1, still, 0.2), (2, 2, still, 0.9), (3, 0, still, 0.3), (3, 1, still, 0.3), (3, 2, still, 0.3)]
    df = spark.createDataFrame(rows, "run_id long, frame long, h array<double>, inlier_ratio double")
    assert {tuple(r) for r in L.reanchor_frames(df).collect()} == {(1, 1), (2, 1), (3, 2)}


def test_a_ball_that_nobody_is_near_has_its_own_box(spark):
    balls = spark.createDataFrame([(1, 0, 100.0, 100.0, 110.0, 110.0), (1, 1, 100.0, 100.0, 110.0, 110.0)], "run_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    people = spark.createDataFrame([(1, 0, 4, 0, 90.0, 20.0, 120.0, 120.0), (1, 1, 4, 0, 600.0, 20.0, 620.0, 120.0)], "run_id long, frame long, ord long, class int, x1 double, y1 double, x2 double, y2 double")
    got = {r.frame: (r.kind, r.ord, r.x1, r.y2) for r in B.image_holders(balls, people).collect()}
    assert got == {0: ("player", 4, 90.0, 120.0), 1: ("ball", None, 100.0, 110.0)}


def test_outliers_go(spark):
    df = spark.createDataFrame([(1, f, float(f) + (9.0 if f == 3 else 0.0), 0.0) for f in range(6)], "run_id long, frame long, x double, y double")
    assert [r.frame for r in T.without_outliers(df).orderBy("frame").collect()] == [0, 1, 2, 4, 5]


def test_stored_tables_can_be_removed():
    import os
    import subprocess
    import sys

    code = "import os, tempfile; from pyspark.sql import SparkSession; from touchline.plans import staging as s; d = tempfile.mkdtemp(); spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://' + d).getOrCreate(); a, b = (s.stored(spark.range(n), 'x') for n in (3, 4)); held = lambda: sum(n.startswith('touchline') for n in os.listdir(d)); assert a.count() + b.count() == 7 and held() == 2; assert s.release(spark) == 2 and held() == 0 and s.release(spark) == 0; spark.stop()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, timeout=240).returncode == 0
