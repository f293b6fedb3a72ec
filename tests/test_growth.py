"""Steps whose work must not grow faster than their rows: divisions without decimals, blocks of frames, one look behind instead of many ahead."""

import random

from pyspark.sql import functions as F

from touchline.operators import consolidation as C
from touchline.operators import passes as M
from touchline.operators import shots as O
from touchline.registry_tracking import _looks
from touchline.sources import fixtures as X


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_are_divided_as_whole_numbers(spark):
    frames = [-1_501, -1_500, -1, 0, 149, 150, 1_499, 1_500, 54_000_000]
    orders, nation = spark.createDataFrame([(f,) for f in frames], "o_orderkey long"), spark.range(3).select(F.col("id").cast("int").alias("n_nationkey"))
    for name in ("players", "ball"):
        df = spark.sql(f"WITH {X.spark_views()} SELECT * FROM {name}", orders=orders, nation=nation)
        assert "decimal" not in plan(df).lower()
        assert all(r["run_id"] == r["frame"] // 1_500 for r in df.collect()) and df.count()


def test_pairs_meet_by_blocks_of_frames(spark):
    rnd = random.Random(3)
    rows = [(run, rnd.randrange(-200, 400), rnd.randrange(9)) for run in (1, 2) for _ in range(90)] + [(1, 62, 20), (1, 63, 21), (1, 125, 22), (1, 126, 23), (1, 126, 24), (1, -1, 25), (1, -1, 26), (None, 5, 1), (None, 5, 2), (1, None, 1), (1, None, 2)]
    want = {(r, min(a, b), max(a, b)) for r, f, a in rows for q, g, b in rows if r is not None and f is not None and r == q and f == g and a != b}
    df = C.cooccurring(spark.createDataFrame(rows, "run_id long, frame long, track_id long"))
    assert "Join" not in plan(df)  # of all tracks of a frame with one another
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_looks_that_nobody_asks_for_are_not_moved(spark, tmp_path):
    data = str(tmp_path)
    spark.range(5_000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding")).write.parquet(f"{data}/embeddings.parquet")
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey")).write.parquet(f"{data}/nation.parquet")
    assert sorted(r["vec_id"] for r in _looks(spark, data).collect()) == [*range(25), *range(30, 130)]
    joined = spark.range(10).withColumnRenamed("id", "vec_id").join(_looks(spark, data), "vec_id")
    assert "strategy=broadcast" in plan(joined)


def test_calm_states_are_found_in_one_pass(spark):
    states = spark.createDataFrame([(1, i, float(i), 0.0, v) for i, v in enumerate([1.0, 12.0, 12.0, 5.0, 1.0, 12.0] + [12.0] * 120 + [2.0])], "run_id long, frame long, x double, y double, speed double")
    df = M.speed_envelopes(states)
    assert "currentrow$(), 1, unboundedfollowing" not in plan(df) and ", 1, unboundedfollowing$()" not in plan(df)
    assert [tuple(r) for r in df.collect()] == [(1, 0, 0.0, 0.0, 3, 3.0, 0.0)]


def test_bodies_of_all_frames_are_not_sorted_for_shots(spark):
    states = spark.createDataFrame([(1, f, f / 2.0, 0.0, 9.0) for f in range(100)], "run_id long, frame long, x double, y double, speed double")
    players = spark.createDataFrame([(1, f, 0, "P0", f / 2.0, 0.5) for f in range(100)], "run_id long, frame long, ord long, player_id string, x double, y double")
    moments = spark.createDataFrame([(1, 60, "right")], "run_id long, frame long, goal_side string")
    teams = spark.createDataFrame([("P0", "team_A")], "player_id string, team string")
    df = O.shooters(moments, states, players, teams)
    assert [tuple(r) for r in df.collect()] == [(1, 60, "right", "P0", "team_A", 60)]
    assert "ord" not in plan(df)  # bodies are met once, for the votes and for the last one near
