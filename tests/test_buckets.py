"""The match tables are bucketed by run, so that plans within runs and frames move no rows."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from touchline.operators import assignment as A
from touchline.operators import tracker as K
from touchline.plans import staging
from touchline.registry import QUERIES
from touchline.registry_tracking import detections
from touchline.sources.fixtures import match_tables
from touchline.streaming import live

DATA = "/root/testdata/sf0.001"


def exchanges(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return [line for line in out.getvalue().splitlines() if "Exchange hash" in line or "REPARTITION" in line]


@pytest.mark.parametrize("name", ["pair_costs", "cooccurring_pairs", "speed_envelopes", "ever_confirmed", "spread_sample", "referee_check"])
def test_nothing_is_shuffled(spark, name, monkeypatch):
    monkeypatch.setattr("touchline.sources.fixtures._STORED", {})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, DATA)
        joined = [e for e in exchanges(df) if "run_id" in e]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined == []


def test_embeddings_stay_where_they_are(spark, monkeypatch):
    """The tracker's boxes and embeddings, and the pairs that an assignment would never choose, are not shuffled."""
    monkeypatch.setattr("touchline.sources.fixtures._STORED", {})
    boxes, frames = detections(spark, DATA), match_tables(spark, DATA)["ball"].select("run_id", "frame")
    assert not [e for e in exchanges(K.tracked(boxes)) if "run_id" in e]
    assert "RepartitionByExpression" not in K.tracked(boxes, frames)._jdf.queryExecution().optimizedPlan().toString()
    pairs = spark.createDataFrame([(1, 1, 1, 1, 0.2, True), (1, 1, 2, 1, 0.9, True)], "run_id long, frame long, track_id long, ord long, iou_cost double, allowed boolean")
    assert "(iou_cost#" in (plan := A.assignments(pairs, "iou_cost", 0.7)._jdf.queryExecution().optimizedPlan().toString()) and "< 0.7)" in plan


def test_a_run_lies_in_one_file(spark):
    players = match_tables(spark, "/root/testdata/sf0.01")["players"]
    files = players.select("run_id", F.input_file_name().alias("file")).distinct().groupBy("run_id").count()
    assert files.count() == 10 and files.where("count <> 1").count() == 0


def test_release_drops_the_tables(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("run_id"), F.col("id").alias("frame")).repartition(4, "run_id")
    before = dict(staging._PATHS), dict(staging._TABLES)
    staging._PATHS.clear(), staging._TABLES.clear()
    try:
        name = staging.stored_by_run(df, "some", 4)
        assert name.count() == 40 and len(spark.catalog.listTables()) >= 1
        stored = staging._TABLES[spark.sparkContext.applicationId][0]
        assert staging.release(spark) == 1 and not spark.catalog.tableExists(stored)
    finally:
        staging._PATHS.update(before[0]), staging._TABLES.update(before[1])


def test_spans_of_carries_are_computed_once(spark):
    plan = QUERIES["carries"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "confidence" not in plan  # of the ball, from which spans are told


def test_states_are_carried_where_the_runs_lie(spark, monkeypatch):
    """Neither bodies nor frames are shuffled for running speeds and carriers; teams are asked only about bodies near the ball."""
    monkeypatch.setattr("touchline.sources.fixtures._STORED", {})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = match_tables(spark, DATA)
        near = lambda teams: live.nearest_carriers(t["players"].select("run_id", "frame"), t["ball"], t["players"], teams)
        assert exchanges(QUERIES["running_speeds"](spark, DATA)) == []
        assert exchanges(live.carriers(near(F.broadcast(t["teams"])))) == []
        joins = [line for line in near(t["teams"])._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
        assert len(joins) == 2 and "<= 2.0" in joins[1]  # the distance is asked below the team
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
