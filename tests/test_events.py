"""Hand-written cases of ball kinematics, possession, passes and statistics."""

import pytest

from touchline.operators import events as E
from touchline.operators.matches import match_events
from touchline.operators import stats as S
from touchline.plans.presets import TEMPLATE


def ball(spark, rows):
    return spark.createDataFrame([(0, f, float(x), float(y), c) for f, x, y, c in rows], "run_id long, frame long, x double, y double, confidence double")


def players(spark, rows):
    return spark.createDataFrame([(0, f, o, p, float(x), float(y)) for f, o, p, x, y in rows], "run_id long, frame long, ord long, player_id string, x double, y double")


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame([("A", "team_A"), ("B", "team_B"), ("C", "team_A"), ("R", "referee"), ("L", "linesman")], "player_id string, team string")


def test_low_confidence_and_missing_confidence_are_dropped(spark):
    assert [r.frame for r in E.ball_states(ball(spark, [(0, 0, 0, 0.9), (1, 0, 0, 0.14), (2, 0, 0, None), (3, 0, 0, 0.15)])).orderBy("frame").collect()] == [0, 3]


def test_median_smoothing_keeps_the_ends(spark):
    got = E.ball_states(ball(spark, [(0, 0, 0, 0.9), (1, 9, 0, 0.9), (2, 2, 0, 0.9), (3, 7, 0, 0.9)])).orderBy("frame").collect()
    assert [r.x for r in got] == [0.0, 2.0, 7.0, 7.0]


def test_gap_over_a_second_has_no_velocity(spark):
    got = E.ball_states(ball(spark, [(0, 0, 0, 0.9), (26, 1, 0, 0.9)])).orderBy("frame").collect()
    assert got[1].vx is None and got[1].speed == 0.0


def test_nearest_tie_goes_to_the_lowest_ord_and_referees_never_count(spark, teams):
    states = E.ball_states(ball(spark, [(0, 0, 0, 0.9)]))
    near = E.nearest_player(states, players(spark, [(0, 2, "A", 1, 0), (0, 1, "B", -1, 0), (0, 0, "R", 0, 0)]), teams).first()
    assert near.player_id == "B" and near.distance == 1.0
    assert E.nearest_player(states, players(spark, [(0, 0, "L", 0.5, 0)]), teams).first().player_id == "L"
    assert E.nearest_player(states, players(spark, [(1, 0, "A", 0, 0)]), teams).first().player_id is None


def test_span_survives_missing_ball_frames_and_passes_bridge_spans(spark, teams):
    b = [(f, 0, 0, 0.9) for f in range(0, 20) if f not in (5, 6)] + [(f, (f - 19) * 0.4, 0, 0.9) for f in range(20, 45)] + [(f, 10, 0, 0.9) for f in range(45, 65)]
    p = [(f, 0, "A", 0, 0) for f in range(65)] + [(f, 1, "C", 10, 0) for f in range(65)]
    states = E.ball_states(ball(spark, b))
    spans = E.possession_spans(E.nearest_player(states, players(spark, p), teams))
    assert [(r.player_id, r.start_frame) for r in spans.orderBy("span_id").collect()][0] == ("A", 0)
    got = E.bridge_passes(spans, states).collect()
    assert [(r.player_id, r.receiver_id, r.outcome) for r in got] == [("A", "C", "successful")]


def test_crossing_needs_the_ball_strictly_outside(spark):
    rows = [(0, 50, 1, 0.9), (1, 51.5, 1, 0.9), (2, 52.5, 1, 0.9), (3, 53.0, 1, 0.9), (4, 53.4, 1, 0.9)]
    got = E.goal_line_crossings(E.ball_states(ball(spark, rows))).collect()
    assert len(got) == 1 and got[0].goal_side == "right" and got[0].is_goal


def test_heatmap_right_edge_is_closed_and_outliers_drop(spark):
    got = S.heatmap(players(spark, [(0, 0, "A", 52.5, 34.0), (1, 0, "A", 52.6, 0)])).collect()
    assert [(r.bin_x, r.bin_y, r.n) for r in got] == [(39, 39, 1)]


def test_presence_runs_split_past_a_second(spark):
    got = S.presence_runs(players(spark, [(f, 0, "A", 0, 0) for f in (0, 25, 51)])).orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == [(0, 25), (51, 51)]


def test_teleports_do_not_count_as_distance(spark):
    got = S.player_kinematics(players(spark, [(0, 0, "A", 0, 0), (1, 0, "A", 0.4, 0), (2, 0, "A", 30, 0)])).first()
    assert (got.observed_frames, got.distance_m, got.max_speed_mps) == (3, 0.4, 10.0)


def test_empty_tables(spark, teams):
    assert match_events(ball(spark, []), players(spark, []), teams, TEMPLATE).count() == 0
