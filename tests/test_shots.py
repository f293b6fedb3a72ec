"""Shots near the line, outcomes, holders and audits on rows with a known answer."""

from touchline.operators import audits, events, shots


def states(spark, rows):
    return spark.createDataFrame([(1, f, float(x), float(y)) for f, x, y in rows], "run_id long, frame long, x double, y double")


def found(spark, rows):
    return [(r.frame, r.goal_side) for r in shots.approach_shots(states(spark, rows)).orderBy("frame").collect()]


def test_fast_approach_is_a_shot_if_the_ball_is_lost_or_turns_back(spark):
    run_up = [(f, 45 + f * 0.4, 1) for f in range(13)]  # 10 m/s, 49.8 m at frame 12
    after = [(60 + f, 0, 0) for f in range(3)]
    assert (12, "right") in found(spark, run_up + after)
    assert (12, "left") in found(spark, [(f, -x, y) for f, x, y in run_up + after])
    stays = [(13 + f, 49.8 + f * 0.001, 1) for f in range(40)]
    assert found(spark, run_up + stays) == []
    back = [(13, 49.0, 1)] + [(14 + f, 48.0 - f, 1) for f in range(40)]
    assert found(spark, run_up + back) == [(12, "right")]


def test_slow_approach_needs_four_steps_and_a_long_loss(spark):
    slow = [(f, 49.0 + f * 0.12, 0) for f in range(8)]  # 3 m/s
    assert found(spark, slow + [(7 + 126, 0, 0), (7 + 127, 0.1, 0)]) != []
    assert found(spark, slow + [(7 + 60, 0, 0), (7 + 61, 0.1, 0)]) == []
    assert found(spark, [(0, 49.5, 0), (1, 49.3, 0), (2, 49.4, 0), (3, 49.55, 0), (200, 0, 0), (201, 0, 0)]) == []
    assert found(spark, slow[:1]) == []


def test_outcomes(spark):
    ball = states(spark, [(f, 46 + f * 0.5, 0) for f in range(13)])
    rows = [(1, 13, "right", 1.0, 1.0), (1, 13, "right", 1.0, 4.0), (1, 13, "right", 5.0, 1.0), (1, 13, "left", 0.0, 0.0), (1, 300, "right", 0.0, 0.0)]
    given = spark.createDataFrame(rows, "run_id long, frame long, goal_side string, cross_y double, cross_height double")
    got = sorted((r.cross_y, r.cross_height, r.outcome) for r in shots.shot_outcomes(given, ball).collect())
    assert got == [(1.0, 1.0, "goal"), (1.0, 4.0, "off_target"), (5.0, 1.0, "off_target")]


def test_holders_vote_and_nobody(spark):
    near = spark.createDataFrame([(1, f, "a" if f < 20 else "b", "team_A", 0.5) for f in range(10, 26)] + [(1, 24, None, None, None)], "run_id long, frame long, player_id string, team string, distance double")
    kicks = spark.createDataFrame([(1, 25), (1, 900)], "run_id long, frame long")
    got = {r.frame: r.player_id for r in shots.kick_holders(kicks, near, 1.0, 1.0).collect()}
    weights = {p: sum(0.1 + 0.9 * f / 25 for f in range(10, 26) if (f < 20) == (p == "a")) for p in "ab"}
    assert got == {25: max(weights, key=weights.get), 900: None}


def test_unknown_ends_of_passes_stay(spark):
    rows = spark.createDataFrame([(1, 5, "a", "a"), (1, 6, None, None), (1, 7, "a", None), (1, 8, "a", "b")], "run_id long, frame long, player_id string, receiver_id string")
    assert sorted((r.frame, r.event_id) for r in shots.without_self_passes(rows).collect()) == [(6, "pass_0001"), (7, "pass_0002"), (8, "pass_0003")]


def test_lonely_groups_and_few_frames(spark):
    rows = spark.createDataFrame([(1, 1, "unknown", None, [1]), (1, 2, "unknown", "linesman", [2]), (1, 3, None, None, [3]), (1, 4, "unknown", None, [4, 5]), (1, 5, "unknown", "player", None)], "run_id long, cluster long, team string, role string, tracks array<long>")
    assert sorted(r.cluster for r in audits.without_lonely(rows).collect()) == [2, 3, 4]
    frames = lambda n: spark.createDataFrame([(1, f) for f in range(n)], "run_id long, frame long")
    assert audits.candidate_frames(frames(1)).count() == 1
    assert [r.frame for r in audits.candidate_frames(frames(100), 3).orderBy("frame").collect()] == [5, 35, 65]


def match(spark, ball, players, teams):
    b = spark.createDataFrame([(1, f, float(x), float(y), c, h) for f, x, y, c, h in ball], "run_id long, frame long, x double, y double, confidence double, height double")
    p = spark.createDataFrame([(1, f, o, n, float(x), float(y)) for f, o, n, x, y in players], "run_id long, frame long, ord long, player_id string, x double, y double")
    t = spark.createDataFrame(teams, "player_id string, team string")
    return events.ball_states(b), b, p, t


TEAMS = [("striker", "team_A"), ("late", "team_B"), ("keeper", "team_B"), ("ref", "referee")]


def kick_at_goal(y=0.0, height=0.0):
    """The striker walks with the ball to x = 45 until frame 60; then it flies over the line at 20 m/s."""
    ball = [(f, 45 - (60 - f) * 0.1, 0, 0.9, 0.0) for f in range(61)] + [(60 + i, 45 + 0.8 * i, y * i / 10, 0.5, height) for i in range(1, 13)]
    players = [(f, 0, "striker", min(45.0, 45 - (60 - f) * 0.1) + 0.5, 0.3) for f in range(73)] + [(f, 1, "late", 48, 0.4) for f in range(73)] + [(f, 2, "keeper", 51, 0) for f in range(73)]
    return ball, players + [(f, 3, "ref", 45, 0) for f in range(73)]


def test_a_goal_has_its_shooter(spark):
    ball, players = kick_at_goal()
    got = shots.detected_shots(*match(spark, ball, players, TEAMS)).orderBy("type").collect()
    assert [(r.type, r.player_id, r.team, r.outcome, r.goal_side, r.approach) for r in got] == [("goal", "striker", "team_A", "Goal", "right", False), ("shot", "striker", "team_A", "Goal", "right", False)]
    assert got[0].frame == 69 and got[0].confidence == 0.5 and 58 <= got[0].shooter_frame <= 60 and got[0].start_x is not None
    for y, height in ((6.0, 0.0), (0.0, 3.2)):
        ball, players = kick_at_goal(y, height)
        assert [(r.type, r.outcome) for r in shots.detected_shots(*match(spark, ball, players, TEAMS)).collect()] == [("shot", "Off_Target")]
    assert [r.outcome for r in shots.detected_shots(*match(spark, *kick_at_goal(0.0, 2.9), TEAMS)).where("type = 'shot'").collect()] == ["Goal"]


def test_a_shooter_from_afar_or_none(spark):
    ball, players = kick_at_goal()
    far = [(f, o, n, x - 2 if n == "striker" else x, y + 9 if n == "late" else y) for f, o, n, x, y in players]
    got = shots.detected_shots(*match(spark, ball, far, TEAMS)).where("type = 'shot'").first()
    assert got.player_id == "striker"  # nobody within a metre: the last within three
    got = shots.detected_shots(*match(spark, ball, [p for p in players if p[2] in ("keeper", "ref")], TEAMS)).where("type = 'shot'").first()
    assert got.player_id is None and got.shooter_frame == got.frame
    own = spark.createDataFrame([(1, 20), (1, 40), (1, 900)], "run_id long, frame long")
    slow = [(f, 40 + f * 0.35, 0, 0.9, 0.0) for f in range(45)]  # 8.75 m/s from the start: no slow state before it
    states, b, p, t = match(spark, slow, [(f, 0, "striker", 40 + f * 0.35, 0.2) for f in range(45)], TEAMS)
    moments = spark.createDataFrame([(1, 36, "right")], "run_id long, frame long, goal_side string")
    assert shots.shooters(moments, states, p, t).first().shooter_frame == 36
    assert shots.shooters(moments, states, p, t, kicks=own).first().shooter_frame == 20


def test_near_shots_are_one(spark):
    ball, players = kick_at_goal()
    again = [(f + 40, x, y, 0.8 if f > 60 else c, h) for f, x, y, c, h in ball if f > 40]
    states, b, p, t = match(spark, [r for r in ball if r[0] <= 72] + [r for r in again if r[0] > 81], players, TEAMS)
    got = shots.detected_shots(states, b, p, t).where("type = 'shot'").collect()
    assert len(got) == 1 and got[0].frame > 100 and got[0].confidence > 0.6
    assert shots.detected_shots(states.where("false"), b.where("false"), p, t).collect() == []


def test_a_crossing_has_the_confidence_of_its_own_step(spark):
    """In a flight of equal steps too: the SQL takes the step after it for another crossing, of greater confidence."""
    ball = [(f, 45.25 + f * 0.5, 0, 0.25 + f / 64, 0.0) for f in range(20)]  # over the line from 14, 52.25 m, to 15
    ball = [(f + 1, *rest) for f, *rest in ball]  # half a frame after 15 counts as 16, at which the next step starts
    states, b, p, t = match(spark, ball, [(f, 0, "striker", 45, 0.2) for f in range(20)], TEAMS)
    assert states.where("frame IN (16, 17)").select("speed").distinct().count() == 1
    got = shots.detected_shots(states, b, p, t).collect()
    assert [(r.type, r.frame, r.confidence) for r in sorted(got, key=lambda r: r.type)] == [(k, 16, 0.25 + 14.5 / 64) for k in ("goal", "shot")]
