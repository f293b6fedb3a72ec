"""The scan for flights against one state at a time; passers, receivers and cover on rows with a known answer."""

import random

from touchline.operators import passes as M


def scanned(rows, reach=100, slow=7.0, fast=10.0):
    """(start, settle) frames of rows (frame, speed), looked at one by one."""
    out, i = [], 1
    while i < len(rows):
        start = rows[i - 1][0]
        if not (rows[i - 1][1] <= slow and rows[i][1] >= fast):
            i += 1
            continue
        for j in range(i, len(rows) + 1):
            if j == len(rows) or rows[j][0] > start + reach:
                i = j + 1
                break
            if j > i and rows[j][1] <= slow:
                out.append((start, rows[j][0]))
                i = j + 1
                break
    return out


def test_flights_equal_a_plain_scan(spark):
    rng, rows, want = random.Random(3), [], set()
    for run in range(40):
        frame, own = 0, []
        for _ in range(120):
            frame += rng.choice([1, 1, 2, 7, 60, 130] if run % 3 else [1, 2])
            own.append((frame, rng.choice([0.0, 5.0, 7.0, 7.5, 9.0, 10.0, 12.0, 20.0] if run % 2 else [3.0, 15.0, 15.0, 15.0, 15.0, 15.0, 9.0])))
        rows += [(run, f, float(f), -float(f), s) for f, s in own]
        want |= {(run, *e) for e in scanned(own)}
    df = spark.createDataFrame(rows, "run_id long, frame long, x double, y double, speed double").repartition(3)
    got = M.speed_envelopes(df).collect()
    assert {(r.run_id, r.frame, r.settle_frame) for r in got} == want and len(got) == len(want) > 300
    assert all(r.x == r.frame and r.settle_y == -r.settle_frame for r in got)
    assert M.speed_envelopes(df.where("false")).collect() == []


def test_transition_passes(spark):
    flight = lambda at: [(at + i, 5.0) for i in range(5)] + [(at + 5 + i, 15.0) for i in range(10)] + [(at + 15 + i, 2.0) for i in range(20)]
    states = spark.createDataFrame([(1, f, float(f), 0.0, s) for at in (0, 100, 200, 300) for f, s in flight(at)], "run_id long, frame long, x double, y double, speed double")
    near = []
    for at, passer, receiver in ((0, "a", "b"), (100, "a", "a"), (200, "a", "c"), (300, None, "b")):
        near += [(1, at + i, passer, "A", 0.5) for i in range(4)] + [(1, at + 4, "x", "B", 1.1)] + [(1, at + 16, "x", "B", 2.1), (1, at + 17, receiver, "A" if receiver == "b" else "B", 2.0), (1, at + 18, "late", "A", 0.1)]
    near = spark.createDataFrame(near, "run_id long, frame long, player_id string, team string, distance double")
    none = "run_id long, frame long, player_id string, team string, receiver_id string, receiver_team string, end_frame long, x double, y double, end_x double, end_y double, pass_length double, outcome string"
    got = M.transition_passes(states, near, spark.createDataFrame([], none)).orderBy("frame").collect()
    assert [(r.frame, r.player_id, r.receiver_id, r.end_frame, r.outcome, r.pass_length, r.receive_frame) for r in got] == [(4, "a", "b", 15, "successful", 11.0, 17), (204, "a", "c", 215, "failed", 11.0, 217)]
    bridge = spark.createDataFrame([(1, 216, "a", "A", "d", "A", 230, 0.0, 0.0, 3.0, 4.0, 5.0, "successful"), (1, 400, "e", "A", "e", "A", 410, 0.0, 0.0, 3.0, 4.0, 5.0, "successful"), (2, 4, "a", "A", "d", "A", 30, 0.0, 0.0, 3.0, 4.0, 5.0, "successful")], none)
    both = M.all_passes(states, near, bridge).orderBy("run_id", "frame").collect()
    assert [(r.run_id, r.frame, r.source, r.confidence, r.event_id) for r in both] == [(1, 4, "speed_transition", 0.9, "pass_0001"), (1, 216, "possession_bridge", 1.0, "pass_0002"), (2, 4, "possession_bridge", 1.0, "pass_0001")]
