"""Queries over shots, kicks, missed detections and frames to look at again, and their SQL; registry.py takes them in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import cameras as C
from .operators import audits as A
from .operators import duels as D
from .operators import events as E
from .operators import shots as H


def _lost_states(t):
    """Ball states without those of the two frames before, and the 40 after, the ball has passed a goal line."""
    return E.ball_states(t["ball"]).where("frame % 900 BETWEEN 40 AND 897")


def _frames(t):
    return t["players"].select("run_id", "frame").distinct()


def _cameras(t):
    f = F.col("frame")
    number = lambda skip, times, range_, less: F.when(f % skip != 0, (f * times % range_ - less).cast("double"))
    return _frames(t).select("run_id", "frame", number(11, 29, 25_000, 0).alias("focal"), number(13, 7, 600, 300).alias("cx"), number(13, 3, 560, 280).alias("cy"), number(13, 5, 240, 120).alias("cz"))


def _sure(t):
    return t["players"].withColumn("confidence", (F.col("frame") * 7 + F.col("ord") * 13) % 100 / 100.0)


def _holders(t):
    spans = _spans(t)
    return spans.select("run_id", F.col("start_frame").alias("frame"), "player_id", F.lead("player_id").over(Window.partitionBy("run_id").orderBy("start_frame")).alias("receiver_id"))


def _near(t):
    return E.nearest_player(E.ball_states(t["ball"]), t["players"], t["teams"])


def _spans(t):
    return E.possession_spans(_near(t))


def _groups(t):
    rows = t["players"].groupBy("run_id", (F.col("ord") % 14).alias("cluster")).agg(F.collect_set("ord").alias("tracks"))
    return rows.withColumn("team", F.when(F.col("cluster").isin(0, 11, 12, 13), "unknown").otherwise("team_A")).withColumn("role", F.when(F.col("cluster") == 11, "goalkeeper"))


def _labelled(t):
    f, o = F.col("frame"), F.col("ord")
    return t["players"].select("run_id", o.alias("track_id"), "frame", F.when(f % 4 != 0, (f * 3 + o) % 6).alias("jersey"), F.when((f + o) % 5 != 0, F.when((f * o) % 3 == 0, "team_A").otherwise("team_B")).alias("team"))


def _references(t):
    rows = t["players"].where("ord < 8").select("run_id", "ord").distinct()
    return rows.select("run_id", F.when(F.col("ord") % 2 == 0, "team_A").otherwise("team_B").alias("team"), (F.col("ord") * 3 % 8).alias("place"), F.col("ord").alias("track_id"))


LENS, VIEW = (0.05, -0.01, 0.001, -0.0005, 0.002), (1500.0, 1500.0, 960.0, 540.0)


def _posed(t):
    """Ball rows with a made-up camera each: rotation r0 to r8 and translation m0 to m2, each step a projection of its own, so that expressions stay small."""
    f = F.col("frame")
    rows = t["ball"].select("run_id", "frame", "x", "y", (1.2 + f % 7 / 50.0).alias("v0"), ((f % 5 - 2) / 10.0).alias("v1"), (f % 3 / 20.0 + 0.01).alias("v2"))
    turned = C.rotation_of_vector([F.col(f"v{i}") for i in range(3)])
    rows = rows.select("run_id", "frame", "x", "y", *(c.alias(f"r{i}") for i, c in enumerate(turned)), F.lit(0.5).alias("m0"), (f % 4 / 2.0 - 3.0).alias("m1"), F.lit(60.0).alias("m2"))
    return rows, [F.col(f"r{i}") for i in range(9)], [F.col(f"m{i}") for i in range(3)]


def _seen(t):
    rows, r, m = _posed(t)
    u, v, ahead = C.projected([F.col("x"), F.col("y"), F.lit(0.5)], r, m, VIEW, LENS)
    rows = rows.select("run_id", "frame", ahead.alias("ahead"), u.alias("u"), v.alias("v"))
    return rows.withColumns({n: F.round(F.when(F.abs(n) < 20_000, F.col(n)), 4) for n in ("u", "v")})


def _grounded(t):
    """Places on the ground and on the goal's plane that a pixel shows, and the camera's place."""
    rows, r, m = _posed(t)
    rows = rows.select("*", C.undistorted(F.col("x") * 8 + 960, F.col("y") * 6 + 540, VIEW, LENS).alias("at"))
    rows = rows.withColumns(dict(zip(("cx", "cy", "cz", "d0", "d1", "d2"), C.camera_centre(r, m) + C.ray(F.col("at"), r))))
    centre, ray = [F.col(c) for c in ("cx", "cy", "cz")], [F.col(f"d{i}") for i in range(3)]
    rows = rows.withColumns(dict(zip(("gx", "gy", "goal_y", "goal_z", "ray_x", "ray_y"), [*C.ground_point(F.col("at"), r, m), *C.meets_plane(centre, ray, 0, 52.5), *C.meets_plane(centre, ray, 2, 0.0)])))
    return rows.select("run_id", "frame", *(F.round(F.when(F.abs(n) < 500, F.col(n)), 4).alias(n) for n in ("gx", "gy", "goal_y", "goal_z", "ray_x", "ray_y", "cx", "cy", "cz")))


def _looks(t):
    f = F.col("frame")
    r = C.look_at_rotation(F.radians(f * 7 % 340 - 170), F.radians(f % 80 + 1), F.radians(f * 3 % 60 - 30))
    yaw, down, roll = C.look_at_angles(r)
    named = {"yaw": F.degrees(yaw), "down": F.degrees(down), "roll": F.degrees(roll), "r0": r[0], "r1": r[1], "r5": r[5], "r8": r[8]}
    return _frames(t).select("run_id", "frame", *(F.round(c, 6).alias(n) for n, c in named.items()))


def _metadata(t):
    f = F.col("frame")
    pairs = F.map_from_arrays(F.array(F.lit("outcome"), F.lit("angle"), F.when(f % 2 == 0, "receiver_id").otherwise("note")), F.array(F.lit("goal"), F.lit("3"), f.cast("string")))
    events = _frames(t).select("run_id", "frame", F.format_string("e%d", f).alias("event_id"), F.lit("pass").alias("type"), F.lit("P1").alias("player_id"), F.lit("team_A").alias("team_id"), F.when(f % 3 != 0, pairs).alias("metadata"))
    return A.event_summaries(events).select("event_id", "time_s", F.array_join(F.array_sort(F.map_keys("shown")), ",").alias("keys"), F.col("shown")["receiver_id"].alias("receiver_id"))


def _zones(t):
    o = F.col("ord")
    return t["players"].select("run_id", "ord", o.alias("track_id"), F.concat(F.lit("z"), (o * o % 7).cast("string")).alias("zone"), (o * 11 % 8).alias("score")).distinct()


def _points(t, shift):
    i, f = F.col("ord"), F.col("frame")
    return t["players"].where(f"(frame + ord * {shift}) % 3 <> 0").select("run_id", "frame", i.alias("id"), (F.col("x") + shift * (f % 5)).alias("x"), (F.col("y") - shift).alias("y"))


_POSED = """(SELECT *, c + (1 - c)*a*a AS r0, (1 - c)*a*b - s*g AS r1, (1 - c)*a*g + s*b AS r2, (1 - c)*a*b + s*g AS r3, c + (1 - c)*b*b AS r4, (1 - c)*b*g - s*a AS r5, (1 - c)*a*g - s*b AS r6, (1 - c)*b*g + s*a AS r7, c + (1 - c)*g*g AS r8 FROM (
  SELECT *, cos(h) AS c, sin(h) AS s, v0 / h AS a, v1 / h AS b, v2 / h AS g FROM (SELECT *, sqrt(v0*v0 + v1*v1 + v2*v2) AS h FROM (
  SELECT run_id, frame, x, y, 1.2::DOUBLE + frame % 7 / 50.0::DOUBLE AS v0, (frame % 5 - 2) / 10.0::DOUBLE AS v1, frame % 3 / 20.0::DOUBLE + 0.01::DOUBLE AS v2, 0.5::DOUBLE AS t0, frame % 4 / 2.0::DOUBLE - 3.0 AS t1, 60.0::DOUBLE AS t2 FROM ball))))"""


def _undistorted_sql(rows):
    rows = f"(SELECT *, x0 AS p, y0 AS q FROM (SELECT *, x * 8 / 1500.0::DOUBLE AS x0, y * 6 / 1500.0::DOUBLE AS y0, 0.0::DOUBLE AS w, 0.0::DOUBLE AS o FROM {rows}))"
    for _ in range(C.UNDISTORT_ROUNDS):
        rows = f"""(SELECT * REPLACE ((x0 - 2 * 0.001::DOUBLE * p * q + 0.0005::DOUBLE * (w + 2 * p * p)) / o AS p, (y0 - 0.001::DOUBLE * (w + 2 * q * q) + 2 * 0.0005::DOUBLE * p * q) / o AS q) FROM (
          SELECT * REPLACE (1 + ((0.002::DOUBLE * w - 0.01::DOUBLE) * w + 0.05::DOUBLE) * w AS o) FROM (SELECT * REPLACE (p*p + q*q AS w) FROM {rows})))"""
    return rows


def approach_sql(states: str, fast: str) -> str:
    """SQL of approach shots over ball states (run_id, frame, x, y, confidence)."""
    return f"""SELECT run_id, frame, CASE WHEN s > 0 THEN 'right' ELSE 'left' END AS goal_side, y AS cross_y, speed, own, confidence FROM (
      SELECT *, list_sum(list_transform(dxs[1:steps], lambda d: abs(d))) AS way, list_sum(dts[1:steps]) AS took FROM (
      SELECT *, coalesce(list_position(list_transform(hs, lambda h: h = heading), false) - 1, len(hs)) AS steps,
        CASE WHEN f1 - frame <= 25 AND s * x1 > s * x - 3 THEN CASE WHEN f2 - f1 <= 25 AND s * x2 > s * x - 3 THEN CASE WHEN f3 - f2 <= 25 AND s * x3 > s * x - 3 THEN f4 - f3 ELSE f3 - f2 END ELSE f2 - f1 END ELSE f1 - frame END AS gap,
        CASE WHEN f1 - frame <= 125 AND s * x1 > s * x - 3 THEN CASE WHEN f2 - f1 <= 125 AND s * x2 > s * x - 3 THEN CASE WHEN f3 - f2 <= 125 AND s * x3 > s * x - 3 THEN f4 - f3 ELSE f3 - f2 END ELSE f2 - f1 END ELSE f1 - frame END AS long_gap,
        s * (x1 - x) / ((f1 - frame) / 25.0::DOUBLE) AS onward, sqrt(dx*dx + dy*dy) / dt AS speed FROM (
      SELECT *, list_reverse(list(heading) OVER b) AS hs, list_reverse(list(dx) OVER b) AS dxs, list_reverse(list(dt) OVER b) AS dts FROM (
      SELECT *, CASE WHEN dt > 0 AND dt <= 2 THEN sign(dx) ELSE 0 END AS heading, CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM (
      SELECT run_id, frame, x, y, confidence AS own, (confidence + lag(confidence) OVER w) / 2 AS confidence, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, (frame - lag(frame) OVER w) / 25.0::DOUBLE AS dt,
        lead(frame) OVER w AS f1, lead(frame, 2) OVER w AS f2, lead(frame, 3) OVER w AS f3, lead(frame, 4) OVER w AS f4, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(x, 3) OVER w AS x3
      FROM {states} WINDOW w AS (PARTITION BY run_id ORDER BY frame)))
      WINDOW b AS (PARTITION BY run_id ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))))
      WHERE abs(x) > 49.5 AND abs(x) <= 52.5 AND heading = s AND speed <= 50 AND CASE WHEN speed >= {fast} THEN gap IS NULL OR gap > 25 OR coalesce(onward < -{fast}, false) WHEN speed >= 2 THEN steps >= 4 AND way / took >= 2 AND (long_gap IS NULL OR long_gap >= 125) ELSE false END"""


#: name: (plan of the tables t, SQL over the shared views).
ENTRIES = {
    "approach_shots": (lambda t: H.approach_shots(_lost_states(t)), "SELECT run_id, frame, goal_side, cross_y, speed FROM (" + approach_sql("(SELECT *, 1.0 AS confidence FROM st WHERE frame % 900 BETWEEN 40 AND 897)", "8.0") + ")"),
    "shot_outcomes": (lambda t: H.shot_outcomes(E.goal_line_crossings(E.ball_states(t["ball"])), E.ball_states(t["ball"])).select("run_id", "frame", "goal_side", "cross_y", "outcome"),
        "SELECT run_id, frame, goal_side, cross_y, CASE WHEN abs(cross_y) <= 3.66::DOUBLE THEN 'goal' ELSE 'off_target' END AS outcome FROM gc WHERE (SELECT count(*) FROM st s WHERE s.run_id = gc.run_id AND s.frame BETWEEN gc.frame - 25 AND gc.frame AND abs(52.5::DOUBLE - CASE goal_side WHEN 'right' THEN s.x ELSE -s.x END - 5) < 5) >= 2"),
    "kick_holders": (lambda t: H.kick_holders(E.goal_line_crossings(E.ball_states(t["ball"])), _near(t), lookback_seconds=1.0, radius=1.0),
        """SELECT k.run_id, k.kick AS frame, b.player_id, b.team FROM (SELECT DISTINCT run_id, frame AS kick FROM gc) k LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, kick ORDER BY v DESC, first) AS rk FROM (
        SELECT g.run_id, g.frame AS kick, n.player_id, round(sum(0.1::DOUBLE + 0.9::DOUBLE * (n.frame - greatest(0, g.frame - 25)) / greatest(1, g.frame - greatest(0, g.frame - 25))), 9) AS v, min(n.frame) AS first, arg_max(n.team, n.frame) AS team
        FROM (SELECT DISTINCT run_id, frame FROM gc) g JOIN nr n ON n.run_id = g.run_id AND n.frame BETWEEN greatest(0, g.frame - 25) AND g.frame WHERE n.distance <= 1 GROUP BY ALL)) b ON b.run_id = k.run_id AND b.kick = k.kick AND b.rk = 1"""),
    "passes_to_others": (lambda t: H.without_self_passes(_holders(t)), "SELECT *, printf('pass_%04d', row_number() OVER (PARTITION BY run_id ORDER BY frame)) AS event_id FROM (SELECT run_id, start_frame AS frame, player_id, lead(player_id) OVER (PARTITION BY run_id ORDER BY start_frame) AS receiver_id FROM sp) WHERE receiver_id IS NULL OR player_id <> receiver_id"),
    "camera_checks": (lambda t: A.camera_checks(_cameras(t)), """SELECT run_id, frame, reason = 'ok' AS good, reason FROM (SELECT run_id, frame, CASE WHEN frame % 11 = 0 THEN 'fx-recovery-failed' WHEN frame * 29 % 25000 NOT BETWEEN 10 AND 20000 THEN 'fx-out-of-range(' || frame * 29 % 25000 || ')' WHEN frame % 13 = 0 THEN 'pos-recovery-failed'
        WHEN NOT (frame * 7 % 600 - 300 > -250 AND frame * 7 % 600 - 300 < 250 AND frame * 3 % 560 - 280 > -250 AND frame * 3 % 560 - 280 < 250) THEN 'pos-xy-out-of-range' WHEN frame * 5 % 240 = 120 OR abs(frame * 5 % 240 - 120) >= 100 THEN 'pos-z-out-of-range' ELSE 'ok' END AS reason FROM fs)"""),
    "nearest_detections": (lambda t: A.nearest_detections(_frames(t), _sure(t).where("ord % 6 = 5 AND frame % 100 = 7")), """SELECT f.run_id, f.frame, n.x, n.y FROM fs f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, frame ORDER BY abs(df - frame), df) AS rk FROM (
        SELECT f.run_id, f.frame, d.frame AS df, d.x, d.y FROM fs f JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, frame ORDER BY confidence DESC, ord) AS best FROM det WHERE ord % 6 = 5 AND frame % 100 = 7) d ON d.run_id = f.run_id AND d.frame BETWEEN f.frame - 30 AND f.frame + 30 AND best = 1)) n ON n.run_id = f.run_id AND n.frame = f.frame AND n.rk = 1"""),
    "dropouts": (lambda t: A.dropouts(t["players"].where("ord < 6 AND (frame + ord) % 20 > 4").withColumnRenamed("ord", "track_id"), t["players"].where("ord >= 6")).withColumns({c: F.round(c, 6) for c in ("x", "y", "distance")}),
        """SELECT run_id, track_id, fb AS frame_before, f AS frame_gap, fa AS frame_after, fa - fb AS gap_samples, round(gx, 6) AS x, round(gy, 6) AS y, ord, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY run_id, track_id, f ORDER BY d, ord) AS rk FROM (
        SELECT g.*, p.ord, sqrt((p.x - gx)*(p.x - gx) + (p.y - gy)*(p.y - gy)) AS d FROM (SELECT *, px + (f - fb) / CAST(fa - fb AS DOUBLE) * (x - px) AS gx, py + (f - fb) / CAST(fa - fb AS DOUBLE) * (y - py) AS gy FROM (SELECT *, unnest(range(fb + 1, fa)) AS f FROM (
        SELECT run_id, ord AS track_id, frame AS fa, x, y, lag(frame) OVER w AS fb, lag(x) OVER w AS px, lag(y) OVER w AS py FROM players WHERE ord < 6 AND (frame + ord) % 20 > 4 WINDOW w AS (PARTITION BY run_id, ord ORDER BY frame)) WHERE fa - fb BETWEEN 2 AND 30)) g
        JOIN players p ON p.run_id = g.run_id AND p.frame = g.f AND p.ord >= 6) WHERE d < 4) WHERE rk = 1"""),
    "candidate_frames": (lambda t: A.candidate_frames(_frames(t).where("frame % 7 <> 3")), """SELECT run_id, unnest(CASE WHEN len(s) <= 12 THEN s ELSE list_transform(range(12), lambda k: s[CAST(floor(k * (len(s) / 12.0::DOUBLE)) AS BIGINT) + 1]) END) AS frame FROM (
        SELECT run_id, CASE WHEN h > l THEN a[l + 1:h] ELSE a END AS s FROM (SELECT *, CAST(floor(len(a) * 0.05::DOUBLE) AS BIGINT) AS l, CAST(floor(len(a) * 0.95::DOUBLE) AS BIGINT) AS h FROM (SELECT run_id, list(frame ORDER BY frame) AS a FROM fs WHERE frame % 7 <> 3 GROUP BY run_id)))"""),
    "second_pass_frames": (lambda t: A.second_pass_frames(_frames(t), t["ball"].where("frame % 50 >= 15 OR frame % 7 = 0"), old_gap=5, new_gap=12).withColumns({c: F.round(c, 6) for c in ("x", "y")}), """SELECT f.run_id, f.frame, round(a.x + (f.frame - a.frame) / CAST(b.frame - a.frame AS DOUBLE) * (b.x - a.x), 6) AS x, round(a.y + (f.frame - a.frame) / CAST(b.frame - a.frame AS DOUBLE) * (b.y - a.y), 6) AS y
        FROM fs f ASOF JOIN (SELECT * FROM ball WHERE frame % 50 >= 15 OR frame % 7 = 0) a ON f.run_id = a.run_id AND f.frame >= a.frame ASOF JOIN (SELECT * FROM ball WHERE frame % 50 >= 15 OR frame % 7 = 0) b ON f.run_id = b.run_id AND f.frame <= b.frame WHERE a.frame < f.frame AND b.frame > f.frame AND b.frame - a.frame BETWEEN 6 AND 12"""),
    "without_lonely": (lambda t: A.without_lonely(_groups(t)).select("run_id", "cluster", "team", "role"), "SELECT run_id, ord % 14 AS cluster, CASE WHEN ord % 14 IN (0, 11, 12, 13) THEN 'unknown' ELSE 'team_A' END AS team, CASE WHEN ord % 14 = 11 THEN 'goalkeeper' END AS role FROM players GROUP BY run_id, ord % 14 HAVING ord % 14 BETWEEN 1 AND 10 OR ord % 14 = 11 OR count(DISTINCT ord) > 1"),
    "final_tracks": (lambda t: A.final_tracks(_labelled(t)), """SELECT p.run_id, ord AS track_id, j.jersey, m.team, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM players p
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, o ORDER BY k DESC, f) AS rk FROM (SELECT run_id AS r, run_id, ord AS o, (frame * 3 + ord) % 6 AS jersey, count(*) AS k, min(frame) AS f FROM players WHERE frame % 4 <> 0 GROUP BY ALL)) j ON j.r = p.run_id AND j.o = p.ord AND j.rk = 1
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, o ORDER BY k DESC, f) AS rk FROM (SELECT run_id AS r, run_id, ord AS o, CASE WHEN frame * ord % 3 = 0 THEN 'team_A' ELSE 'team_B' END AS team, count(*) AS k, min(frame) AS f FROM players WHERE (frame + ord) % 5 <> 0 GROUP BY ALL)) m ON m.r = p.run_id AND m.o = p.ord AND m.rk = 1
        GROUP BY p.run_id, ord, j.jersey, m.team"""),
    "exemplars": (lambda t: A.exemplars(_references(t), t["players"].select("run_id", F.col("ord").alias("track_id"), "frame", ((F.col("frame") * 7 + F.col("ord") * 13) % 97).alias("score")), 3),
        """SELECT run_id, team, place, track_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY run_id, team ORDER BY place) AS rk FROM (SELECT run_id, CASE ord % 2 WHEN 0 THEN 'team_A' ELSE 'team_B' END AS team, ord * 3 % 8 AS place, ord AS track_id, frame, row_number() OVER (PARTITION BY run_id, ord ORDER BY (frame * 7 + ord * 13) % 97 DESC, frame) AS best FROM players WHERE ord < 8) WHERE best = 1) WHERE rk <= 3"""),
    "camera_projection": (_seen, f"""SELECT run_id, frame, z > 0.1 AS ahead, round(CASE WHEN abs(u) < 20000 THEN u END, 4) AS u, round(CASE WHEN abs(v) < 20000 THEN v END, 4) AS v FROM (
        SELECT *, 1500 * (p * o + 2 * 0.001::DOUBLE * p * q - 0.0005::DOUBLE * (w + 2 * p * p)) + 960 AS u, 1500 * (q * o + 0.001::DOUBLE * (w + 2 * q * q) - 2 * 0.0005::DOUBLE * p * q) + 540 AS v FROM (SELECT *, 1 + ((0.002::DOUBLE * w - 0.01::DOUBLE) * w + 0.05::DOUBLE) * w AS o FROM (SELECT *, p*p + q*q AS w FROM (
        SELECT *, (r0*x + r1*y + r2*0.5 + t0) / z AS p, (r3*x + r4*y + r5*0.5 + t1) / z AS q FROM (SELECT *, r6*x + r7*y + r8*0.5 + t2 AS z FROM {_POSED})))))"""),
    "ground_and_goal_points": (_grounded, f"""SELECT run_id, frame, {", ".join(f"round(CASE WHEN abs({n}) < 500 THEN {n} END, 4) AS {n}" for n in ("gx", "gy", "goal_y", "goal_z", "ray_x", "ray_y", "cx", "cy", "cz"))} FROM (
        SELECT *, CASE WHEN abs(d2) >= 1e-8 AND -cz / d2 >= 0 THEN cx - cz / d2 * d0 END AS ray_x, CASE WHEN abs(d2) >= 1e-8 AND -cz / d2 >= 0 THEN cy - cz / d2 * d1 END AS ray_y, CASE WHEN abs(d2 / n) > 0 THEN cx - cz / d2 * d0 END AS gx, CASE WHEN abs(d2 / n) > 0 THEN cy - cz / d2 * d1 END AS gy,
        CASE WHEN abs(d0) >= 1e-8 AND (52.5 - cx) / d0 >= 0 THEN cy + (52.5 - cx) / d0 * d1 END AS goal_y, CASE WHEN abs(d0) >= 1e-8 AND (52.5 - cx) / d0 >= 0 THEN cz + (52.5 - cx) / d0 * d2 END AS goal_z FROM (
        SELECT *, e0 / n AS d0, e1 / n AS d1, e2 / n AS d2 FROM (SELECT *, sqrt(e0*e0 + e1*e1 + e2*e2) AS n FROM (
        SELECT *, -(r0*t0 + r3*t1 + r6*t2) AS cx, -(r1*t0 + r4*t1 + r7*t2) AS cy, -(r2*t0 + r5*t1 + r8*t2) AS cz, r0*p + r3*q + r6 AS e0, r1*p + r4*q + r7 AS e1, r2*p + r5*q + r8 AS e2 FROM {_undistorted_sql(_POSED)}))))"""),
    "look_at_rotations": (_looks, """SELECT run_id, frame, round(yaw, 6) AS yaw, round(down, 6) AS down, round(roll, 6) AS roll, round(cos(b) * cos(c) - sin(b) * sin(a) * sin(c), 6) AS r0, round(-sin(b) * cos(c) - cos(b) * sin(a) * sin(c), 6) AS r1, round(-cos(a) * cos(c), 6) AS r5, round(-sin(a), 6) AS r8 FROM (
        SELECT *, radians(down) AS a, radians(yaw) AS b, radians(roll) AS c FROM (SELECT run_id, frame, CAST(frame * 7 % 340 - 170 AS DOUBLE) AS yaw, CAST(frame % 80 + 1 AS DOUBLE) AS down, CAST(frame * 3 % 60 - 30 AS DOUBLE) AS roll FROM fs))"""),
    "event_summaries": (_metadata, "SELECT 'e' || frame AS event_id, round(frame / 25.0::DOUBLE, 2) AS time_s, CASE WHEN frame % 3 = 0 THEN '' WHEN frame % 2 = 0 THEN 'outcome,receiver_id' ELSE 'outcome' END AS keys, CASE WHEN frame % 3 <> 0 AND frame % 2 = 0 THEN CAST(frame AS VARCHAR) END AS receiver_id FROM fs"),
    "zone_quota": (lambda t: A.zone_quota(_zones(t), 10), """SELECT run_id, track_id, zone, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rk > greatest(1, 10 // zones), seen, rk) AS place FROM (SELECT *, row_number() OVER (PARTITION BY run_id, zone ORDER BY track_id * 11 % 8 DESC, track_id) AS rk, min(track_id) OVER (PARTITION BY run_id, zone) AS seen, count(DISTINCT zone) OVER (PARTITION BY run_id) AS zones FROM (
        SELECT DISTINCT run_id, ord AS track_id, 'z' || ord * ord % 7 AS zone FROM players))) WHERE place <= 10"""),
    "keypoint_scores": (lambda t: A.keypoint_scores(_points(t, 0), _points(t, 1)).withColumn("mean_error", F.round("mean_error", 6)), """SELECT run_id, frame, count(*) FILTER (a) AS expected, count(*) FILTER (a AND b) AS found, count(*) FILTER (NOT a) AS phantoms, round(avg(CASE WHEN a AND b THEN sqrt(power(frame % 5, 2) + 1) END), 6) AS mean_error FROM (
        SELECT run_id, frame, frame % 3 <> 0 AS a, (frame + ord) % 3 <> 0 AS b FROM players) WHERE a OR b GROUP BY ALL"""),
    "both_passes": (lambda t: A.both_passes(t["ball"].where("frame % 3 = 0"), t["ball"].where("frame % 3 > 0")).groupBy("run_id", "source").agg(F.count("*").alias("n")), "SELECT run_id, CASE frame % 3 WHEN 0 THEN 'pass1' ELSE 'pass2' END AS source, count(*) AS n FROM ball GROUP BY ALL"),
    "movement_patterns": (lambda t: A.movement_patterns(t["players"].select("run_id", F.col("ord").alias("track_id"), (F.col("x") * F.when(F.col("ord") % 5 == 0, 0.1007).otherwise(1.0007) + F.when(F.col("ord") % 5 == 0, 45.0).otherwise(0.0)).alias("x"), (F.col("y") * F.when(F.col("ord") % 5 < 2, 0.1009).otherwise(1.0009) + F.when(F.col("ord") % 5 == 1, F.col("ord") * 3.0).otherwise(0.0)).alias("y"))),
        """SELECT run_id, track_id, pattern, 'pattern=' || pattern || '. ' || pattern || ': ' || CASE pattern WHEN 'tight_near_goal' THEN printf('stays within ~%.1fm of the %s goal line (%.1fm from goal), y_med=%.1fm. This is the goalkeeper pattern.', rx, CASE WHEN mx <= 0 THEN 'left' ELSE 'right' END, goal, my)
        WHEN 'covers_whole_pitch' THEN printf('x-range %.1fm (%.0f%% of pitch length), y-range %.1fm (%.0f%% of pitch width). Only the main referee covers this much area.', rx, rx / 105 * 100, ry, ry / 68 * 100) WHEN 'touchline_runner' THEN printf('stays within %.1fm of the %s touchline (median %.1fm from it), runs %.1fm along it. This is the linesman pattern.', ry, CASE WHEN my >= 0 THEN 'top' ELSE 'bottom' END, touch, rx)
        WHEN 'off_pitch_lateral' THEN printf('median position is off the playing area (x=%.1f, y=%.1f). Coach / substitute / staff.', mx, my) ELSE printf('x-range %.1fm (%.0f%% of length), y-range %.1fm (%.0f%% of width). Normal outfield player movement.', rx, rx / 105 * 100, ry, ry / 68 * 100) END AS description FROM (
        SELECT *, CASE WHEN abs(mx) <= 53 AND abs(my) <= 34.5 THEN CASE WHEN goal <= 18 AND rx / 105 <= 0.18 AND abs(my) <= 6 THEN 'tight_near_goal' WHEN rx / 105 >= 0.6 AND ry / 68 >= 0.55 THEN 'covers_whole_pitch' WHEN touch <= 5 AND ry <= 12 AND rx / 105 >= 0.35 THEN 'touchline_runner' ELSE 'outfield' END ELSE 'off_pitch_lateral' END AS pattern FROM (
        SELECT run_id, track_id, qx[2] AS mx, qy[2] AS my, qx[3] - qx[1] AS rx, qy[3] - qy[1] AS ry, least(abs(qx[2] + 52.5), abs(qx[2] - 52.5)) AS goal, least(abs(qy[2] - 34), abs(qy[2] + 34)) AS touch FROM (SELECT run_id, track_id, quantile_cont(x, [0.05, 0.5, 0.95]) AS qx, quantile_cont(y, [0.05, 0.5, 0.95]) AS qy FROM (
        SELECT run_id, ord AS track_id, x * CASE WHEN ord % 5 = 0 THEN 0.1007::DOUBLE ELSE 1.0007::DOUBLE END + CASE WHEN ord % 5 = 0 THEN 45 ELSE 0 END AS x, y * CASE WHEN ord % 5 < 2 THEN 0.1009::DOUBLE ELSE 1.0009::DOUBLE END + CASE WHEN ord % 5 = 1 THEN ord * 3 ELSE 0 END AS y FROM players) WHERE abs(x) <= 105 AND abs(y) <= 68 GROUP BY ALL)))"""),
    "span_windows": (lambda t: D.event_windows(_spans(t).select("run_id", F.when(F.col("span_id") % 4 == 0, "shot").otherwise("possession").alias("type"), F.col("start_frame").alias("frame"), "player_id", "start_frame", F.when(F.col("span_id") % 4 != 1, F.col("end_frame")).alias("end_frame")), t["players"]),
        "SELECT s.run_id, CASE span_id % 4 WHEN 0 THEN 'shot' ELSE 'possession' END AS type, start_frame AS frame, player_id, CASE span_id % 4 WHEN 0 THEN greatest(0, start_frame - 12) WHEN 1 THEN greatest(0, start_frame - 50) ELSE start_frame END AS window_start, CASE span_id % 4 WHEN 0 THEN least(start_frame + 12, last) WHEN 1 THEN least(start_frame + 50, last) ELSE end_frame END AS window_end FROM sp s JOIN (SELECT run_id, max(frame) AS last FROM players GROUP BY ALL) e ON e.run_id = s.run_id"),
}
