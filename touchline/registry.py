"""Queries of the match-analytics operators and their SQL counterparts, by name."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from . import registry_chains as Z
from . import registry_live as U
from . import registry_passes as Y
from . import registry_shots as N
from . import registry_tables as R
from . import registry_tracking as V
from .functions.text import shirt_number
from .operators import duels as D
from .operators import events as E
from .operators import matches as H
from .operators import shots as O
from .operators import stats as S
from .operators import tracks as T
from .plans.presets import TEMPLATE as P
from .plans.staging import stored
from .sources.fixtures import duckdb_views, match_tables


def _near(t):
    return E.nearest_player(E.ball_states(t["ball"]), t["players"], t["teams"])


def _spans(t):
    return E.possession_spans(_near(t))


def _parts(t):
    """Ball states and spans, each computed once, and the passes between them."""
    states = stored(E.ball_states(t["ball"]), "states")
    spans = stored(E.possession_spans(E.nearest_player(states, t["players"], t["teams"])), "spans")
    return states, spans, E.bridge_passes(spans, states)


def _passes(t):
    return _parts(t)[2]


def _tackles(t):
    states, spans, passes = _parts(t)
    return D.tackles(spans, stored(passes, "passes"), states, t["players"], t["teams"], **LOOSE)


def _deflections(t):
    states, spans, _ = _parts(t)
    return D.deflections(spans.select("run_id", F.col("end_frame").alias("frame")), states).withColumn("angle", F.round("angle", 3))


def _events(t):
    return H.match_events(t["ball"], t["players"], t["teams"])


def _jumping(t):
    """The ball with a false place, 8 m off, every 61st frame."""
    return t["ball"].withColumn("x", F.col("x") + F.when(F.col("frame") % 61 == 0, 8.0).otherwise(0.0))


def _strayed(t):
    """Players with one beside the field and one whose track changes bodies every 200 frames."""
    off = F.when(F.col("ord") == 3, 80.0).otherwise(0.0)
    jump = F.when((F.col("ord") == 7) & (F.floor(F.col("frame") / 200) % 2 == 1), 7.0).otherwise(0.0)
    return t["players"].withColumns({"y": F.col("y") + off, "x": F.col("x") + jump})


def _shots(t):
    shots = O.detected_shots(stored(E.ball_states(t["ball"]), "states"), t["ball"], t["players"], t["teams"])
    return shots.select("run_id", "type", "frame", "player_id", "team", "outcome", "confidence", "goal_side", "cross_y", "speed", "approach", "shooter_frame")


def _team_rows(t):
    """Events with the end frames of spans, and tackles; states, spans and passes are computed once."""
    states, spans, passes = _parts(t)
    passes = stored(passes, "passes")
    shots = stored(O.detected_shots(states, t["ball"], t["players"], t["teams"]), "shots")
    none = F.lit(None).cast("string")
    row = lambda df, kind, outcome=none, end=F.lit(None).cast("long"): df.select("run_id", "frame", F.lit(kind).alias("type"), end.alias("end_frame"), "team", outcome.alias("outcome"))
    found = row(spans.withColumnRenamed("start_frame", "frame"), "possession", end=F.col("end_frame")).union(row(passes, "pass", F.col("outcome"))).union(row(E.interceptions(passes), "interception"))
    found = found.union(row(shots.where("type = 'shot'"), "shot", F.col("outcome"))).union(row(shots.where("type = 'goal'"), "goal", F.col("outcome")))
    return found.union(row(D.tackles(spans, passes, states, t["players"], t["teams"], **LOOSE), "tackle"))


def _scored(t):
    """Passes and spans with a made-up confidence, for de-duplication."""
    return _events(t).where("type IN ('possession', 'pass')").select("run_id", "type", "frame", ((F.col("frame") * 37 % 101) / 100.0).alias("confidence"))


#: The fixture's bodies never come as near as the presets ask, so these queries are run with wider bounds.
LOOSE = {"proximity": 30.0, "min_angle": 0.0, "max_gap_seconds": 8.0}

_PLANS = {
    "ball_states": lambda t: E.ball_states(t["ball"]),
    "nearest_player": lambda t: _near(t).select("run_id", "frame", "player_id", "team", "distance"),
    "possession_spans": _spans,
    "bridge_passes": _passes,
    "interceptions": lambda t: E.interceptions(_passes(t)),
    "goal_line_crossings": lambda t: E.goal_line_crossings(E.ball_states(t["ball"])),
    "match_events": _events,
    "detected_shots": _shots,
    "player_kinematics": lambda t: S.player_kinematics(t["players"]),
    "team_stats": lambda t: S.team_stats(_team_rows(t)),
    "player_stats": lambda t: S.player_stats(t["players"], _events(t), seconds=(10.0, 400.02)),
    "shot_dedup": lambda t: E.deduplicated(_scored(t), 4.0).select("run_id", "type", "frame", "confidence"),
    "heatmap": lambda t: S.heatmap(t["players"]),
    "pass_network": lambda t: S.pass_network(_passes(t), min_passes=1),
    "pass_nodes": lambda t: S.pass_nodes(_passes(t)),
    "presence_runs": lambda t: S.presence_runs(t["players"]),
    "off_field": lambda t: S.off_field(_strayed(t)),
    "track_summary": lambda t: S.track_summary(t["players"]),
    "identity_switches": lambda t: S.identity_switches(_strayed(t)),
    "event_counts": lambda t: S.event_counts(_events(t)),
    "list_events": lambda t: S.list_events(_events(t), types=("pass", "shot"), team="team_A", seconds=(10.0, 500.0)),
}


#: Entries of the homography that the projection query uses, row by row.
VIEW = (12.0, 1.5, 960.0, 0.5, -9.0, 540.0, 0.0005, -0.004, 1.0)


def _crossings(t):
    return E.goal_line_crossings(E.ball_states(t["ball"]))


def _boxes(t):
    left, top = F.col("x") * 10, F.col("y") * 10
    return t["players"].select("run_id", "player_id", "frame", left.alias("x1"), top.alias("y1"), (left + 30).alias("x2"), (top + 80).alias("y2"))


_PLANS |= {
    "attack_directions": lambda t: D.attack_directions(t["players"], t["teams"]),
    "carries": lambda t: D.carries(stored(_spans(t), "spans"), t["players"], t["teams"]),
    "deflections": _deflections,
    "tackles": _tackles,
    "possession_at_frames": lambda t: D.possession_at_frames(E.ball_states(t["ball"]), _spans(t)),
    "nearest_opponents": lambda t: D.nearest_opponents(_near(t), t["players"], t["teams"]),
    "buildup_starts": lambda t: D.buildup_starts(_crossings(t), E.ball_states(t["ball"])),
    "event_windows": lambda t: D.event_windows(_events(t), t["players"]),
    "events_near": lambda t: D.events_near(_crossings(t), _events(t)),
    "numbered_events": lambda t: D.numbered_events(_events(t)),
    "position_zones": lambda t: T.position_zones(t["players"]),
    "referee_check": lambda t: T.referee_check(t["players"]),
    "cooccurring_pairs": lambda t: T.cooccurring_pairs(t["players"]),
    "ball_outliers": lambda t: T.ball_outliers(_jumping(t)),
    "without_outliers": lambda t: T.without_outliers(_jumping(t)),
    "kicks": lambda t: T.kicks(_jumping(t).select("run_id", "frame", (F.col("x") * 12).alias("x"), (F.col("y") * 9).alias("y"))),
    "observation_gaps": lambda t: T.observation_gaps(t["ball"]),
    "moving_mean": lambda t: T.moving_mean(t["ball"]),
    "spread_sample": lambda t: T.spread_sample(t["players"]),
    "projected_ball": lambda t: T.projected(t["ball"], VIEW),
    "box_steps": lambda t: T.box_steps(_boxes(t)),
    "speed_percentiles": lambda t: T.speed_percentiles(E.ball_states(t["ball"])),
    "roster": lambda t: T.roster(t["players"], t["teams"]),
    "side_of_teams": lambda t: T.side_of_teams(t["players"], t["teams"]),
}


def _query(plan):
    return lambda spark, sf_dir: plan(match_tables(spark, sf_dir))


def _number_votes(spark, sf_dir):
    reading = F.when(F.col("l_linenumber") != 3, F.col("l_partkey") % 120)
    return T.number_votes(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("track_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), reading.alias("reading"), (F.col("l_discount") * 10).alias("confidence")))


def _features(spark, sf_dir):
    track = F.floor(F.col("vec_id") / 5)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(track / 20).alias("run_id"), track.alias("track_id"), "embedding")


def _shirt_numbers(spark, sf_dir):
    answer = F.concat_ws(" ", F.when(F.col("event_type") == "error", "not visible").otherwise(F.col("event_type")), F.col("props"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", shirt_number(answer).cast("long").alias("number"))


QUERIES: dict = {name: _query(plan) for name, plan in _PLANS.items()} | {
    "number_votes": _number_votes,
    "similar_tracks": lambda spark, sf_dir: T.similar_tracks(_features(spark, sf_dir), 0.1),
    "shirt_numbers": _shirt_numbers,
}

#: Approach shots over ball states with a confidence.
R_APPROACH = "SELECT run_id, frame, goal_side, cross_y, speed, confidence, true FROM (" + N.approach_sql("so", f"{P.shot_speed}") + ") WHERE own >= 0.15"
_D = "sqrt((p.x - s.x)*(p.x - s.x) + (p.y - s.y)*(p.y - s.y))"
_CTES = {
    "sm": f"""(SELECT run_id, frame,
      CASE WHEN px IS NULL OR nx IS NULL THEN x ELSE list_sort([px, x, nx])[2] END AS x, CASE WHEN px IS NULL OR nx IS NULL THEN y ELSE list_sort([py, y, ny])[2] END AS y
    FROM (SELECT *, lag(x) OVER w AS px, lead(x) OVER w AS nx, lag(y) OVER w AS py, lead(y) OVER w AS ny FROM ball WHERE confidence >= {P.ball_confidence} WINDOW w AS (PARTITION BY run_id ORDER BY frame)))""",
    "st": f"""(SELECT run_id, frame, x, y, CASE WHEN ok THEN vx END AS vx, CASE WHEN ok THEN vy END AS vy, CASE WHEN ok THEN speed ELSE 0.0 END AS speed
    FROM (SELECT *, sqrt(vx*vx + vy*vy) AS speed, coalesce(dt > 0 AND dt <= 1.0 AND sqrt(vx*vx + vy*vy) <= 60.0, false) AS ok
      FROM (SELECT *, (x - px) / dt AS vx, (y - py) / dt AS vy FROM (SELECT *, (frame - lag(frame) OVER w) / {P.fps}::DOUBLE AS dt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM sm WINDOW w AS (PARTITION BY run_id ORDER BY frame)))))""",
    "nr": f"""(SELECT s.run_id, s.frame, n.player_id, n.team, n.distance, s.x, s.y, s.speed FROM st s LEFT JOIN
    (SELECT * FROM (SELECT s.run_id, s.frame, p.player_id, t.team, {_D} AS distance, row_number() OVER (PARTITION BY s.run_id, s.frame ORDER BY {_D}, p.ord) AS rk
      FROM st s JOIN players p ON s.run_id = p.run_id AND s.frame = p.frame JOIN teams t ON p.player_id = t.player_id WHERE t.team <> 'referee') WHERE rk = 1) n ON s.run_id = n.run_id AND s.frame = n.frame)""",
    "sp": f"""(SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY start_frame) AS span_id, player_id, team, start_frame, end_frame, sx, sy, ex, ey FROM
    (SELECT run_id, island, min(holder) AS player_id, arg_min(team, frame) AS team, min(frame) AS start_frame, max(frame) AS end_frame, arg_min(x, frame) AS sx, arg_min(y, frame) AS sy, arg_max(x, frame) AS ex, arg_max(y, frame) AS ey
     FROM (SELECT *, sum(CASE WHEN holder IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY frame) AS island
      FROM (SELECT *, lag(holder) OVER (PARTITION BY run_id ORDER BY frame) AS before
       FROM (SELECT *, CASE WHEN speed > {P.possession_speed_break} OR distance IS NULL OR distance > {P.possession_distance} THEN NULL ELSE player_id END AS holder FROM nr)))
     WHERE holder IS NOT NULL GROUP BY run_id, island) WHERE (end_frame - start_frame) / {P.fps} >= {P.possession_seconds})""",
    "ps": f"""(SELECT a.run_id, a.end_frame AS frame, a.player_id, a.team, b.player_id AS receiver_id, b.team AS receiver_team, b.start_frame AS end_frame, a.ex AS x, a.ey AS y, b.sx AS end_x, b.sy AS end_y,
      sqrt((b.sx-a.ex)*(b.sx-a.ex) + (b.sy-a.ey)*(b.sy-a.ey)) AS pass_length, CASE WHEN a.team = b.team THEN 'successful' ELSE 'failed' END AS outcome
    FROM sp a JOIN sp b ON a.run_id = b.run_id AND b.span_id = a.span_id + 1 AND a.player_id <> b.player_id
    WHERE b.start_frame - a.end_frame BETWEEN 0 AND {P.pass_transit_seconds * P.fps}
      AND coalesce((SELECT max(speed) FROM st WHERE st.run_id = a.run_id AND st.frame BETWEEN a.end_frame AND b.start_frame), 0) >= {P.pass_speed})""",
    "ic": "(SELECT run_id, frame, receiver_id AS player_id, receiver_team AS team, end_x AS x, end_y AS y FROM ps WHERE outcome = 'failed' AND receiver_id IS NOT NULL AND receiver_team IS NOT NULL)",
    "gc": f"""(SELECT run_id, CAST(round_even(pf + part * (frame - pf), 0) AS BIGINT) AS frame, CASE WHEN x > 0 THEN 'right' ELSE 'left' END AS goal_side, py + part * (y - py) AS cross_y, speed, abs(py + part * (y - py)) <= {P.goal_half_width} AS is_goal
    FROM (SELECT *, ({P.half_length} - abs(px)) / (abs(x) - abs(px)) AS part FROM (SELECT *, lag(frame) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py FROM st WINDOW w AS (PARTITION BY run_id ORDER BY frame)))
    WHERE (frame - pf) / {P.fps} <= 1.0 AND speed BETWEEN {P.shot_speed} AND 50.0 AND abs(px) <= {P.half_length} AND abs(x) > {P.half_length} AND abs(px) > {P.half_length} - 10.0 AND x * px > 0)""",
    "so": "(SELECT s.run_id, s.frame, s.x, s.y, s.speed, b.confidence FROM st s JOIN ball b ON s.run_id = b.run_id AND s.frame = b.frame)",
    "mo": f"""(SELECT *, CASE WHEN abs(cross_y) <= {P.goal_half_width} THEN 'Goal' ELSE 'Off_Target' END AS outcome FROM (
      SELECT g.run_id, g.frame, g.goal_side, g.cross_y, g.speed, (o.confidence + q.confidence) / 2 AS confidence, false AS approach FROM gc g
      JOIN (SELECT *, lag(frame) OVER (PARTITION BY run_id ORDER BY frame) AS pf FROM so) o ON o.run_id = g.run_id AND o.frame >= g.frame AND o.pf <= g.frame AND o.pf < o.frame AND abs(o.x) > {P.half_length} AND o.speed = g.speed
      JOIN so q ON q.run_id = g.run_id AND q.frame = o.pf
      WHERE (SELECT count(*) FROM st s WHERE s.run_id = g.run_id AND s.frame BETWEEN g.frame - 25 AND g.frame AND abs(52.5::DOUBLE - CASE g.goal_side WHEN 'right' THEN s.x ELSE -s.x END - 5) < 5) >= 2
      UNION ALL {R_APPROACH}))""",
    "kf": """(SELECT m.run_id, m.frame, m.goal_side, coalesce(max(k.before), min(m.frame)) AS kick FROM (SELECT DISTINCT run_id, frame, goal_side FROM mo) m LEFT JOIN (SELECT g.run_id, g.frame AS goal, s.frame, s.speed, lag(s.frame) OVER w AS before, lag(s.speed) OVER w AS was, min(s.speed) OVER (PARTITION BY g.run_id, g.frame ORDER BY s.frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least
      FROM (SELECT DISTINCT run_id, frame FROM mo) g JOIN st s ON s.run_id = g.run_id AND s.frame BETWEEN greatest(0, g.frame - 125) AND g.frame WINDOW w AS (PARTITION BY g.run_id, g.frame ORDER BY s.frame)) k ON k.run_id = m.run_id AND k.goal = m.frame AND k.was <= 7 AND k.speed >= 10 AND k.least >= 8 GROUP BY ALL)""",
    "ks": f"""(SELECT * FROM (SELECT k.run_id, k.frame AS shot, k.goal_side, k.kick, s.frame, p.player_id, t.team, {_D} AS d, row_number() OVER (PARTITION BY k.run_id, k.frame, k.goal_side, s.frame ORDER BY {_D}, p.ord) AS rk
      FROM kf k JOIN st s ON s.run_id = k.run_id AND s.frame BETWEEN greatest(0, k.kick - 125) AND k.kick JOIN players p ON p.run_id = s.run_id AND p.frame = s.frame JOIN teams t ON t.player_id = p.player_id AND t.team <> 'referee'
      WHERE abs(p.x - CASE k.goal_side WHEN 'right' THEN {P.half_length}::DOUBLE ELSE -{P.half_length}::DOUBLE END) >= 3.0) WHERE rk = 1)""",
    "kh": """(SELECT run_id, shot, goal_side, kick, first(player_id ORDER BY v DESC, f) AS player_id, first(team ORDER BY v DESC, f) AS team FROM (SELECT run_id, shot, goal_side, kick, player_id, round(sum(0.1::DOUBLE + 0.9::DOUBLE * (frame - greatest(0, kick - 25)) / greatest(1, kick - greatest(0, kick - 25))), 9) AS v, min(frame) AS f, arg_max(team, frame) AS team
      FROM ks WHERE d <= 1.0 AND frame >= greatest(0, kick - 25) GROUP BY ALL) GROUP BY ALL)""",
    "kl": "(SELECT run_id, shot, goal_side, arg_max(player_id, frame) AS player_id, arg_max(team, frame) AS team, max(frame) AS at FROM ks WHERE d <= 3.0 GROUP BY ALL)",
    "ss": """(SELECT m.*, CASE WHEN h.shot IS NOT NULL THEN h.player_id ELSE l.player_id END AS player_id, CASE WHEN h.shot IS NOT NULL THEN h.team ELSE l.team END AS team, coalesce(h.kick, l.at, m.frame) AS shooter_frame
      FROM mo m LEFT JOIN kh h ON h.run_id = m.run_id AND h.shot = m.frame AND h.goal_side = m.goal_side LEFT JOIN kl l ON l.run_id = m.run_id AND l.shot = m.frame AND l.goal_side = m.goal_side)""",
    "sd": "(SELECT *, row_number() OVER (PARTITION BY run_id, type ORDER BY frame, confidence DESC, player_id NULLS FIRST, team, outcome, goal_side) AS i FROM (SELECT 'shot' AS type, * FROM ss UNION ALL SELECT 'goal', * FROM ss WHERE outcome = 'Goal'))",
    "sh": """(SELECT d.* FROM (SELECT * FROM (WITH RECURSIVE go AS (SELECT run_id, type, i, i AS kept, frame, confidence AS c, 1 AS slot FROM sd WHERE i = 1 UNION ALL
        SELECT s.run_id, s.type, s.i, CASE WHEN s.frame - g.frame > 50 OR s.confidence > g.c THEN s.i ELSE g.kept END, CASE WHEN s.frame - g.frame > 50 OR s.confidence > g.c THEN s.frame ELSE g.frame END,
          CASE WHEN s.frame - g.frame > 50 OR s.confidence > g.c THEN s.confidence ELSE g.c END, g.slot + CASE WHEN s.frame - g.frame > 50 THEN 1 ELSE 0 END FROM go g JOIN sd s ON g.run_id = s.run_id AND g.type = s.type AND s.i = g.i + 1)
      SELECT run_id, type, slot, arg_max(kept, i) AS kept FROM go GROUP BY ALL)) g JOIN sd d ON d.run_id = g.run_id AND d.type = g.type AND d.i = g.kept)""",
    "ev": f"""(SELECT run_id, type, frame, frame / {P.fps}::DOUBLE AS match_time, player_id, team, outcome FROM (
      SELECT run_id, 'possession' AS type, start_frame AS frame, player_id, team, NULL AS outcome FROM sp UNION ALL SELECT run_id, 'pass', frame, player_id, team, outcome FROM ps
      UNION ALL SELECT run_id, 'interception', frame, player_id, team, NULL FROM ic UNION ALL SELECT run_id, type, frame, player_id, team, outcome FROM sh))""",
    "fn": "(SELECT run_id, frame, row_number() OVER (PARTITION BY run_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM (SELECT DISTINCT run_id, frame FROM players))",
    "ad": """(SELECT run_id, team, CAST(CASE rk WHEN 1 THEN 1 ELSE -1 END AS BIGINT) AS direction FROM (SELECT run_id, team, row_number() OVER (PARTITION BY run_id ORDER BY xs[len(xs) // 2 + 1], team) AS rk, count(*) OVER (PARTITION BY run_id) AS teams
      FROM (SELECT p.run_id, t.team, list_sort(list(p.x)) AS xs FROM players p JOIN fn ON p.run_id = fn.run_id AND p.frame = fn.frame JOIN teams t ON p.player_id = t.player_id
        WHERE fn.i % greatest(1, fn.n // 50) = 0 AND t.team NOT IN ('referee', 'unknown') GROUP BY ALL)) WHERE teams >= 2 AND rk <= 2)""",
    "df": """(SELECT run_id, frame, CASE WHEN a IS NULL OR b IS NULL THEN 180.0::DOUBLE WHEN sqrt(a.vx*a.vx + a.vy*a.vy) < 1e-6 OR sqrt(b.vx*b.vx + b.vy*b.vy) < 1e-6 THEN 0.0::DOUBLE
        ELSE degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (a.vx*b.vx + a.vy*b.vy) / (sqrt(a.vx*a.vx + a.vy*a.vy) * sqrt(b.vx*b.vx + b.vy*b.vy)))))) END AS angle
      FROM (SELECT m.run_id, m.frame, arg_max({'vx': s.vx, 'vy': s.vy}, s.frame) FILTER (s.frame <= m.frame) AS a, arg_min({'vx': s.vx, 'vy': s.vy}, s.frame) FILTER (s.frame > m.frame) AS b
        FROM (SELECT DISTINCT run_id, end_frame AS frame FROM sp) m LEFT JOIN st s ON m.run_id = s.run_id AND s.vx IS NOT NULL AND s.frame BETWEEN m.frame - 7 AND m.frame + 7 GROUP BY ALL))""",
    "tk": f"""(SELECT t.run_id, t.frame, t.player_id, t.team, t.opponent_id, round(df.angle, 1) AS angle FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id, frame ORDER BY d, ord) AS rk FROM (
            SELECT a.run_id, a.end_frame AS frame, a.player_id AS opponent_id, b.team, p.player_id, p.ord, {_D} AS d FROM sp a JOIN sp b ON a.run_id = b.run_id AND b.span_id = a.span_id + 1 AND a.team <> b.team AND (b.start_frame - a.end_frame) / {P.fps} <= 8.0
            JOIN st s ON s.run_id = a.run_id AND s.frame = a.end_frame JOIN players p ON p.run_id = a.run_id AND p.frame = a.end_frame JOIN teams t ON t.player_id = p.player_id AND t.team = b.team AND t.team <> 'referee'
            WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.run_id = a.run_id AND ps.frame = a.end_frame))) t JOIN df ON t.run_id = df.run_id AND t.frame = df.frame WHERE rk = 1 AND d <= 30.0)""",
    "pk": f"(SELECT *, frame - lag(frame) OVER w AS df, (frame - lag(frame) OVER w) / {P.fps}::DOUBLE AS dt, sqrt((x - lag(x) OVER w)*(x - lag(x) OVER w) + (y - lag(y) OVER w)*(y - lag(y) OVER w)) AS d FROM players WINDOW w AS (PARTITION BY run_id, player_id ORDER BY frame, ord))",
}


_JUMPING = "(SELECT run_id, frame, x + CASE WHEN frame % 61 = 0 THEN 8.0::DOUBLE ELSE 0 END AS x, y, confidence FROM ball)"
_STRAYED = "(SELECT run_id, frame, ord, player_id, x + CASE WHEN ord = 7 AND frame // 200 % 2 = 1 THEN 7.0::DOUBLE ELSE 0 END AS x, y + CASE WHEN ord = 3 THEN 80.0::DOUBLE ELSE 0 END AS y FROM players)"


def _sql(select: str) -> str:
    return "WITH " + duckdb_views() + ",\n" + ",\n".join(f"{k} AS {v}" for k, v in _CTES.items()) + "\n" + select


ORACLE_SQL: dict = {
    name: _sql(select)
    for name, select in {
        "ball_states": "SELECT * FROM st",
        "nearest_player": "SELECT run_id, frame, player_id, team, distance FROM nr",
        "possession_spans": "SELECT * FROM sp",
        "bridge_passes": "SELECT * FROM ps",
        "interceptions": "SELECT * FROM ic",
        "goal_line_crossings": "SELECT * FROM gc",
        "match_events": "SELECT * FROM ev",
        "detected_shots": "SELECT run_id, type, frame, player_id, team, outcome, confidence, goal_side, cross_y, speed, approach, shooter_frame FROM sh",
        "player_kinematics": "SELECT run_id, player_id, count(*) AS observed_frames, round(coalesce(sum(d) FILTER (ok), 0), 2) AS distance_m, round(coalesce(max(d / dt) FILTER (ok), 0), 2) AS max_speed_mps, round(coalesce(sum(d) FILTER (ok) / sum(dt) FILTER (ok), 0), 2) AS avg_speed_mps FROM (SELECT *, coalesce(dt > 0 AND dt <= 1.0 AND d / dt <= 12.0, false) AS ok FROM pk) GROUP BY run_id, player_id",
        "team_stats": """SELECT run_id, team, round(share, 1) AS possession_pct, passes, successful, round(CASE WHEN passes > 0 THEN 100.0 * successful / passes ELSE 0 END, 1) AS pass_rate, shots, goals, tackles, interceptions FROM (
          SELECT *, 100.0 * frames / sum(frames) OVER (PARTITION BY run_id) AS share FROM (SELECT run_id, team, sum(f) AS frames, count(*) FILTER (type = 'pass') AS passes, count(*) FILTER (type = 'pass' AND outcome <> 'failed') AS successful,
            count(*) FILTER (type = 'shot') AS shots, count(*) FILTER (type = 'goal') AS goals, count(*) FILTER (type = 'tackle') AS tackles, count(*) FILTER (type = 'interception') AS interceptions
            FROM (SELECT run_id, team, type, outcome, 0 AS f FROM ev WHERE type <> 'possession' UNION ALL SELECT run_id, team, 'possession', NULL, greatest(1, end_frame - start_frame + 1) FROM sp UNION ALL SELECT run_id, team, 'tackle', NULL, 0 FROM tk) GROUP BY ALL)) WHERE team IS NOT NULL""",
        "player_stats": """SELECT run_id, player_id, coalesce(observed_frames, 0) AS observed_frames, coalesce(distance_m, 0) AS distance_m, coalesce(max_speed_mps, 0) AS max_speed_mps, coalesce(avg_speed_mps, 0) AS avg_speed_mps,
          coalesce(touches, 0) AS touches, coalesce(passes, 0) AS passes, coalesce(successful, 0) AS successful, coalesce(shots, 0) AS shots, coalesce(goals, 0) AS goals FROM
          (SELECT run_id, player_id, count(*) AS observed_frames, round(coalesce(sum(d) FILTER (ok), 0), 2) AS distance_m, round(coalesce(max(d / dt) FILTER (ok), 0), 2) AS max_speed_mps, round(coalesce(sum(d) FILTER (ok) / sum(dt) FILTER (ok), 0), 2) AS avg_speed_mps
            FROM (SELECT *, coalesce(dt > 0 AND dt <= 1.0 AND d / dt <= 12.0, false) AS ok FROM (SELECT *, (frame - lag(frame) OVER w) / 25.0::DOUBLE AS dt, sqrt((x - lag(x) OVER w)*(x - lag(x) OVER w) + (y - lag(y) OVER w)*(y - lag(y) OVER w)) AS d
              FROM players WHERE frame BETWEEN 250 AND 10000 WINDOW w AS (PARTITION BY run_id, player_id ORDER BY frame, ord))) GROUP BY run_id, player_id) k
          FULL JOIN (SELECT run_id, player_id, count(*) FILTER (type IN ('possession', 'pass', 'shot', 'carry')) AS touches, count(*) FILTER (type = 'pass') AS passes, count(*) FILTER (type = 'pass' AND outcome <> 'failed') AS successful,
            count(*) FILTER (type = 'shot') AS shots, count(*) FILTER (type = 'goal') AS goals FROM ev WHERE player_id IS NOT NULL AND round(frame / 25.0::DOUBLE, 2) BETWEEN 10.0 AND 400.02 GROUP BY ALL) c USING (run_id, player_id)""",
        "shot_dedup": """SELECT * FROM (WITH RECURSIVE sc AS (SELECT *, row_number() OVER (PARTITION BY run_id, type ORDER BY frame, confidence DESC) AS i FROM (SELECT run_id, type, frame, (frame * 37 % 101) / 100.0::DOUBLE AS confidence FROM ev WHERE type IN ('possession', 'pass'))),
          go AS (SELECT run_id, type, i, frame AS kept, confidence AS c, 1 AS slot FROM sc WHERE i = 1 UNION ALL
            SELECT s.run_id, s.type, s.i, CASE WHEN s.frame - g.kept > 100 OR s.confidence > g.c THEN s.frame ELSE g.kept END, CASE WHEN s.frame - g.kept > 100 OR s.confidence > g.c THEN s.confidence ELSE g.c END, g.slot + CASE WHEN s.frame - g.kept > 100 THEN 1 ELSE 0 END
            FROM go g JOIN sc s ON g.run_id = s.run_id AND g.type = s.type AND s.i = g.i + 1)
          SELECT run_id, type, arg_max(kept, i) AS frame, arg_max(c, i) AS confidence FROM go GROUP BY run_id, type, slot)""",
        "heatmap": "SELECT run_id, player_id, CAST(least(floor((x + 52.5::DOUBLE) / 105.0::DOUBLE * 40), 39) AS BIGINT) AS bin_x, CAST(least(floor((y + 34.0::DOUBLE) / 68.0::DOUBLE * 40), 39) AS BIGINT) AS bin_y, count(*) AS n FROM players WHERE abs(x) <= 52.5 AND abs(y) <= 34 GROUP BY ALL",
        "pass_network": "SELECT run_id, player_id, receiver_id, count(*) AS passes FROM ps WHERE outcome = 'successful' GROUP BY ALL",
        "pass_nodes": "SELECT run_id, player_id, count(*) AS touches, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM (SELECT run_id, player_id, x, y FROM ps WHERE outcome = 'successful' UNION ALL SELECT run_id, receiver_id, end_x, end_y FROM ps WHERE outcome = 'successful') GROUP BY run_id, player_id",
        "presence_runs": "SELECT run_id, player_id, min(frame) AS start_frame, max(frame) AS end_frame FROM (SELECT *, sum(CASE WHEN df > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, player_id ORDER BY frame) AS part FROM pk) GROUP BY run_id, player_id, part",
        "off_field": f"SELECT run_id, player_id, count(*) AS n, avg(CASE WHEN abs(x) > 54.0 OR abs(y) > 35.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS outside FROM {_STRAYED} GROUP BY run_id, player_id HAVING count(*) >= 30 AND avg(CASE WHEN abs(x) > 54.0 OR abs(y) > 35.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.85",
        "track_summary": "SELECT run_id, player_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n, round(avg(CASE WHEN abs(x) > 49.5 OR abs(y) > 31.0 OR x IS NULL OR y IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS edge_share FROM players GROUP BY run_id, player_id",
        "identity_switches": f"SELECT run_id, player_id, frame, d AS jump_m FROM (SELECT *, frame - lag(frame) OVER w AS df, sqrt((x - lag(x) OVER w)*(x - lag(x) OVER w) + (y - lag(y) OVER w)*(y - lag(y) OVER w)) AS d FROM {_STRAYED} WINDOW w AS (PARTITION BY run_id, player_id ORDER BY frame)) WHERE df <= 3 AND d >= 5.0",
        "event_counts": "SELECT run_id, type, count(*) AS n FROM ev GROUP BY run_id, type",
        "list_events": "SELECT run_id, type, frame, round(match_time, 2) AS time, player_id, team, outcome, count(*) OVER () > 50 AS truncated FROM ev WHERE type IN ('pass', 'shot') AND team = 'team_A' AND round(match_time, 2) BETWEEN 10.0 AND 500.0 ORDER BY run_id, frame, type, player_id LIMIT 50",
        "attack_directions": "SELECT * FROM ad",
        "carries": f"""SELECT run_id, start_frame AS frame, end_frame, player_id, team, round(total, 2) AS distance_m, round(forward, 2) AS forward_m FROM (
          SELECT *, sqrt(dx*dx + dy*dy) AS total, dx * direction AS forward FROM (
            SELECT s.run_id, s.start_frame, s.end_frame, s.player_id, s.team, b.x - a.x AS dx, b.y - a.y AS dy, coalesce(ad.direction, 1) AS direction FROM sp s
            JOIN (SELECT s.run_id, s.span_id, first(p.x ORDER BY abs(p.frame - s.start_frame), p.frame < s.start_frame) AS x, first(p.y ORDER BY abs(p.frame - s.start_frame), p.frame < s.start_frame) AS y
              FROM sp s JOIN players p ON s.run_id = p.run_id AND s.player_id = p.player_id AND p.frame BETWEEN s.start_frame - 5 AND s.start_frame + 5 GROUP BY ALL) a ON s.run_id = a.run_id AND s.span_id = a.span_id
            JOIN (SELECT s.run_id, s.span_id, first(p.x ORDER BY abs(p.frame - s.end_frame), p.frame < s.end_frame) AS x, first(p.y ORDER BY abs(p.frame - s.end_frame), p.frame < s.end_frame) AS y
              FROM sp s JOIN players p ON s.run_id = p.run_id AND s.player_id = p.player_id AND p.frame BETWEEN s.end_frame - 5 AND s.end_frame + 5 GROUP BY ALL) b ON s.run_id = b.run_id AND s.span_id = b.span_id
            LEFT JOIN ad ON s.run_id = ad.run_id AND s.team = ad.team WHERE (s.end_frame - s.start_frame) / {P.fps} >= {P.carry_seconds})) WHERE total >= {P.carry_total} OR forward >= {P.carry_forward}""",
        "deflections": "SELECT run_id, frame, round(angle, 3) AS angle FROM df",
        "tackles": "SELECT * FROM tk",
        "possession_at_frames": "SELECT s.run_id, s.frame, arg_max(p.player_id, p.span_id) AS player_id, arg_max(p.team, p.span_id) AS team FROM st s LEFT JOIN sp p ON s.run_id = p.run_id AND s.frame BETWEEN p.start_frame AND p.end_frame GROUP BY ALL",
        "nearest_opponents": f"""SELECT run_id, frame, player_id, opponent_id, rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY run_id, frame ORDER BY distance, ord) AS rank FROM (
          SELECT s.run_id, s.frame, s.player_id, p.player_id AS opponent_id, p.ord, {_D} AS distance FROM (SELECT n.run_id, n.frame, n.player_id, q.x, q.y, tq.team FROM nr n JOIN players q ON n.run_id = q.run_id AND n.frame = q.frame AND n.player_id = q.player_id
            JOIN teams tq ON tq.player_id = q.player_id WHERE tq.team IN ('team_A', 'team_B')) s JOIN players p ON s.run_id = p.run_id AND s.frame = p.frame JOIN teams t ON t.player_id = p.player_id AND t.team IN ('team_A', 'team_B') AND t.team <> s.team) WHERE distance <= 20.0) WHERE rank <= 3""",
        "buildup_starts": "SELECT g.run_id, g.frame, g.goal_side, CAST(greatest(0, coalesce(max(s.frame), greatest(0, g.frame - 250)) - 50) AS BIGINT) AS start_frame FROM gc g LEFT JOIN st s ON s.run_id = g.run_id AND s.frame BETWEEN greatest(0, g.frame - 250) AND g.frame - 1 AND ((g.goal_side = 'right' AND s.x < 0) OR (g.goal_side = 'left' AND s.x > 0)) GROUP BY g.run_id, g.frame, g.goal_side",
        "event_windows": "SELECT e.run_id, e.type, e.frame, e.player_id, greatest(0, e.frame - r) AS window_start, least(e.frame + r, m.last) AS window_end FROM (SELECT *, CASE WHEN type IN ('shot', 'goal') THEN 12 ELSE 50 END AS r FROM ev) e LEFT JOIN (SELECT run_id, max(frame) AS last FROM players GROUP BY run_id) m ON e.run_id = m.run_id",
        "events_near": "SELECT g.run_id, g.frame AS moment, e.type, count(*) AS n FROM (SELECT DISTINCT run_id, frame FROM gc) g JOIN ev e ON g.run_id = e.run_id AND abs(e.frame - g.frame) <= 75 GROUP BY ALL",
        "numbered_events": "SELECT run_id, type || '_' || lpad(CAST(row_number() OVER (PARTITION BY run_id, type ORDER BY frame, player_id NULLS FIRST) AS VARCHAR), 4, '0') AS event_id, type, frame, player_id FROM ev",
        "position_zones": """SELECT run_id, player_id, CASE WHEN outside THEN 'outside' WHEN mx < -36.0 THEN 'near_left_goal' WHEN mx > 36.0 THEN 'near_right_goal' WHEN abs(my) > 0.7::DOUBLE * 34.0 THEN 'sideline' ELSE 'midfield' END AS label,
          CASE WHEN outside THEN 'outside' WHEN mx < -36.0 THEN 'near_left_goal' WHEN mx > 36.0 THEN 'near_right_goal' ELSE CASE WHEN mx < -17.5 THEN 'left' WHEN mx > 17.5 THEN 'right' ELSE 'mid' END || '_' || CASE WHEN my > 0 THEN 'top' ELSE 'bot' END END AS scene
          FROM (SELECT *, abs(mx) > 53.0 OR abs(my) > 34.5 AS outside FROM (SELECT run_id, player_id, median(x) AS mx, median(y) AS my FROM players GROUP BY ALL))""",
        "referee_check": "SELECT run_id, player_id, count(*) >= 30 AND NOT (quantile_cont(x, 0.95) - quantile_cont(x, 0.05) < 3.0 AND quantile_cont(y, 0.95) - quantile_cont(y, 0.05) < 3.0 AND abs(median(y)) > 0.7::DOUBLE * 34.0) AS moves_like_one FROM players GROUP BY ALL",
        "cooccurring_pairs": "SELECT a.run_id, a.player_id AS a, b.player_id AS b, count(*) AS frames FROM players a JOIN players b ON a.run_id = b.run_id AND a.frame = b.frame AND a.player_id < b.player_id GROUP BY ALL",
        "ball_outliers": f"""SELECT run_id, frame, round(d, 6) AS deviation FROM (SELECT *, sqrt(power(x - (px + t * (nx - px)), 2) + power(y - (py + t * (ny - py)), 2)) AS d FROM (SELECT *, (frame - pf) / (nf - pf)::DOUBLE AS t, sqrt(power(nx - px, 2) + power(ny - py, 2)) / ((nf - pf) / {P.fps}) AS v
          FROM (SELECT *, lag(frame) OVER w AS pf, lead(frame) OVER w AS nf, lag(x) OVER w AS px, lead(x) OVER w AS nx, lag(y) OVER w AS py, lead(y) OVER w AS ny FROM {_JUMPING} WINDOW w AS (PARTITION BY run_id ORDER BY frame)))) WHERE v <= 30.0 AND d > 5.0""",
        "without_outliers": f"""SELECT run_id, frame, x, y, confidence FROM (SELECT *, coalesce(v <= 30.0 AND sqrt(power(x - (px + t * (nx - px)), 2) + power(y - (py + t * (ny - py)), 2)) > 5.0, false) AS gone FROM (SELECT *, (frame - pf) / (nf - pf)::DOUBLE AS t, sqrt(power(nx - px, 2) + power(ny - py, 2)) / ((nf - pf) / {P.fps}) AS v
          FROM (SELECT *, lag(frame) OVER w AS pf, lead(frame) OVER w AS nf, lag(x) OVER w AS px, lead(x) OVER w AS nx, lag(y) OVER w AS py, lead(y) OVER w AS ny FROM {_JUMPING} WINDOW w AS (PARTITION BY run_id ORDER BY frame)))) WHERE NOT gone""",
        "kicks": f"SELECT run_id, frame, jerk FROM (SELECT run_id, frame, round(sqrt(dx*dx + dy*dy), 6) AS jerk FROM (SELECT run_id, frame, x * 12 - 2 * lag(x * 12, 1) OVER w + lag(x * 12, 2) OVER w AS dx, y * 9 - 2 * lag(y * 9, 1) OVER w + lag(y * 9, 2) OVER w AS dy FROM {_JUMPING} WINDOW w AS (PARTITION BY run_id ORDER BY frame))) WHERE jerk > 50.0",
        "observation_gaps": "SELECT run_id, frame + 1 AS gap_start, nxt - 1 AS gap_end, frame AS left_anchor, nxt AS right_anchor FROM (SELECT run_id, frame, lead(frame) OVER (PARTITION BY run_id ORDER BY frame) AS nxt FROM ball) WHERE nxt - frame > 1",
        "moving_mean": "SELECT run_id, frame, CAST(sum(CAST(x * confidence AS DECIMAL(18,8))) OVER w AS DOUBLE) / CAST(sum(CAST(confidence AS DECIMAL(18,8))) OVER w AS DOUBLE) AS x, CAST(sum(CAST(y * confidence AS DECIMAL(18,8))) OVER w AS DOUBLE) / CAST(sum(CAST(confidence AS DECIMAL(18,8))) OVER w AS DOUBLE) AS y FROM ball WINDOW w AS (PARTITION BY run_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
        "spread_sample": "SELECT p.run_id, p.player_id, p.frame FROM (SELECT *, row_number() OVER (PARTITION BY run_id, player_id ORDER BY frame, ord) - 1 AS i, count(*) OVER (PARTITION BY run_id, player_id) AS n FROM players) p WHERE n <= 10 OR i IN (SELECT k * (p.n - 1) // 9 FROM range(10) r(k))",
        "projected_ball": "SELECT run_id, frame, round((12.0::DOUBLE*x + 1.5::DOUBLE*y + 960.0) / w, 4) AS px, round((0.5::DOUBLE*x - 9.0::DOUBLE*y + 540.0) / w, 4) AS py, round(x, 4) AS x, round(y, 4) AS y FROM (SELECT *, 0.0005::DOUBLE*x - 0.004::DOUBLE*y + 1.0 AS w FROM ball)",
        "box_steps": "SELECT run_id, player_id, frame, x1 + 30 - x1 AS w, y1 + 80 - y1 AS h, (x1 + (x1 + 30)) / 2 AS foot_x, round(CASE WHEN qx IS NOT NULL THEN wide * high / (4800.0 - wide * high) END, 6) AS overlap FROM (SELECT *, greatest(0.0::DOUBLE, 30 - abs(x1 - qx)) AS wide, greatest(0.0::DOUBLE, 80 - abs(y1 - qy)) AS high FROM (SELECT *, x * 10 AS x1, y * 10 AS y1, lag(x * 10) OVER v AS qx, lag(y * 10) OVER v AS qy FROM players WINDOW v AS (PARTITION BY run_id, player_id ORDER BY frame)))",
        "speed_percentiles": "SELECT run_id, count(*) AS n, " + ", ".join(f"round(quantile_cont(speed, {q / 100}), 6) AS p{q}" for q in (5, 25, 50, 75, 95)) + " FROM st GROUP BY run_id",
        "roster": "SELECT p.run_id, p.player_id, coalesce(t.team, 'unknown') AS team, CAST(NULL AS INT) AS jersey_number, CAST(NULL AS VARCHAR) AS role, p.frames FROM (SELECT run_id, player_id, count(*) AS frames FROM players WHERE NOT starts_with(player_id, 'unmapped-') GROUP BY ALL) p LEFT JOIN teams t ON p.player_id = t.player_id",
        "side_of_teams": "SELECT run_id, team, CASE WHEN row_number() OVER (PARTITION BY run_id ORDER BY mx, team) = 1 THEN 'left' ELSE 'right' END AS side FROM (SELECT p.run_id, t.team, avg(p.x) AS mx FROM players p JOIN teams t ON p.player_id = t.player_id WHERE t.team IN ('team_A', 'team_B') GROUP BY ALL)",
    }.items()
} | {
    "number_votes": """WITH v AS (SELECT l_suppkey AS track_id, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_linenumber <> 3 AND l_partkey % 120 BETWEEN 1 AND 99 AND CAST(least(1, l_discount * 10) AS DECIMAL(18,12)) > 0 THEN l_partkey % 120 END AS number, CAST(least(1, l_discount * 10) AS DECIMAL(18,12)) AS w FROM lineitem),
      s AS (SELECT track_id, number, sum(CASE WHEN number IS NULL THEN 0 ELSE w END) AS score, count(*) AS n, min(ord) AS first FROM v GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY number IS NULL, score DESC, first) AS rk FROM s)
      SELECT track_id, max(CASE WHEN rk = 1 THEN number END) AS number, round(CASE WHEN sum(score) > 0 THEN sqrt(CAST(max(score) AS DOUBLE) / sum(n) * CAST(max(score) AS DOUBLE) / CAST(sum(score) AS DOUBLE)) ELSE 0 END, 6) AS confidence, CAST(sum(n) AS BIGINT) AS readings FROM r GROUP BY track_id""",
    "similar_tracks": """WITH c AS (SELECT t // 20 AS run_id, t AS track_id, list(m ORDER BY pos) AS v FROM (SELECT vec_id // 5 AS t, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS m FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY ALL) GROUP BY ALL)
      SELECT * FROM (SELECT a.run_id, a.track_id AS a, b.track_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM c a JOIN c b ON a.run_id = b.run_id AND a.track_id < b.track_id) WHERE cosine >= 0.1""",
    "shirt_numbers": """SELECT event_id, CASE WHEN event_type <> 'error' THEN list_filter(list_transform(regexp_extract_all(lower(concat_ws(' ', event_type, props)), '\\b([0-9]{1,2})\\b', 1), lambda n: CAST(n AS BIGINT)), lambda n: n BETWEEN 1 AND 99)[1] END AS number FROM events""",
}

# ---- queries over detections, timelines, squads and texts
_MORE = " ,\n".join(f"{k} AS {v}" for k, v in R.CTES.items())
for _name, (_plan, _select) in R.ENTRIES.items():
    QUERIES[_name] = _query(lambda t, plan=_plan: plan(t, sys.modules[__name__]))
    ORACLE_SQL[_name] = "WITH " + duckdb_views() + ",\n" + ",\n".join(f"{k} AS {v}" for k, v in _CTES.items()) + ",\n" + _MORE + "\n" + _select
for _name, (_plan, _select) in N.ENTRIES.items():
    QUERIES[_name] = _query(_plan)
    ORACLE_SQL[_name] = "WITH " + duckdb_views() + ",\n" + ",\n".join(f"{k} AS {v}" for k, v in _CTES.items()) + ",\n" + _MORE + "\n" + _select
_SCANS = " ,\n".join(f"{k} AS {v}" for k, v in Y.CTES.items())
for _name, (_plan, _select) in Y.ENTRIES.items():
    QUERIES[_name] = _query(_plan)
    ORACLE_SQL[_name] = "WITH " + duckdb_views() + ",\n" + ",\n".join(f"{k} AS {v}" for k, v in _CTES.items()) + ",\n" + _SCANS + "\n" + _select
for _name, (_plan, _select) in Z.ENTRIES.items():
    QUERIES[_name] = _query(_plan)
    ORACLE_SQL[_name] = "WITH " + duckdb_views() + ",\n" + ",\n".join(f"{k} AS {v}" for k, v in Z.CTES.items()) + "\n" + _select
for _name, (_plan, _select) in U.ENTRIES.items():
    QUERIES[_name] = _query(_plan)
    ORACLE_SQL[_name] = "WITH " + duckdb_views() + "\n" + _select
_own, _own_sql = R.own_tables()
QUERIES |= _own
ORACLE_SQL |= _own_sql
QUERIES |= V.QUERIES
ORACLE_SQL |= V.ORACLE_SQL
