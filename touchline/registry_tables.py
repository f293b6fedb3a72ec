"""Queries over detections, timelines, squads and texts, and their SQL; registry.py takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from .engine import detect_events
from .functions import geometry as G
from .functions import text as X
from .operators import detections as B
from .operators import squads as Q
from .operators import stats as S
from .operators import timelines as L
from .sources import runs as N
from .streaming.presence import presence_sessions

TOTAL = 15_000  # frames that the shown events are cut at


def _boxes(t):
    c = F.col
    left, top = c("x") * 10 + 600, c("y") * 10 + 400
    return t["players"].select(
        "run_id", "frame", "ord", "player_id", "x", "y", left.alias("x1"), top.alias("y1"), (left + 20 + c("ord") % 7 * 15).alias("x2"), (top + 30 + c("ord") * 22).alias("y2"),
        ((c("frame") * 7 + c("ord") * 13) % 100 / 100.0).alias("confidence"), F.when(c("ord") % 6 == 5, 32).otherwise(0).alias("class"),
    )


def _own_boxes(t):
    """Each player's box of the frame, moved a little, as a track's."""
    near = lambda n, d: (F.col(n) + d).alias(n)
    return _boxes(t).select("run_id", "frame", F.col("ord").alias("track_id"), (F.col("frame") % 3).alias("time_since_update"), "x", "y", near("x1", 5), near("y1", 3), near("x2", 5), near("y2", 3))


def _frames(t):
    return t["players"].select("run_id", "frame").distinct()


def _anchors(t):
    f = F.col("frame")
    return _frames(t).where("frame % 30 = 7").select("run_id", "frame", (f * 13 % 360 / 10.0).alias("pan"), (f * 7 % 90 / 10.0).alias("tilt"), (50.0 + f % 11).alias("hfov"), (1.0 + f % 4).alias("weight"))


def _calibration(t):
    f = F.col("frame")
    return _frames(t).where("frame % 2 = 0").select(
        "run_id", "frame", (f % 10 != 4).alias("calibrated"), (f % 6 == 2).alias("interpolated"), (f * 31 % 400 / 10.0).alias("error"), (f * 17 % 100 / 100.0).alias("inlier_ratio"), (800.0 + f * 29 % 3000).alias("focal"),
        F.when(f % 50 != 0, F.array(F.lit(1.0), -(f % 7) / 1000.0, (f % 5) / 10.0, (f % 7) / 1000.0, F.lit(1.0), (f % 3) / 10.0, F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("h"),
    )


def _clusters(t):
    o = F.col("ord")
    seen = t["players"].groupBy("run_id", "player_id", "ord").agg(F.count("*").alias("frames"))
    return seen.select("run_id", (o % 6).alias("cluster"), F.col("ord").alias("track_id"), "ord", (o * 7 % 5 + 1).cast("int").alias("number"), (o * 3 % 10 / 10.0).alias("score"), (o * 11 % 10 / 10.0).alias("track_confidence"), F.when(o % 4 == 0, "unknown").when(o < 13, "team_A").otherwise("team_B").alias("team"), F.when(o == 9, "goalkeeper").when(o % 2 == 0, "player").otherwise("other").alias("role"), "frames")


def _chain(t, shift):
    f = F.col("frame")
    return _frames(t).where(f"frame % 5 <> {shift}").select("run_id", "frame", ((f + shift * 9) % 20).alias("distance"), ((f + shift) % 10 / 10.0).alias("confidence"), (1.0 + f % 7 + shift).alias("h0"), (2.0 + f % 3).alias("h8"))


def _shots(t, k):
    return k._events(t).where("type = 'shot'").select("run_id", "frame", "player_id", "team", "outcome")


def _lines(t):
    return t["players"].select("run_id", "frame", "ord", "x", "y", (F.col("x") + F.col("ord") * 3 - 7).alias("x2"), (F.col("y") + F.col("frame") % 13 - 6).alias("y2"))


def _intersections(t):
    a = _lines(t).select("run_id", "frame", F.col("ord").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("x", "y", "x2", "y2")))
    b = _lines(t).select("run_id", "frame", F.col("ord").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("x", "y", "x2", "y2")))
    x, y = G.meeting_point(*([F.col(f"{s}_{c}") for c in ("x", "y", "x2", "y2")] for s in "ab"))
    met = a.join(b, ["run_id", "frame"]).where("a < b").select("run_id", "frame", x.alias("x"), y.alias("y"))
    return met.groupBy("run_id", "frame").agg(F.count("*").alias("pairs"), F.count("x").alias("met"), F.count_if((F.abs("x") <= 52.5) & (F.abs("y") <= 34.0)).alias("on_field"))


def _errors(t, h):
    px, py = G.apply_homography(h, F.col("x"), F.col("y"))
    rows = t["ball"].select("run_id", "frame", G.hypot(px - (F.col("x") * 12 + 960), py - (F.col("y") * -9 + 540)).alias("e"))
    return rows.groupBy("run_id").agg(F.count("e").alias("n"), F.round(F.avg("e"), 6).alias("mean_error"))


def _rotations(t):
    a = lambda m, n: F.radians(F.col("frame") * m % n - n / 2)
    r = G.rotation(a(7, 170), F.radians(F.col("frame") % 80 + 40), a(3, 60))
    pan, tilt, roll = G.pan_tilt_roll(r)
    return _frames(t).select("run_id", "frame", *(F.round(v, 6).alias(n) for n, v in (("pan", F.degrees(pan)), ("tilt", F.degrees(tilt)), ("roll", F.degrees(roll)), ("r0", r[0]), ("r5", r[5]))))


def _middles(t):
    return t["players"].groupBy("run_id", "player_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


VIEW = (12.0, 1.5, 960.0, 0.5, -9.0, 540.0, 0.0005, -0.004, 1.0)
FIELD = (0.1, 0.0, -60.0, 0.0, 0.1, -40.0, 0.0, 0.0001, 1.0)

#: name: (plan of the tables t and the registry k, SQL).
ENTRIES = {
    "player_boxes": (lambda t, k: B.player_boxes(_boxes(t)).select("run_id", "frame", "ord"), "SELECT run_id, frame, ord FROM det WHERE y2 - y1 BETWEEN 50 AND 500 AND (x2 - x1) / (y2 - y1) BETWEEN 0.2 AND 1.5"),
    "ball_boxes": (lambda t, k: B.ball_boxes(_boxes(t)).select("run_id", "frame", "ord"), "SELECT run_id, frame, ord FROM det WHERE x2 - x1 BETWEEN 4 AND 120 AND y2 - y1 BETWEEN 4 AND 120 AND ((x2 - x1) / (y2 - y1) BETWEEN 0.5 AND 2.0 OR confidence >= 0.6)"),
    "in_image_band": (lambda t, k: B.in_image_band(_boxes(t), 900.0).select("run_id", "frame", "ord"), "SELECT run_id, frame, ord FROM det WHERE (y1 + y2) / 2 BETWEEN 0.15::DOUBLE * 900 AND 0.85::DOUBLE * 900"),
    "by_class": (lambda t, k: B.by_class(_boxes(t)).select("run_id", "frame", "ord", "kind"), "SELECT run_id, frame, ord, CASE class WHEN 0 THEN 'player' ELSE 'ball' END AS kind FROM det WHERE (class = 0 AND confidence >= 0.3) OR (class = 32 AND confidence >= 0.1)"),
    "on_field": (lambda t, k: B.on_field(_boxes(t), list(FIELD)).select("run_id", "frame", "ord", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")), "SELECT run_id, frame, ord, round(u, 6) AS x, round(v, 6) AS y FROM (SELECT *, (0.1::DOUBLE * (x1 + x2) / 2 - 60) / w AS u, (0.1::DOUBLE * f - 40) / w AS v FROM (SELECT *, 0.0001::DOUBLE * f + 1 AS w FROM (SELECT *, CASE WHEN class = 0 THEN y2 ELSE (y1 + y2) / 2 END AS f FROM det))) WHERE abs(u) <= 54.5 AND abs(v) <= 36.0"),
    "box_geometry": (lambda t, k: B.box_geometry(_boxes(t)), "SELECT run_id, frame, ord, (x1 + x2) / 2 AS foot_x, y2 AS foot_y, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y, (x2 - x1) * (y2 - y1) AS area FROM det"),
    "best_balls": (lambda t, k: B.best_balls(_boxes(t)), "SELECT run_id, frame, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id, frame ORDER BY score DESC, ord) AS rk FROM (SELECT *, 0.7::DOUBLE * confidence + 0.3::DOUBLE * (1.0 - abs(1.0 - (x2 - x1) / (y2 - y1))) AS score FROM det WHERE class = 32)) WHERE rk = 1"),
    "stage_totals": (lambda t, k: B.stage_totals(_boxes(t), list(FIELD)), """SELECT run_id, count(DISTINCT frame) AS n_frames, count(*) FILTER (class = 0) AS raw_players, count(*) FILTER (class = 32) AS raw_balls, count(*) FILTER (c) AS post_conf_players, count(*) FILTER (c AND s) AS post_size_players, count(*) FILTER (c AND s AND abs(u) <= 54.5 AND abs(v) <= 36.0) AS post_pitch_players
      FROM (SELECT *, class = 0 AND confidence >= 0.3 AS c, y2 - y1 BETWEEN 50 AND 500 AND (x2 - x1) / (y2 - y1) BETWEEN 0.2 AND 1.5 AS s, (0.1::DOUBLE * (x1 + x2) / 2 - 60) / (0.0001::DOUBLE * y2 + 1) AS u, (0.1::DOUBLE * y2 - 40) / (0.0001::DOUBLE * y2 + 1) AS v FROM det) GROUP BY run_id"""),
    "long_tracks": (lambda t, k: B.long_tracks(t["players"], 57.3), "SELECT run_id, player_id, count(*) AS n FROM players GROUP BY ALL HAVING count(*) >= 1432"),
    "ever_confirmed": (lambda t, k: B.ever_confirmed(t["players"].select("run_id", F.col("ord").alias("track_id"), "frame", ((F.col("frame") + F.col("ord")) % 700 == 13).alias("confirmed"))), "SELECT run_id, ord AS track_id, frame, (frame + ord) % 700 = 13 AS confirmed FROM players p WHERE EXISTS (SELECT 1 FROM players q WHERE q.run_id = p.run_id AND q.ord = p.ord AND (q.frame + q.ord) % 700 = 13)"),
    "pair_costs": (lambda t, k: B.pair_costs(_own_boxes(t), _boxes(t)).groupBy("run_id", "track_id", "ord").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"), F.round(F.sum("iou_cost"), 4).alias("iou_cost"), F.round(F.min("pitch_cost"), 6).alias("pitch_cost")),
        "SELECT run_id, track_id, ord, count(*) AS n, count(*) FILTER (d <= least(4.0 * (tsu + 1), 8.0)) AS allowed, round(sum(1.0 - shared / (a + b - shared)), 4) AS iou_cost, round(min(d), 6) AS pitch_cost FROM pc GROUP BY ALL"),
    "best_overlaps": (lambda t, k: B.best_overlaps(_own_boxes(t), _boxes(t)).select("run_id", "frame", "track_id", "ord", F.round("overlap", 6).alias("overlap")), "SELECT run_id, frame, track_id, ord, round(1.0 - c, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY run_id, frame, track_id ORDER BY 1.0 - c DESC, ord) AS rk FROM (SELECT *, 1.0 - shared / (a + b - shared) AS c FROM pc) WHERE 1.0 - c > 0.3) WHERE rk = 1"),
    "image_holders": (lambda t, k: B.image_holders(_boxes(t).where("ord = 5"), _boxes(t)), """SELECT b.run_id, b.frame, n.ord, n.d AS distance, CASE WHEN n.ord IS NULL THEN 'ball' ELSE 'player' END AS kind, coalesce(n.x1, b.x1) AS x1, coalesce(n.y1, b.y1) AS y1, coalesce(n.x2, b.x2) AS x2, coalesce(n.y2, b.y2) AS y2 FROM det b LEFT JOIN
      (SELECT *, row_number() OVER (PARTITION BY run_id, frame ORDER BY d, ord) AS rk FROM (SELECT p.*, sqrt(power((p.x1 + p.x2) / 2 - (b.x1 + b.x2) / 2, 2) + power(p.y2 - (b.y1 + b.y2) / 2, 2)) AS d FROM det b JOIN det p ON p.run_id = b.run_id AND p.frame = b.frame AND p.class = 0 WHERE b.ord = 5) WHERE d < 250) n
      ON n.run_id = b.run_id AND n.frame = b.frame AND n.rk = 1 WHERE b.ord = 5"""),
    "nearest_frames": (lambda t, k: L.nearest_frames(_frames(t), _anchors(t), reach=12), "SELECT f.run_id, f.frame, (SELECT a.frame FROM an a WHERE a.run_id = f.run_id AND abs(a.frame - f.frame) <= 12 ORDER BY abs(a.frame - f.frame), a.frame LIMIT 1) AS found_frame FROM (SELECT DISTINCT run_id, frame FROM players) f"),
    "interpolated_poses": (lambda t, k: L.interpolated(_frames(t), _anchors(t), ["pan", "tilt"]), "SELECT run_id, frame, CASE WHEN af IS NULL THEN bp WHEN bf IS NULL THEN ap ELSE ap + t * (bp - ap) END AS pan, CASE WHEN af IS NULL THEN bt WHEN bf IS NULL THEN att ELSE att + t * (bt - att) END AS tilt FROM br"),
    "interpolated_gaps": (lambda t, k: L.interpolated(_frames(t), _anchors(t).where("frame % 90 <> 37"), ["pan"], max_gap=30, clamp=False, easing="ease_in_out"), "SELECT run_id, frame, CASE WHEN af IS NOT NULL AND bf IS NOT NULL AND bf - af <= 30 THEN ap + CASE WHEN t < 0.5 THEN 2 * t * t ELSE 1 - power(2 - 2 * t, 2) / 2 END * (bp - ap) END AS pan FROM bg"),
    "smoothed_homographies": (lambda t, k: L.moving_means(_anchors(t), ["pan", "tilt", "hfov"], weight="weight", divide_by="hfov").select("run_id", "frame", "pan", "tilt"), "SELECT run_id, frame, (sum(pan * weight) OVER w / sum(weight) OVER w) / (sum(hfov * weight) OVER w / sum(weight) OVER w) AS pan, (sum(tilt * weight) OVER w / sum(weight) OVER w) / (sum(hfov * weight) OVER w / sum(weight) OVER w) AS tilt FROM an WINDOW w AS (PARTITION BY run_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "smoothed_cameras": (lambda t, k: L.moving_means(_anchors(t), ["pan", "tilt", "hfov"]), "SELECT run_id, frame, avg(pan) OVER w AS pan, avg(tilt) OVER w AS tilt, avg(hfov) OVER w AS hfov FROM an WINDOW w AS (PARTITION BY run_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "merged_both_ways": (lambda t, k: L.merged_both_ways(_chain(t, 1), _chain(t, 3), ["h0", "h8"], divide_by="h8"), """SELECT run_id, frame, CASE src WHEN 'both' THEN m0 / m8 ELSE m0 END AS h0, CASE src WHEN 'both' THEN m8 / m8 ELSE m8 END AS h8, conf AS confidence, src AS source FROM (SELECT coalesce(f.run_id, b.run_id) AS run_id, coalesce(f.frame, b.frame) AS frame, CASE WHEN f.frame IS NULL THEN 'backward' WHEN b.frame IS NULL THEN 'forward' ELSE 'both' END AS src,
      coalesce(w * f.h0 + (1 - w) * b.h0, f.h0, b.h0) AS m0, coalesce(w * f.h8 + (1 - w) * b.h8, f.h8, b.h8) AS m8, coalesce(w * f.c + (1 - w) * b.c, f.c, b.c) AS conf FROM (SELECT f.*, b.* FROM (SELECT 1)) RIGHT JOIN (SELECT 1) ON true)""".split(" FROM (SELECT f.*")[0] + """ FROM (SELECT f, b, (1.0::DOUBLE / (f.d + 1)) / (1.0::DOUBLE / (f.d + 1) + 1.0::DOUBLE / (b.d + 1)) AS w FROM
      (SELECT run_id, frame, (frame + 9) % 20 AS d, ((frame + 1) % 10) / 10.0::DOUBLE AS c, 2.0::DOUBLE + frame % 7 AS h0, 2.0::DOUBLE + frame % 3 AS h8 FROM fs WHERE frame % 5 <> 1) f FULL JOIN
      (SELECT run_id, frame, (frame + 27) % 20 AS d, ((frame + 3) % 10) / 10.0::DOUBLE AS c, 4.0::DOUBLE + frame % 7 AS h0, 2.0::DOUBLE + frame % 3 AS h8 FROM fs WHERE frame % 5 <> 3) b ON f.run_id = b.run_id AND f.frame = b.frame))"""),
    "drift": (lambda t, k: L.drift(_calibration(t)).select("run_id", "frame", F.round("cumulative", 6).alias("cumulative"), F.round("confidence", 6).alias("confidence")), """SELECT run_id, frame, round(cum, 6) AS cumulative, round(CASE WHEN frame % 50 = 0 THEN 0 ELSE least(1.0, inlier_ratio / 0.7::DOUBLE) * exp(-cum / 50.0) END, 6) AS confidence FROM (SELECT *, sum(CASE WHEN frame % 50 = 0 THEN 10.0::DOUBLE ELSE sqrt(power((frame % 5) / 10.0::DOUBLE, 2) + power((frame % 3) / 10.0::DOUBLE, 2)) + 10 * abs(asin((frame % 7) / 1000.0::DOUBLE)) END) OVER (PARTITION BY run_id ORDER BY frame) AS cum FROM cal)"""),
    "anchor_gaps": (lambda t, k: L.anchor_gaps(_anchors(t).where("frame % 90 <> 37"), 45), "SELECT * FROM (SELECT run_id, frame AS start_frame, lead(frame) OVER (PARTITION BY run_id ORDER BY frame) AS end_frame, lead(frame) OVER (PARTITION BY run_id ORDER BY frame) - frame AS gap FROM an WHERE frame % 90 <> 37) WHERE gap >= 45"),
    "turning_points": (lambda t, k: L.turning_points(_anchors(t), rate=-15.0), "SELECT run_id, sf AS start_frame, ef AS end_frame, t, CAST(floor(sf + t * (ef - sf)) AS BIGINT) AS frame FROM (SELECT *, turn / (2.0 * -15.0 * (ef - sf) / 25.0) + 0.5 AS t FROM (SELECT run_id, frame AS sf, lead(frame) OVER w AS ef, lead(pan) OVER w - pan AS turn FROM an WINDOW w AS (PARTITION BY run_id ORDER BY frame))) WHERE t BETWEEN 0.2 AND 0.8"),
    "warm_starts": (lambda t, k: L.warm_starts(_calibration(t)), "SELECT run_id, frame, coalesce(lag(error) OVER (PARTITION BY run_id ORDER BY frame) < 15, false) AS warm FROM cal"),
    "reanchor_frames": (lambda t, k: L.reanchor_frames(_calibration(t)), ""),  # its SQL stands below
    "focal_gate": (lambda t, k: L.focal_gate(_calibration(t), 1500.0).select("run_id", "frame", "focal"), "SELECT run_id, frame, focal FROM cal WHERE focal BETWEEN 750 AND 3000"),
    "key_frames": (lambda t, k: L.key_frames(_calibration(t).withColumnRenamed("error", "difference"), 38.0), "SELECT run_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame) AS i FROM cal) WHERE i = 1 OR error > 38"),
    "ratio_test": (lambda t, k: L.ratio_test(_boxes(t).select("run_id", F.col("frame").alias("query"), F.col("ord").alias("train"), (F.col("confidence") + 0.01).alias("distance"))), "SELECT run_id, frame AS query, ord AS train, d AS distance FROM (SELECT run_id, frame, ord, confidence + 0.01::DOUBLE AS d, row_number() OVER w AS rk, lead(confidence + 0.01::DOUBLE) OVER w AS s FROM det WINDOW w AS (PARTITION BY run_id, frame ORDER BY confidence + 0.01::DOUBLE, ord)) WHERE rk = 1 AND d < 0.75 * s"),
    "sustained_kicks": (lambda t, k: L.sustained_kicks(k._crossings(t), k.E.ball_states(t["ball"])), """SELECT g.run_id, g.frame, max(k.before) AS kick_frame FROM (SELECT DISTINCT run_id, frame FROM gc) g LEFT JOIN (SELECT g.run_id, g.frame AS goal, s.frame, s.speed, lag(s.frame) OVER w AS before, lag(s.speed) OVER w AS was, min(s.speed) OVER (PARTITION BY g.run_id, g.frame ORDER BY s.frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least
      FROM (SELECT DISTINCT run_id, frame FROM gc) g JOIN st s ON s.run_id = g.run_id AND s.frame BETWEEN greatest(0, g.frame - 125) AND g.frame WINDOW w AS (PARTITION BY g.run_id, g.frame ORDER BY s.frame)) k ON k.run_id = g.run_id AND k.goal = g.frame AND k.was <= 7 AND k.speed >= 10 AND k.least >= 8 GROUP BY ALL"""),
    "shot_map": (lambda t, k: L.positions_before(_shots(t, k), k.E.ball_states(t["ball"])).where("x IS NOT NULL"), """SELECT * FROM (SELECT e.run_id, e.frame, e.player_id, e.team, e.outcome, (SELECT s.x FROM st s WHERE s.run_id = e.run_id AND s.frame BETWEEN e.frame - 30 AND e.frame ORDER BY s.frame DESC LIMIT 1) AS x, (SELECT s.y FROM st s WHERE s.run_id = e.run_id AND s.frame BETWEEN e.frame - 30 AND e.frame ORDER BY s.frame DESC LIMIT 1) AS y FROM ev e WHERE type = 'shot') WHERE x IS NOT NULL"""),
    "list_players": (lambda t, k: Q.list_players(t["players"], t["teams"]), "SELECT p.run_id, row_number() OVER (PARTITION BY p.run_id ORDER BY n DESC, first) AS rank, p.player_id, coalesce(t.team, 'unknown') AS team, n AS frames FROM (SELECT run_id, player_id, count(*) AS n, min((frame, ord)) AS first FROM players GROUP BY ALL) p LEFT JOIN teams t ON p.player_id = t.player_id"),
    "list_teams": (lambda t, k: Q.list_teams(t["teams"], k._events(t)), "SELECT team FROM teams UNION SELECT team FROM ev WHERE team <> ''"),
    "cluster_numbers": (lambda t, k: Q.cluster_numbers(_clusters(t)), "SELECT run_id, cluster, arg_max(number, (s, -first)) AS number, arg_max(m, (s, -first)) AS confidence FROM (SELECT run_id, cluster, number, sum(CAST(score AS DECIMAL(18,6))) AS s, max(score) AS m, min(ord) AS first FROM cl WHERE track_confidence >= 0.25 GROUP BY ALL) GROUP BY ALL"),
    "cluster_teams": (lambda t, k: Q.cluster_teams(_clusters(t)), """SELECT r.run_id, r.cluster, coalesce(w.team, 'unknown') AS team, CASE WHEN r.gk THEN 'goalkeeper' ELSE r.role END AS role FROM (SELECT run_id, cluster, arg_max(role, (n, -first)) AS role, bool_or(role = 'goalkeeper') AS gk FROM (SELECT run_id, cluster, role, sum(frames) AS n, min(ord) AS first FROM cl GROUP BY ALL) GROUP BY ALL) r
      LEFT JOIN (SELECT run_id, cluster, arg_max(team, (n, -first)) AS team FROM (SELECT run_id, cluster, team, sum(frames) AS n, min(ord) AS first FROM cl WHERE team <> 'unknown' GROUP BY ALL) GROUP BY ALL) w ON r.run_id = w.run_id AND r.cluster = w.cluster"""),
    "majority_numbers": (lambda t, k: Q.majority(t["players"].select("run_id", "player_id", "frame", F.when(F.col("frame") % 4 != 0, F.col("frame") * 7 % 11).alias("number")), ["run_id", "player_id"], "number", "frame", last=40), """SELECT run_id, player_id, arg_max(number, (c, -first)) AS number, max(c) / CAST(sum(c) AS DOUBLE) AS share, CAST(sum(c) AS BIGINT) AS n FROM (SELECT run_id, player_id, frame * 7 % 11 AS number, count(*) AS c, min(frame) AS first FROM (SELECT *, row_number() OVER (PARTITION BY run_id, player_id ORDER BY frame DESC) AS back FROM players) WHERE back <= 40 AND frame % 4 <> 0 GROUP BY ALL) GROUP BY ALL"""),
    "calibration_stats": (lambda t, k: Q.calibration_stats(_calibration(t), True), "SELECT run_id, count(*) AS processed, count(*) FILTER (calibrated) AS calibrated, avg(CASE WHEN calibrated THEN 1.0::DOUBLE ELSE 0 END) AS rate, round(avg(error) FILTER (calibrated AND NOT interpolated), 6) AS mean_error, median(error) FILTER (calibrated AND NOT interpolated) AS median_error FROM cal GROUP BY ALL"),
    "error_buckets": (lambda t, k: Q.error_buckets(_calibration(t)), "SELECT run_id, CASE WHEN NOT calibrated THEN 'none' WHEN error < 5 THEN '<5' WHEN error < 15 THEN '<15' WHEN error < 30 THEN '<30' ELSE '>=30' END AS bucket, count(*) AS n FROM cal GROUP BY ALL"),
    "widest_frame": (lambda t, k: Q.widest_frame(t["players"]), "SELECT run_id, arg_max(frame, (n, -frame)) AS frame, max(n) AS n FROM (SELECT run_id, frame, count(*) AS n FROM players GROUP BY ALL) GROUP BY ALL"),
    "lifetimes": (lambda t, k: Q.lifetimes(t["players"]).withColumn("frames", F.sha2(F.concat_ws(",", F.col("frames").cast("array<string>")), 256)), "SELECT run_id, player_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n, sha256(string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame)) AS frames FROM players GROUP BY ALL"),
    "first_rows": (lambda t, k: Q.first_rows(t["players"].withColumn("player_id", F.concat(F.lit("G"), F.col("ord") % 8)), 200, 700), "SELECT run_id, 'G' || (ord % 8) AS player_id, frame, arg_min(x, ord) AS x, arg_min(y, ord) AS y FROM players WHERE frame BETWEEN 200 AND 700 GROUP BY run_id, ord % 8, frame"),
    "active_frames": (lambda t, k: Q.active_frames(k._spans(t).select("run_id", F.col("start_frame").alias("frame"), F.lit("possession").alias("type"), "start_frame", "end_frame").union(k._events(t).where("type <> 'possession'").select("run_id", "frame", "type", F.lit(None).cast("long"), F.lit(None).cast("long"))), TOTAL),
        "SELECT run_id, f AS frame, count(*) AS n FROM (SELECT run_id, unnest(range(a, b)) AS f FROM (SELECT run_id, frame AS a, least(frame + 50, 15000) AS b FROM ev WHERE type <> 'possession' UNION ALL SELECT run_id, start_frame, least(CASE WHEN start_frame <> 0 THEN end_frame ELSE start_frame END + 50, 15000) FROM sp)) GROUP BY ALL"),
    "timeline": (lambda t, k: Q.timeline(k.D.event_windows(k._events(t), t["players"]), 20), "SELECT * FROM (SELECT e.run_id, row_number() OVER (PARTITION BY e.run_id ORDER BY e.frame, e.type, e.player_id NULLS FIRST) AS place, e.type, e.frame, greatest(0, e.frame - r) AS window_start, least(e.frame + r, m.last) AS window_end FROM (SELECT *, CASE WHEN type IN ('shot', 'goal') THEN 12 ELSE 50 END AS r FROM ev WHERE type <> 'possession') e LEFT JOIN (SELECT run_id, max(frame) AS last FROM players GROUP BY run_id) m ON e.run_id = m.run_id) WHERE place <= 20"),
    "celebrations": (lambda t, k: Q.celebrations(k._events(t), TOTAL), "SELECT run_id, frame, match_time, least(frame + 250, 14999) AS celebration_end FROM ev WHERE type = 'goal'"),
    "ball_boxes_at": (lambda t, k: Q.ball_boxes_at(t["ball"]), "SELECT run_id, frame, x - 40 AS x1, y - 40 AS y1, x + 40 AS x2, y + 40 AS y2 FROM ball"),
    "without_tracks": (lambda t, k: Q.without_tracks(t["players"], k.S.off_field(t["players"], margin=-6.0, share=0.1).select("run_id", "player_id"), t["teams"]), "SELECT p.run_id, coalesce(t.team, 'unknown') AS team, count(DISTINCT p.player_id) AS players, count(*) AS rows FROM players p LEFT JOIN teams t ON p.player_id = t.player_id WHERE NOT EXISTS (SELECT 1 FROM (SELECT run_id, player_id FROM players GROUP BY ALL HAVING count(*) >= 30 AND avg(CASE WHEN abs(x) > 46.5 OR abs(y) > 28.0 THEN 1.0::DOUBLE ELSE 0 END) >= 0.1) o WHERE o.run_id = p.run_id AND o.player_id = p.player_id) GROUP BY ALL"),
    "nearest_centre": (lambda t, k: Q.nearest_centre(t["players"].select("run_id", F.col("ord").alias("track_id"), "frame", F.array("x", "y").alias("v")), {"a": (-20.0, 0.0), "b": (20.0, 5.0)}, 25.0), "SELECT run_id, ord AS track_id, CASE WHEN least(da, db) > 25 THEN 'referee' WHEN da <= db THEN 'a' ELSE 'b' END AS label, least(da, db) AS distance FROM (SELECT *, sqrt((x + 20) * (x + 20) + y * y) AS da, sqrt((x - 20) * (x - 20) + (y - 5) * (y - 5)) AS db FROM players)"),
    "zone_roles": (lambda t, k: Q.zone_roles(t["players"].select("run_id", F.concat("player_id", F.lit("@"), "frame").alias("player_id"), "x", "y")), "SELECT run_id, player_id || '@' || frame AS player_id, CASE WHEN abs(y) > 32 THEN 'linesman' WHEN abs(x) > 36 AND abs(y) < 0.6::DOUBLE * 34 THEN 'goalkeeper' ELSE 'player' END AS role FROM players"),
    "balances": (lambda t, k: Q.balances(k._events(t), "type", ("possession", "pass", "shot", "goal", "carry")), "SELECT r.run_id, v.type, count(e.type) AS n FROM (SELECT DISTINCT run_id FROM ev) r CROSS JOIN (VALUES ('possession'), ('pass'), ('shot'), ('goal'), ('carry')) v(type) LEFT JOIN ev e ON e.run_id = r.run_id AND e.type = v.type GROUP BY ALL"),
    "team_positions": (lambda t, k: S.of_team(t["players"], t["teams"], "team_B").select("run_id", "player_id", "frame", "x", "y"), "SELECT p.run_id, p.player_id, p.frame, p.x, p.y FROM players p JOIN teams t ON p.player_id = t.player_id WHERE t.team = 'team_B'"),
    "top_frames": (lambda t, k: Q.top_frames(_boxes(t).withColumn("area", (F.col("frame") * 37 % 101).cast("double")), 7), "SELECT run_id, player_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY run_id, player_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY run_id, player_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run_id, player_id ORDER BY frame * 37 % 101 DESC, frame) AS r FROM players) WHERE r <= 21) p WHERE n <= 7 OR i IN (SELECT j * p.n // 7 FROM range(7) q(j))"),
    "line_intersections": (lambda t, k: _intersections(t), """SELECT run_id, frame, count(*) AS pairs, count(*) FILTER (abs(den) >= 1e-10) AS met, count(*) FILTER (abs(den) >= 1e-10 AND abs(x + t * (x2 - x)) <= 52.5 AND abs(y + t * (y2 - y)) <= 34.0) AS on_field
      FROM (SELECT *, ((x - x3) * (y3 - y4) - (y - y3) * (x3 - x4)) / den AS t FROM (SELECT p.run_id, p.frame, p.x, p.y, p.x2, p.y2, q.x AS x3, q.y AS y3, q.x2 AS x4, q.y2 AS y4, (p.x - p.x2) * (q.y - q.y2) - (p.y - p.y2) * (q.x - q.x2) AS den FROM li p JOIN li q ON p.run_id = q.run_id AND p.frame = q.frame AND p.ord < q.ord)) GROUP BY ALL"""),
    "line_orientations": (lambda t, k: _lines(t).select("run_id", "frame", "ord", G.orientation(F.degrees(F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")))).alias("orientation")), "SELECT run_id, frame, ord, CASE WHEN CASE WHEN abs(a) > 90 THEN 180 - abs(a) ELSE abs(a) END < 20 THEN 'horizontal' WHEN CASE WHEN abs(a) > 90 THEN 180 - abs(a) ELSE abs(a) END > 70 THEN 'vertical' ELSE 'diagonal' END AS orientation FROM (SELECT *, degrees(atan2(y2 - y, x2 - x)) AS a FROM li)"),
    "reprojection_errors": (lambda t, k: _errors(t, list(VIEW)), "SELECT run_id, count(*) AS n, round(avg(sqrt(power((12.0::DOUBLE*x + 1.5::DOUBLE*y + 960.0) / w - (x * 12 + 960), 2) + power((0.5::DOUBLE*x - 9.0::DOUBLE*y + 540.0) / w - (y * -9 + 540), 2))), 6) AS mean_error FROM (SELECT *, 0.0005::DOUBLE*x - 0.004::DOUBLE*y + 1.0 AS w FROM ball) GROUP BY run_id"),
    "rotations": (lambda t, k: _rotations(t), "SELECT run_id, frame, round(CAST(frame * 7 % 170 - 85 AS DOUBLE), 6) AS pan, round(CAST(frame % 80 + 40 AS DOUBLE), 6) AS tilt, round(CAST(frame * 3 % 60 - 30 AS DOUBLE), 6) AS roll, round(cos(p) * cos(r) - sin(p) * cos(t) * sin(r), 6) AS r0, round(-cos(p) * sin(t), 6) AS r5 FROM (SELECT run_id, frame, radians(frame * 7 % 170 - 85) AS p, radians(frame % 80 + 40) AS t, radians(frame * 3 % 60 - 30) AS r FROM fs)"),
    "focal_lengths": (lambda t, k: _anchors(t).select("run_id", "frame", F.round(G.focal_of(F.col("hfov"), 1920.0), 6).alias("focal"), F.round(G.fov_of(G.focal_of(F.col("hfov"), 1920.0), 1920.0), 6).alias("hfov")), "SELECT run_id, frame, round(1920.0 / (2 * tan(radians(hfov) / 2)), 6) AS focal, round(hfov, 6) AS hfov FROM an"),
    "anchor_quality": (lambda t, k: _calibration(t).select("run_id", "frame", F.round(G.anchor_quality(F.col("inlier_ratio"), F.col("frame") % 15, F.when(F.col("calibrated"), F.col("error")), F.col("inlier_ratio"), F.col("frame") % 9), 6).alias("quality")), "SELECT run_id, frame, round(0.3::DOUBLE * inlier_ratio + 0.25::DOUBLE * least(1.0, (frame % 15) / 12.0::DOUBLE) + 0.2::DOUBLE * CASE WHEN calibrated THEN greatest(0.0, 1.0 - error / 20.0) ELSE 0 END + 0.15::DOUBLE * inlier_ratio + 0.1::DOUBLE * least(1.0, (frame % 9) / 6.0::DOUBLE), 6) AS quality FROM cal"),
    "detected_events": (lambda t, k: detect_events(t, names=("possession", "pass", "interception", "shot")).select("run_id", "type", "frame", "match_time", "player_id", "team", "outcome"), "SELECT * FROM ev"),
    "consolidated_tracks": (lambda t, k: N.consolidated(t["players"].select("run_id", "frame", F.col("ord").alias("track_id"), "x"), t["players"].where("ord % 3 <> 1").select("run_id", F.col("ord").alias("track_id"), "player_id", F.lit("team_A").alias("team"), F.lit("player").alias("role")).distinct()), "SELECT run_id, frame, ord AS track_id, x, CASE WHEN ord % 3 <> 1 THEN player_id ELSE 'unmapped-' || ord END AS player_id, CASE WHEN ord % 3 <> 1 THEN 'team_A' ELSE 'unknown' END AS team, CASE WHEN ord % 3 <> 1 THEN 'player' ELSE 'other' END AS role FROM players"),
    "tracking_statistics": (lambda t, k: N.tracking_statistics(t["players"].where("frame % 7 <> 0"), _frames(t)), "SELECT f.run_id, count(DISTINCT p.player_id) AS unique_tracks, count(p.player_id) / CAST(count(DISTINCT f.frame) AS DOUBLE) AS avg_tracks_per_frame FROM fs f LEFT JOIN players p ON f.run_id = p.run_id AND f.frame = p.frame AND p.frame % 7 <> 0 GROUP BY f.run_id"),
    "exported_boxes": (lambda t, k: N.exported_boxes(_boxes(t).withColumnRenamed("ord", "track_id")), "SELECT run_id, frame + 1 AS frame_id, ord AS track_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, confidence FROM det"),
    "event_records": (lambda t, k: N.event_records(k._passes(t).select("run_id", "frame", (F.col("frame") / 7).alias("match_time"), F.array(F.col("x") + 0.0013, F.col("y") + 0.0013).alias("start_position"))).select("run_id", "frame", "match_time", F.col("start_position")[0].alias("x"), F.col("start_position")[1].alias("y")), "SELECT run_id, frame, round(frame / 7.0::DOUBLE, 3) AS match_time, round(x + 0.0013::DOUBLE, 2) AS x, round(y + 0.0013::DOUBLE, 2) AS y FROM ps"),
    "clocks": (lambda t, k: _frames(t).select("run_id", "frame", X.clock(F.col("frame") * 4 / 100.0 - 1).alias("clock")), "SELECT run_id, frame, printf('%02d:%05.2f', CAST(floor(s / 60) AS BIGINT), s - floor(s / 60) * 60) AS clock FROM (SELECT *, greatest(0.0::DOUBLE, frame * 4 / 100.0::DOUBLE - 1) AS s FROM fs)"),
    "player_labels": (lambda t, k: _clusters(t).select("run_id", "track_id", X.player_label(F.col("team"), F.when(F.col("ord") % 3 == 0, F.col("number")), F.col("role"), F.col("ord")).alias("label")), "SELECT run_id, track_id, replace(team, 'team_', '') || '-' || CASE WHEN ord % 3 = 0 THEN CAST(number AS VARCHAR) WHEN role = 'goalkeeper' THEN 'GK' ELSE 'unk-' || lpad(CAST(ord AS VARCHAR), 2, '0') END AS label FROM cl"),
    "highlight_titles": (lambda t, k: k._events(t).select("run_id", "type", "frame", X.highlight_title(F.concat_ws("_", "type", "frame", "outcome")).alias("title"), X.safe_name(F.concat("player_id", F.lit("/ "), "type")).alias("file")), "SELECT run_id, type, frame, upper(type[1]) || type[2:] || ' · frame ' || frame || CASE WHEN outcome IS NULL THEN '' ELSE ' · ' || replace(outcome, '_', ' ') END AS title, player_id || '__' || type AS file FROM ev"),
}

CTES = {
    "det": "(SELECT run_id, frame, ord, player_id, x, y, x*10+600 AS x1, y*10+400 AS y1, x*10+600 + 20 + ord%7*15 AS x2, y*10+400 + 30 + ord*22 AS y2, ((frame*7+ord*13)%100)/100.0::DOUBLE AS confidence, CASE WHEN ord%6=5 THEN 32 ELSE 0 END AS class FROM players)",
    "pc": """(SELECT t.run_id, t.frame, t.ord AS track_id, d.ord, t.frame % 3 AS tsu, sqrt((d.x - t.x)*(d.x - t.x) + (d.y - t.y)*(d.y - t.y)) AS d, greatest(0.0, least(t.x2 + 5, d.x2) - greatest(t.x1 + 5, d.x1)) * greatest(0.0, least(t.y2 + 3, d.y2) - greatest(t.y1 + 3, d.y1)) AS shared,
      (t.x2 - t.x1) * (t.y2 - t.y1) AS a, (d.x2 - d.x1) * (d.y2 - d.y1) AS b FROM det t JOIN det d ON t.run_id = d.run_id AND t.frame = d.frame)""",
    "fs": "(SELECT DISTINCT run_id, frame FROM players)",
    "an": "(SELECT run_id, frame, (frame * 13 % 360) / 10.0::DOUBLE AS pan, (frame * 7 % 90) / 10.0::DOUBLE AS tilt, 50.0::DOUBLE + frame % 11 AS hfov, 1.0::DOUBLE + frame % 4 AS weight FROM fs WHERE frame % 30 = 7)",
    "br": "(SELECT *, CASE WHEN bf > af THEN (frame - af) / CAST(bf - af AS DOUBLE) ELSE 0 END AS t FROM (SELECT f.run_id, f.frame, a.frame AS af, a.pan AS ap, a.tilt AS att, b.frame AS bf, b.pan AS bp, b.tilt AS bt FROM fs f ASOF LEFT JOIN an a ON f.run_id = a.run_id AND f.frame >= a.frame ASOF LEFT JOIN an b ON f.run_id = b.run_id AND f.frame <= b.frame))",
    "bg": "(SELECT *, CASE WHEN bf > af THEN (frame - af) / CAST(bf - af AS DOUBLE) ELSE 0 END AS t FROM (SELECT f.run_id, f.frame, a.frame AS af, a.pan AS ap, b.frame AS bf, b.pan AS bp FROM fs f ASOF LEFT JOIN (SELECT * FROM an WHERE frame % 90 <> 37) a ON f.run_id = a.run_id AND f.frame >= a.frame ASOF LEFT JOIN (SELECT * FROM an WHERE frame % 90 <> 37) b ON f.run_id = b.run_id AND f.frame <= b.frame))",
    "cal": "(SELECT run_id, frame, frame % 10 <> 4 AS calibrated, frame % 6 = 2 AS interpolated, (frame * 31 % 400) / 10.0::DOUBLE AS error, (frame * 17 % 100) / 100.0::DOUBLE AS inlier_ratio, 800.0::DOUBLE + frame * 29 % 3000 AS focal FROM fs WHERE frame % 2 = 0)",
    "cl": "(SELECT run_id, ord % 6 AS cluster, ord AS track_id, ord, CAST(ord * 7 % 5 + 1 AS INT) AS number, (ord * 3 % 10) / 10.0::DOUBLE AS score, (ord * 11 % 10) / 10.0::DOUBLE AS track_confidence, CASE WHEN ord % 4 = 0 THEN 'unknown' WHEN ord < 13 THEN 'team_A' ELSE 'team_B' END AS team, CASE WHEN ord = 9 THEN 'goalkeeper' WHEN ord % 2 = 0 THEN 'player' ELSE 'other' END AS role, count(*) AS frames FROM players GROUP BY ALL)",
    "li": "(SELECT run_id, frame, ord, x, y, x + ord * 3 - 7 AS x2, y + frame % 13 - 6 AS y2 FROM players)",
}


def own_tables() -> tuple[dict, dict]:
    """(queries, SQL) over tables other than the match's."""

    def features(spark, sf_dir):
        track = F.floor(F.col("vec_id") / 5)
        return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(track / 20).alias("run_id"), track.alias("track_id"), "vec_id", "embedding")

    def gallery(spark, sf_dir):
        rows = features(spark, sf_dir)
        return Q.gallery_matches(rows.select("run_id", F.col("track_id").alias("query"), F.transform("embedding", lambda v: v.cast("double")).alias("v")).where("vec_id % 5 = 0"), Q.gallery_means(rows), 0.05)

    def readings(spark, sf_dir):
        raw = F.concat(F.substring("props", 6, 1), F.when(F.col("event_id") % 3 == 0, "S").when(F.col("event_id") % 3 == 1, "x").otherwise("O7"))
        both = F.array(F.struct(raw.alias("text"), (F.col("event_id") % 10 / 10.0).alias("score")), F.struct(F.col("event_type").alias("text"), F.lit(0.9).alias("score")))
        return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", X.best_reading(both).alias("b")).select("event_id", F.col("b.number").cast("long").alias("number"), "b.score")

    def answers(spark, sf_dir):
        said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("it is number "), (F.col("event_id") % 120).cast("string"))).otherwise(F.concat(F.lit('so: {"reading": '), (F.col("event_id") % 120).cast("string"), F.lit(', "crop_confidence": '), (F.col("event_id") % 13 / 10.0).cast("string"), F.lit(', "visible_digits": "d'), F.col("event_type"), F.lit('"}')))
        return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", X.json_reading(said).alias("r"), X.shows_a_back(F.concat(F.when(F.col("event_id") % 2 == 0, "partial: ").otherwise(""), F.substring(F.col("value").cast("string"), 1, 1))).alias("back")).select("event_id", F.col("r.reading").cast("long").alias("reading"), "r.confidence", "r.visible", "back")

    def listed_runs(spark, sf_dir):
        o = spark.read.parquet(f"{sf_dir}/orders.parquet")
        return N.runs_by_video(o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 20).alias("video"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date")).alias("started"))).select("video", "place", "run_id")

    def sessions(spark, sf_dir):
        seen = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("player_id"), "ts")
        out = presence_sessions(seen, "5 hours")
        return out.select("player_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"), "n")

    sql = {
        "runs_by_video": "SELECT o_custkey % 20 AS video, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END DESC NULLS LAST, o_orderkey) AS place, o_orderkey AS run_id FROM orders",
        "presence_sessions": """SELECT user_id AS player_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 5 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, part""",
        "gallery_matches": """WITH e AS (SELECT vec_id // 100 AS run_id, vec_id // 5 AS t, vec_id, embedding FROM embeddings), c AS (SELECT run_id, t, list(m ORDER BY pos) AS v FROM (SELECT run_id, t, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS m FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS pos FROM e) GROUP BY ALL) GROUP BY ALL)
          SELECT * FROM (SELECT run_id, query, arg_max(track_id, (s, -track_id)) AS track_id, round(max(s), 6) AS similarity FROM (SELECT e.run_id, e.t AS query, c.t AS track_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v) AS s FROM e JOIN c ON e.run_id = c.run_id AND e.t <> c.t WHERE e.vec_id % 5 = 0) GROUP BY ALL) WHERE similarity >= 0.05""",
        "best_readings": """SELECT event_id, best.d AS number, best.s AS score FROM (SELECT event_id, list_reduce(list_prepend({'d': NULL::BIGINT, 's': NULL::DOUBLE}, list_transform(list_filter([{'d': d1, 's': (event_id % 10) / 10.0::DOUBLE}, {'d': d2, 's': 0.9::DOUBLE}], lambda r: r.s >= 0.5 AND regexp_full_match(r.d, '[0-9]{1,2}') AND try_cast(r.d AS INT) BETWEEN 1 AND 99), lambda r: {'d': CAST(r.d AS BIGINT), 's': r.s})), lambda x, y: CASE WHEN x.s IS NULL OR y.s > x.s THEN y ELSE x END) AS best
          FROM (SELECT event_id, regexp_replace(props[6:6], '[^0-9]', '', 'g') || CASE event_id % 3 WHEN 0 THEN '5' WHEN 1 THEN '' ELSE '07' END AS d1, regexp_replace(translate(event_type, 'OoQDlIiZzBSsT', '0000111228557'), '[^0-9]', '', 'g') AS d2 FROM events))""",
        "json_readings": """SELECT event_id, CASE WHEN n BETWEEN 1 AND 99 THEN n END AS reading, CASE WHEN NOT n BETWEEN 1 AND 99 THEN 0.0::DOUBLE WHEN event_id % 4 = 0 THEN 0.5 ELSE least(1.0, (event_id % 13) / 10.0::DOUBLE) END AS confidence, CASE WHEN event_id % 4 = 0 THEN 'it is number ' || n ELSE 'd' || event_type END AS visible, regexp_matches(CAST(value AS VARCHAR), '^[0-9]') AS back FROM (SELECT *, event_id % 120 AS n FROM events)""",
    }
    return {"gallery_matches": gallery, "best_readings": readings, "json_readings": answers, "runs_by_video": listed_runs, "presence_sessions": sessions}, sql

ENTRIES["reanchor_frames"] = (
    ENTRIES["reanchor_frames"][0],
    f"""SELECT d.run_id, d.frame FROM ({ENTRIES["drift"][1]}) d JOIN (SELECT run_id, frame, avg(inlier_ratio) OVER w AS m, count(*) OVER w AS n FROM cal WINDOW w AS (PARTITION BY run_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) c ON c.run_id = d.run_id AND c.frame = d.frame
      WHERE d.cumulative > 50 OR d.confidence < 0.3 OR (n >= 3 AND m < 0.4)""",
)
