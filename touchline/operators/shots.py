"""Shots that end at the goal line or near it, who took a kick, and what is no pass: windows over a run's ball states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.presets import TEMPLATE, Preset
from ..plans.staging import stored
from .events import deduplicated, goal_line_crossings
from .timelines import positions_before, sustained_kicks

#: Longest step and greatest speed that count, steps looked back at and observations looked ahead at.
LONGEST_STEP, TOP_SPEED, LOOK_BACK, LOOK_AHEAD = 2.0, 50.0, 10, 3
#: A slow approach: its least speed and steps, and how many times longer the ball must be lost after it.
SLOW_SPEED, SLOW_STEPS, SLOW_LOSS = 2.0, 4, 5.0
#: Least confidence of the ball in an approach; reach of a shooter in metres before a kick and at the nearest, depth before the goal in which a keeper stands.
LEAST_CONFIDENCE, HELD_REACH, NEAR_REACH, KEEPER_DEPTH = 0.15, 1.0, 3.0, 3.0


def approach_shots(states: DataFrame, min_speed: float | None = None, margin: float = 3.0, lost_seconds: float = 1.0, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame, goal_side, cross_y, speed of ball states within a margin of a goal line, moving towards it, that are shots.

    A fast one is if the ball is lost after the at most three states that stay near, if there is none
    later, or if it turns back fast; a slow one if at least four steps in a row approach the line and
    the ball is lost five times as long. Steps of over two seconds or past 50 m/s don't count.  Fast
    is the preset's shot speed unless given.  Where states have a confidence, those under 0.15 are no
    shots and the shot's is the mean of the step's; where they have a height, it is cross_height.
    """
    min_speed = p.shot_speed if min_speed is None else min_speed
    w = Window.partitionBy("run_id").orderBy("frame")
    lags = {f"p_{c}": F.lag(c).over(w) for c in ("frame", "x", "y")}
    leads = {f"{c}{j}": F.lead(c, j).over(w) for j in range(1, LOOK_AHEAD + 2) for c in ("frame", "x")}
    more = [c for c in ("confidence", "height") if c in states.columns]
    rows = states.select("run_id", "frame", "x", "y", *more).withColumns(lags | leads | ({"p_confidence": F.lag("confidence").over(w)} if "confidence" in more else {}))
    dx, dt = F.col("x") - F.col("p_x"), (F.col("frame") - F.col("p_frame")) / p.fps
    heading = F.when((dt > 0) & (dt <= LONGEST_STEP), F.signum(dx)).otherwise(F.lit(0.0))
    rows = rows.withColumns({"dx": dx, "dt": dt, "heading": heading})
    turned = (F.col("heading") == 0) | ~F.col("heading").eqNullSafe(F.lag("heading").over(w))
    rows = rows.withColumn("streak", F.sum(turned.cast("int")).over(w))
    back = Window.partitionBy("run_id", "streak").orderBy("frame").rowsBetween(1 - LOOK_BACK, 0)
    rows = rows.withColumns({"steps": F.count("dx").over(back), "way": F.sum(F.abs("dx")).over(back), "time": F.sum("dt").over(back)})

    side, lost = F.when(F.col("x") > 0, 1.0).otherwise(-1.0), int(lost_seconds * p.fps)
    dy = F.col("y") - F.col("p_y")
    speed = F.sqrt(F.col("dx") * F.col("dx") + dy * dy) / F.col("dt")
    near_line = (F.abs("x") > p.half_length - margin) & (F.abs("x") <= p.half_length)
    near = rows.withColumns({"side": side, "speed": speed}).where(near_line & (F.col("heading") == F.col("side")) & (F.col("speed") <= TOP_SPEED))

    def gap(limit):
        """Frames without the ball after the last state that follows closely and stays near; null where none comes after it."""
        at = lambda j: F.col(f"frame{j}") if j else F.col("frame")
        stays = lambda j: (at(j) - at(j - 1) <= limit) & (F.col("side") * F.col(f"x{j}") > F.col("side") * F.col("x") - 3.0)
        out = at(LOOK_AHEAD + 1) - at(LOOK_AHEAD)
        for j in range(LOOK_AHEAD, 0, -1):
            out = F.when(F.coalesce(stays(j), F.lit(False)), out).otherwise(at(j) - at(j - 1))
        return out

    away = F.col("side") * (F.col("x1") - F.col("x")) / ((F.col("frame1") - F.col("frame")) / p.fps) < -min_speed
    long_lost = int(SLOW_LOSS * lost_seconds * p.fps)
    fast = gap(lost).isNull() | (gap(lost) > lost) | F.coalesce(away, F.lit(False))
    slow = (F.col("steps") >= SLOW_STEPS) & (F.col("way") / F.col("time") >= SLOW_SPEED) & (gap(long_lost).isNull() | (gap(long_lost) >= long_lost))
    shot = F.when(F.col("speed") >= min_speed, fast).when(F.col("speed") >= SLOW_SPEED, slow)
    extra = {"confidence": (F.col("confidence") + F.col("p_confidence")) / 2, "height": F.col("height")} if more else {}
    sure = F.col("confidence") >= LEAST_CONFIDENCE if "confidence" in more else F.lit(True)
    names = {"confidence": "confidence", "height": "cross_height"}
    return near.where(shot & sure).select("run_id", "frame", F.when(F.col("side") > 0, "right").otherwise("left").alias("goal_side"), F.col("y").alias("cross_y"), "speed", *(extra[c].alias(names[c]) for c in more))


def shot_outcomes(crossings: DataFrame, states: DataFrame, window_seconds: float = 1.0, least: int = 2, goal_height: float = 2.44, p: Preset = TEMPLATE) -> DataFrame:
    """crossings(run_id, frame, goal_side, cross_y[, cross_height]) that the ball was seen to approach, with an outcome: goal or off_target.

    Approached means at least two ball states of the second before, up to the frame itself, in front
    of the line and less than 10 m from it. Without cross_height, only the width counts.
    """
    side = F.when(F.col("goal_side") == "right", 1.0).otherwise(-1.0)
    reach = int(window_seconds * p.fps)
    asked = crossings.select("run_id", F.col("frame").alias("shot"), "goal_side").distinct().withColumn("frame", F.explode(F.sequence(F.col("shot") - reach, F.col("shot"))))
    ahead = p.half_length - side * F.col("x")
    seen = asked.join(states.select("run_id", "frame", "x"), ["run_id", "frame"]).where((ahead > 0) & (ahead < 10.0))
    valid = seen.groupBy("run_id", F.col("shot").alias("frame"), "goal_side").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    inside = F.abs("cross_y") <= p.goal_half_width
    if "cross_height" in crossings.columns:
        inside = inside & (F.col("cross_height") <= goal_height + 0.5)
    return crossings.join(valid, ["run_id", "frame", "goal_side"], "left_semi").withColumn("outcome", F.when(inside, "goal").otherwise("off_target"))


def kick_holders(kicks: DataFrame, near: DataFrame, lookback_seconds: float, radius: float, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame, player_id, team: who had the ball before a kick, null if nobody.

    near has each frame's nearest player. Frames within the lookback vote for theirs, if within the
    radius, with weights that rise from 0.1 to 1; of players with equal votes the first one seen wins.
    """
    marks = kicks.select("run_id", F.col("frame").alias("kick")).distinct()
    start = F.greatest(F.lit(0), F.col("kick") - int(lookback_seconds * p.fps))
    asked = marks.withColumn("start", start).withColumn("frame", F.explode(F.sequence("start", "kick")))
    held = asked.join(near.where(F.col("player_id").isNotNull() & (F.col("distance") <= radius)).select("run_id", "frame", "player_id", "team"), ["run_id", "frame"])
    weight = 0.1 + 0.9 * (F.col("frame") - F.col("start")) / F.greatest(F.lit(1), F.col("kick") - F.col("start"))
    votes = held.groupBy("run_id", "kick", "player_id").agg(F.round(F.sum(weight), 9).alias("votes"), F.min("frame").alias("first"), F.max_by("team", "frame").alias("team"))
    best = votes.groupBy("run_id", "kick").agg(F.max_by(F.struct("player_id", "team"), F.struct("votes", -F.col("first"))).alias("b"))
    return marks.join(best, ["run_id", "kick"], "left").select("run_id", F.col("kick").alias("frame"), "b.player_id", "b.team")


def without_self_passes(passes: DataFrame) -> DataFrame:
    """passes(run_id, frame, player_id, receiver_id, ...) without those to oneself, numbered anew as event_id by frame."""
    kept = passes.where(F.col("player_id").isNull() | F.col("receiver_id").isNull() | (F.col("player_id") != F.col("receiver_id")))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("frame", "player_id", "receiver_id"))
    return kept.withColumn("event_id", F.format_string("pass_%04d", place))


def shot_moments(states: DataFrame, ball: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame, goal_side, cross_y, cross_height, speed, confidence, approach, outcome: crossings that were approached, and approaches that end before the line.

    A crossing needs at least two ball states in front of the line in the second before; an approach
    has been checked already. Between the posts and not half a metre over the bar it is a Goal, else
    Off_Target. A ball without heights is on the ground; the confidence is the mean of the step's.
    """
    height = F.coalesce("height", F.lit(0.0)) if "height" in ball.columns else F.lit(0.0)
    seen = stored(states.join(ball.select("run_id", "frame", "confidence", height.alias("height")), ["run_id", "frame"]), "observed")
    columns = ["run_id", "frame", "goal_side", "cross_y", "cross_height", "speed", "confidence"]
    crossings = shot_outcomes(goal_line_crossings(seen, p), seen, p=p).select(*columns, F.lit(False).alias("approach"))
    found = crossings.union(approach_shots(seen, p=p).select(*columns, F.lit(True)))
    inside = (F.abs("cross_y") <= p.goal_half_width) & (F.col("cross_height") <= p.goal_height + 0.5)
    return found.withColumn("outcome", F.when(inside, "Goal").otherwise("Off_Target"))


def shooters(moments: DataFrame, states: DataFrame, players: DataFrame, teams: DataFrame, kicks: DataFrame | None = None, back_seconds: float = 5.0, hold_seconds: float = 1.0, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame, goal_side, player_id, team, shooter_frame of moments(run_id, frame, goal_side): who took the shot.

    The kick is the last slow state before the ball stays fast up to the shot, else the last of
    kicks(run_id, frame) in the time looked back, else the shot's own frame.  Who was nearest to the
    ball within a metre in the second before it, by rising weights, is the shooter; where nobody was,
    whoever was last the nearest within three metres.  Referees and players within three metres of
    the goal line don't count. Without anyone, player and team are null and the frame is the shot's.
    """
    back, hold = int(back_seconds * p.fps), int(hold_seconds * p.fps)
    marks = moments.select("run_id", F.col("frame").alias("shot"), "goal_side").distinct()
    flown = sustained_kicks(moments, states, back_seconds, p=p).select("run_id", F.col("frame").alias("shot"), "kick_frame")
    marks = marks.join(flown, ["run_id", "shot"], "left")
    if kicks is not None:
        hit = marks.select("run_id", "shot").distinct().join(kicks.select("run_id", F.col("frame").alias("hit")), "run_id").where((F.col("hit") <= F.col("shot")) & (F.col("hit") >= F.col("shot") - back))
        marks = marks.join(hit.groupBy("run_id", "shot").agg(F.max("hit").alias("hit")), ["run_id", "shot"], "left").withColumn("kick_frame", F.coalesce("kick_frame", "hit"))
    kick = F.coalesce("kick_frame", "shot")
    asked = marks.select("run_id", "shot", "goal_side", kick.alias("kick"), F.explode(F.sequence(F.greatest(F.lit(0), kick - back), kick)).alias("frame"))
    goal_x = F.when(F.col("goal_side") == "right", p.half_length).otherwise(-p.half_length)
    body = players.join(teams, "player_id", "left").select("run_id", "frame", "ord", "player_id", F.coalesce("team", F.lit("unknown")).alias("team"), F.col("x").alias("px"), F.col("y").alias("py")).where("team <> 'referee' AND px IS NOT NULL")
    # Few frames are asked for: they are what is hashed, and the bodies of all frames are not sorted.
    near = asked.join(states.select("run_id", "frame", "x", "y"), ["run_id", "frame"]).hint("shuffle_hash").join(body, ["run_id", "frame"]).where(F.abs(F.col("px") - goal_x) >= KEEPER_DEPTH)
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    d = F.sqrt(dx * dx + dy * dy)
    shot = ["run_id", "shot", "goal_side"]
    near = near.groupBy(*shot, "kick", "frame").agg(F.min_by(F.struct("player_id", "team", d.alias("d")), F.struct(d, F.col("ord"))).alias("n")).select(*shot, "kick", "frame", "n.*")
    near = stored(near, "near-shots")
    start = F.greatest(F.lit(0), F.col("kick") - hold)
    weight = 0.1 + 0.9 * (F.col("frame") - start) / F.greatest(F.lit(1), F.col("kick") - start)
    votes = near.where((F.col("d") <= HELD_REACH) & (F.col("frame") >= start)).groupBy(*shot, "kick", "player_id").agg(F.round(F.sum(weight), 9).alias("votes"), F.min("frame").alias("first"), F.max_by("team", "frame").alias("team"))
    held = votes.groupBy(*shot).agg(F.max_by(F.struct("player_id", "team", F.col("kick").alias("at")), F.struct("votes", -F.col("first"))).alias("held"))
    last = near.where(F.col("d") <= NEAR_REACH).groupBy(*shot).agg(F.max_by(F.struct("player_id", "team", F.col("frame").alias("at")), "frame").alias("last"))
    found = marks.join(held, shot, "left").join(last, shot, "left").withColumn("s", F.coalesce("held", "last"))
    return found.select("run_id", F.col("shot").alias("frame"), "goal_side", "s.player_id", "s.team", F.coalesce("s.at", "shot").alias("shooter_frame"))


def detected_shots(states: DataFrame, ball: DataFrame, players: DataFrame, teams: DataFrame, kicks: DataFrame | None = None, gap_seconds: float = 2.0, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, type, frame, player_id, team, outcome, confidence, goal_side, cross_y, cross_height, speed, approach, shooter_frame, start_x, start_y: shots, and goals as events of their own.

    Crossings and approaches with their outcomes and shooters; of events of one type within two
    seconds the most confident one stays. The start is the ball's last place up to the shot, null if over 30 frames back.
    """
    moments = stored(shot_moments(states, ball, p), "moments")
    told = moments.join(shooters(moments, states, players, teams, kicks, p=p), ["run_id", "frame", "goal_side"], "left")
    told = positions_before(told, states).withColumnsRenamed({"x": "start_x", "y": "start_y"})
    shots = told.select("run_id", F.lit("shot").alias("type"), "frame", "player_id", "team", "outcome", "confidence", "goal_side", "cross_y", "cross_height", "speed", "approach", "shooter_frame", "start_x", "start_y")
    return deduplicated(shots.union(shots.where("outcome = 'Goal'").withColumn("type", F.lit("goal"))), gap_seconds, p)
