"""Carries, tackles, build-ups and other plans that relate spans, events and players over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle_between, hypot
from ..plans.presets import TEMPLATE, Preset

#: How far, in frames, a player's position is looked for around a span's ends.
SEARCH_FRAMES = 5


def attack_directions(players: DataFrame, teams: DataFrame, samples: int = 50) -> DataFrame:
    """run_id, team, direction: of the teams seen on about fifty frames, that of the lower middle x attacks +1, the next -1."""
    w = Window.partitionBy("run_id")
    frames = players.select("run_id", "frame").distinct().select("run_id", "frame", (F.row_number().over(w.orderBy("frame")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    picked = frames.where(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / samples)) == 0).select("run_id", "frame")
    seen = players.join(picked, ["run_id", "frame"]).join(teams, "player_id").where("team NOT IN ('referee', 'unknown') AND x IS NOT NULL")
    xs = F.sort_array(F.collect_list("x"))  # at most players x sampled frames of one run
    middle = seen.groupBy("run_id", "team").agg(F.element_at(xs, (F.floor(F.count("x") / 2) + 1).cast("int")).alias("mid"))
    ranked = middle.select("run_id", "team", F.row_number().over(w.orderBy("mid", "team")).alias("rk"), F.count("*").over(w).alias("n"))
    return ranked.where("n >= 2 AND rk <= 2").select("run_id", "team", F.when(F.col("rk") == 1, 1).otherwise(-1).cast("long").alias("direction"))


def _position_at(spans: DataFrame, players: DataFrame, at: str) -> DataFrame:
    """(run_id, span_id, position) of the span's player at the frame nearest to `at`, the later of two."""
    offsets = F.array(*(F.lit(o) for o in range(-SEARCH_FRAMES, SEARCH_FRAMES + 1)))
    around = spans.select("run_id", "span_id", "player_id", F.col(at).alias("at"), F.explode(offsets).alias("off")).withColumn("frame", F.col("at") + F.col("off"))
    found = around.join(players.select("run_id", "player_id", "frame", "x", "y"), ["run_id", "player_id", "frame"]).where("x IS NOT NULL")
    return found.groupBy("run_id", "span_id").agg(F.min_by(F.struct("x", "y"), F.struct(F.abs("off"), F.col("off") < 0)).alias("position"))


def carries(spans: DataFrame, players: DataFrame, teams: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """Spans whose player moved far enough, or far enough forward: run_id, frame, end_frame, player_id, team, distance_m, forward_m."""
    long = spans.where((F.col("end_frame") - F.col("start_frame")) / p.fps >= p.carry_seconds)
    ends = _position_at(long, players, "start_frame").withColumnRenamed("position", "a").join(_position_at(long, players, "end_frame").withColumnRenamed("position", "b"), ["run_id", "span_id"])
    moved = long.join(ends, ["run_id", "span_id"]).join(attack_directions(players, teams), ["run_id", "team"], "left")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    total, forward = hypot(dx, dy), dx * F.coalesce("direction", F.lit(1))
    return moved.where((total >= p.carry_total) | (forward >= p.carry_forward)).select(
        "run_id", F.col("start_frame").alias("frame"), "end_frame", "player_id", "team", F.round(total, 2).alias("distance_m"), F.round(forward, 2).alias("forward_m")
    )


def deflections(moments: DataFrame, states: DataFrame, seconds: float = 0.3, p: Preset = TEMPLATE) -> DataFrame:
    """moments(run_id, frame) and angle: degrees between the ball's last velocity up to the frame and the first after it; 180 where one lacks."""
    reach = int(seconds * p.fps)
    near = moments.select("run_id", F.col("frame").alias("at")).distinct().withColumn("frame", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)))
    seen = near.join(states.where("vx IS NOT NULL").select("run_id", "frame", "vx", "vy"), ["run_id", "frame"])
    v, early = F.struct("vx", "vy"), F.col("frame") <= F.col("at")
    both = seen.groupBy("run_id", "at").agg(F.max_by(F.when(early, v), F.when(early, F.col("frame"))).alias("a"), F.min_by(F.when(~early, v), F.when(~early, F.col("frame"))).alias("b"))
    angle = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(180.0)).otherwise(angle_between(F.col("a.vx"), F.col("a.vy"), F.col("b.vx"), F.col("b.vy")))
    found = both.select("run_id", F.col("at").alias("frame"), angle.alias("angle"))
    return moments.join(found, ["run_id", "frame"], "left").withColumn("angle", F.coalesce("angle", F.lit(180.0)))


def tackles(spans: DataFrame, passes: DataFrame, states: DataFrame, players: DataFrame, teams: DataFrame, proximity: float = 2.0, min_angle: float = 30.0, max_gap_seconds: float = 1.0, p: Preset = TEMPLATE) -> DataFrame:
    """Changes of team without a pass, won by the nearest player of the other team: run_id, frame, player_id, team, opponent_id, angle."""
    w = Window.partitionBy("run_id").orderBy("span_id")
    pairs = spans.withColumn("b", F.lead(F.struct("team", "start_frame")).over(w)).where(F.col("b").isNotNull() & (F.col("b.team") != F.col("team")))
    pairs = pairs.where((F.col("b.start_frame") - F.col("end_frame")) / p.fps <= max_gap_seconds)
    turns = pairs.select("run_id", F.col("end_frame").alias("frame"), F.col("player_id").alias("opponent_id"), F.col("b.team").alias("team")).join(passes.select("run_id", "frame").distinct(), ["run_id", "frame"], "left_anti")
    at = turns.join(states.select("run_id", "frame", F.col("x").alias("bx"), F.col("y").alias("by")), ["run_id", "frame"])
    rivals = players.join(teams, "player_id").where("team <> 'referee' AND x IS NOT NULL")
    d = hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    nearest = at.hint("shuffle_hash").join(rivals, ["run_id", "frame", "team"]).groupBy("run_id", "frame", "team", "opponent_id").agg(F.min_by(F.struct("player_id", d.alias("d")), F.struct(d, F.col("ord"))).alias("n")).where(F.col("n.d") <= proximity)
    return deflections(nearest, states, p=p).where(F.col("angle") >= min_angle).select("run_id", "frame", F.col("n.player_id").alias("player_id"), "team", "opponent_id", F.round("angle", 1).alias("angle"))


def possession_at_frames(states: DataFrame, spans: DataFrame) -> DataFrame:
    """run_id, frame, player_id, team: who holds the ball at each observed frame; of overlapping spans the later counts."""
    held = spans.select("run_id", "span_id", "player_id", "team", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    last = held.groupBy("run_id", "frame").agg(F.max_by(F.struct("player_id", "team"), "span_id").alias("s"))
    return states.select("run_id", "frame").join(last, ["run_id", "frame"], "left").select("run_id", "frame", "s.player_id", "s.team")


def nearest_opponents(near: DataFrame, players: DataFrame, teams: DataFrame, k: int = 3, reach: float = 20.0) -> DataFrame:
    """run_id, frame, player_id, opponent_id, rank, distance: up to k opponents within reach of the player nearest to the ball."""
    where = players.join(teams, "player_id").where("team IN ('team_A', 'team_B') AND x IS NOT NULL").select("run_id", "frame", "ord", "player_id", "team", "x", "y")
    own = near.select("run_id", "frame", "player_id").join(where.select("run_id", "frame", "player_id", F.col("team").alias("own"), F.col("x").alias("ox"), F.col("y").alias("oy")), ["run_id", "frame", "player_id"])
    rival = where.withColumnsRenamed({"player_id": "opponent_id"})
    d = hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    pairs = own.join(rival, ["run_id", "frame"]).where(F.col("team") != F.col("own")).withColumn("distance", d).where(F.col("distance") <= reach)
    rank = F.row_number().over(Window.partitionBy("run_id", "frame").orderBy("distance", "ord")).cast("long")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("run_id", "frame", "player_id", "opponent_id", "rank", "distance")


def buildup_starts(goals: DataFrame, states: DataFrame, max_seconds: float = 10.0, padding_seconds: float = 2.0, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame, goal_side, start_frame: two seconds before the ball was last in the other half, at most ten before the goal."""
    back, pad = int(max_seconds * p.fps), int(padding_seconds * p.fps)
    earliest = F.greatest(F.lit(0), F.col("frame") - back)
    marks = goals.select("run_id", "frame", "goal_side", earliest.alias("earliest"))
    steps = marks.where(F.col("frame") > F.col("earliest")).withColumn("f", F.explode(F.sequence("earliest", F.col("frame") - 1)))
    seen = steps.join(states.select("run_id", F.col("frame").alias("f"), "x"), ["run_id", "f"]).where("(goal_side = 'right' AND x < 0) OR (goal_side = 'left' AND x > 0)")
    last = seen.groupBy("run_id", "frame", "goal_side").agg(F.max("f").alias("f"))
    return marks.join(last, ["run_id", "frame", "goal_side"], "left").select("run_id", "frame", "goal_side", F.greatest(F.lit(0), F.coalesce("f", "earliest") - pad).cast("long").alias("start_frame"))


def event_windows(events: DataFrame, players: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, type, frame, player_id, window_start, window_end: half a second around shots and goals, two around other moments, within the run.

    Events that have a start_frame and an end_frame and are no shots have these as their window.
    """
    shot = F.col("type").isin("shot", "goal")
    reach = F.when(shot, int(0.5 * p.fps)).otherwise(int(2.0 * p.fps))
    ends = players.groupBy("run_id").agg(F.max("frame").alias("last"))
    start, end = F.greatest(F.lit(0), F.col("frame") - reach), F.least(F.col("frame") + reach, F.col("last"))
    if {"start_frame", "end_frame"} <= set(events.columns):
        whole = ~shot & F.col("start_frame").isNotNull() & F.col("end_frame").isNotNull()
        start, end = F.when(whole, F.col("start_frame")).otherwise(start), F.when(whole, F.col("end_frame")).otherwise(end)
    return events.join(ends, "run_id", "left").select("run_id", "type", "frame", "player_id", start.cast("long").alias("window_start"), end.cast("long").alias("window_end"))


def events_near(moments: DataFrame, events: DataFrame, frames: int = 75) -> DataFrame:
    """run_id, moment, type, n: events by type within some frames of each moment; rows meet in buckets of that many frames."""
    bucket = lambda c: F.floor(F.col(c) / frames)
    at = moments.select("run_id", F.col("frame").alias("moment")).distinct()
    at = at.withColumn("bucket", F.explode(F.sequence(bucket("moment") - 1, bucket("moment") + 1)))
    near = at.join(events.select("run_id", "frame", "type", bucket("frame").alias("bucket")), ["run_id", "bucket"])
    return near.where(F.abs(F.col("frame") - F.col("moment")) <= frames).groupBy("run_id", "moment", "type").agg(F.count("*").alias("n"))


def numbered_events(events: DataFrame) -> DataFrame:
    """event_id (type and four digits, by frame, per run), run_id, type, frame, player_id."""
    w = Window.partitionBy("run_id", "type").orderBy("frame", "player_id")
    return events.select("run_id", F.concat("type", F.lit("_"), F.lpad(F.row_number().over(w).cast("string"), 4, "0")).alias("event_id"), "type", "frame", "player_id")
