"""Ball kinematics, possession and match events as window and join plans over a run's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.presets import TEMPLATE, Preset
from ..plans.staging import stored

#: Longest step between two ball observations, and the fastest a ball is believed to move.
MAX_STEP_SECONDS, MAX_BALL_SPEED = 1.0, 60.0


def ball_states(ball: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame, x, y, vx, vy, speed of confident observations, median-smoothed over three.

    The first and last observation of a run keep their position, as do runs of under three.  A step
    over a second or past 60 m/s leaves the velocity null and the speed 0.
    """
    w = Window.partitionBy("run_id").orderBy("frame")
    seen = ball.where((F.coalesce("confidence", F.lit(0.0)) >= p.ball_confidence) & F.col("x").isNotNull() & F.col("y").isNotNull())
    near = seen.select("run_id", "frame", "x", "y", *(f(c).over(w).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("prev", F.lag), ("next", F.lead))))

    def middle(c):
        around = F.array(f"prev_{c}", c, f"next_{c}")
        return F.when(F.col(f"prev_{c}").isNull() | F.col(f"next_{c}").isNull(), F.col(c)).otherwise(F.element_at(F.array_sort(around), 2)).alias(c)

    smooth = near.select("run_id", "frame", middle("x"), middle("y"))
    steps = smooth.select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("frame", "x", "y")))
    dt = (F.col("frame") - F.col("p_frame")) / p.fps
    moved = steps.select("run_id", "frame", "x", "y", dt.alias("dt"), ((F.col("x") - F.col("p_x")) / dt).alias("vx"), ((F.col("y") - F.col("p_y")) / dt).alias("vy"))
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    ok = (F.col("dt") > 0) & (F.col("dt") <= MAX_STEP_SECONDS) & (speed <= MAX_BALL_SPEED)
    return moved.select("run_id", "frame", "x", "y", F.when(ok, F.col("vx")).alias("vx"), F.when(ok, F.col("vy")).alias("vy"), F.when(ok, speed).otherwise(F.lit(0.0)).alias("speed"))


def nearest_player(states: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """states and the nearest player of the same frame: player_id, team, distance; null where there is none.

    Referees don't count. Ties go to the lowest ord. The team table is a roster and left to Spark to broadcast by its size.
    """
    here = players.join(teams, "player_id", "left").select("run_id", "frame", "ord", "player_id", F.coalesce("team", F.lit("unknown")).alias("team"), F.col("x").alias("px"), F.col("y").alias("py")).where("team <> 'referee' AND px IS NOT NULL")
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    d = F.sqrt(dx * dx + dy * dy)
    found = F.when(F.col("player_id").isNotNull(), F.struct(d, F.col("ord")))
    own = [c for c in states.columns if c not in ("run_id", "frame")]
    best = states.join(here, ["run_id", "frame"], "left").groupBy("run_id", "frame").agg(*(F.first(c).alias(c) for c in own), F.min_by(F.struct("player_id", "team", d.alias("distance")), found).alias("n"))
    return best.select("run_id", "frame", *own, "n.player_id", "n.team", "n.distance")


def possession_spans(near: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, span_id, player_id, team, start_frame, end_frame, sx, sy, ex, ey: islands of one holder over observed ball frames."""
    w = Window.partitionBy("run_id").orderBy("frame")
    holder = F.when((F.col("speed") > p.possession_speed_break) | F.col("distance").isNull() | (F.col("distance") > p.possession_distance), None).otherwise(F.col("player_id"))
    held = near.select("run_id", "frame", "x", "y", "team", holder.alias("holder"))
    change = held.withColumn("new", (~F.col("holder").eqNullSafe(F.lag("holder").over(w))).cast("int"))
    islands = change.withColumn("island", F.sum("new").over(w)).where("holder IS NOT NULL")
    spans = islands.groupBy("run_id", "island").agg(
        F.first("holder").alias("player_id"), F.min_by("team", "frame").alias("team"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"),
        *(g(c, "frame").alias(n) for c, g, n in (("x", F.min_by, "sx"), ("y", F.min_by, "sy"), ("x", F.max_by, "ex"), ("y", F.max_by, "ey"))),
    )
    kept = spans.where((F.col("end_frame") - F.col("start_frame")) / p.fps >= p.possession_seconds)
    return kept.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("start_frame")).cast("long").alias("span_id"), "player_id", "team", "start_frame", "end_frame", "sx", "sy", "ex", "ey")


def bridge_passes(spans: DataFrame, states: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """Passes between consecutive spans of different players, with enough ball speed in between."""
    w = Window.partitionBy("run_id").orderBy("span_id")
    nxt = F.lead(F.struct("player_id", "team", "start_frame", "sx", "sy")).over(w)
    pairs = spans.withColumn("b", nxt).where(F.col("b").isNotNull() & (F.col("b.player_id") != F.col("player_id")))
    gap = F.col("b.start_frame") - F.col("end_frame")
    pairs = pairs.where((gap >= 0) & (gap / p.fps <= p.pass_transit_seconds))
    flights = pairs.withColumn("frame", F.explode(F.sequence("end_frame", "b.start_frame"))).join(states.select("run_id", "frame", "speed"), ["run_id", "frame"], "left")
    fastest = flights.groupBy("run_id", "span_id").agg(F.coalesce(F.max("speed"), F.lit(0.0)).alias("top_speed"))
    made = pairs.join(fastest, ["run_id", "span_id"]).where(F.col("top_speed") >= p.pass_speed)
    dx, dy = F.col("b.sx") - F.col("ex"), F.col("b.sy") - F.col("ey")
    return made.select(
        "run_id", F.col("end_frame").alias("frame"), "player_id", "team", F.col("b.player_id").alias("receiver_id"), F.col("b.team").alias("receiver_team"), F.col("b.start_frame").alias("end_frame"),
        F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("b.sx").alias("end_x"), F.col("b.sy").alias("end_y"),
        F.sqrt(dx * dx + dy * dy).alias("pass_length"), F.when(F.col("team") == F.col("b.team"), "successful").otherwise("failed").alias("outcome"),
    )


def interceptions(passes: DataFrame) -> DataFrame:
    """One per failed pass that somebody of a team received, by its receiver."""
    lost = passes.where("outcome = 'failed' AND receiver_id IS NOT NULL AND receiver_team IS NOT NULL")
    return lost.select("run_id", "frame", F.col("receiver_id").alias("player_id"), F.col("receiver_team").alias("team"), F.col("end_x").alias("x"), F.col("end_y").alias("y"))


def goal_line_crossings(states: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """Steps in which the ball leaves over a goal line from less than 10 m: interpolated frame (half to even) and y, the side, and whether it is between the posts.

    Where states have a height, cross_height is interpolated and not under 0; where they have a confidence, it is the mean of the step's.
    """
    w = Window.partitionBy("run_id").orderBy("frame")
    more = [c for c in ("height", "confidence") if c in states.columns]
    steps = states.select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("frame", "x", "y", *more)))
    dt = (F.col("frame") - F.col("p_frame")) / p.fps
    line = F.lit(p.half_length)
    crossed = steps.where((dt > 0) & (dt <= 1.0) & F.col("speed").between(p.shot_speed, 50.0) & (F.abs("p_x") <= line) & (F.abs("x") > line) & (F.abs("p_x") > line - 10.0) & (F.col("x") * F.col("p_x") > 0))
    part = (line - F.abs("p_x")) / (F.abs("x") - F.abs("p_x"))
    y = F.col("p_y") + part * (F.col("y") - F.col("p_y"))
    own = {"height": lambda: F.greatest(F.lit(0.0), F.col("p_height") + part * (F.col("height") - F.col("p_height"))).alias("cross_height"), "confidence": lambda: ((F.col("confidence") + F.col("p_confidence")) / 2).alias("confidence")}
    return crossed.select(
        "run_id", F.rint(F.col("p_frame") + part * (F.col("frame") - F.col("p_frame"))).cast("long").alias("frame"), F.when(F.col("x") > 0, "right").otherwise("left").alias("goal_side"),
        y.alias("cross_y"), "speed", (F.abs(y) <= p.goal_half_width).alias("is_goal"), *(own[c]() for c in more),
    )


def deduplicated(events: DataFrame, gap_seconds: float = 2.0, p: Preset = TEMPLATE) -> DataFrame:
    """events(run_id, type, frame, confidence, ...) without those that follow a kept one of their type too soon.

    By frame: one more than the gap after the last kept is kept; a nearer one takes its place if its
    confidence is greater, and then counts as the last kept. Only the run of events that are near one
    another has to be seen in order, so each chain of such events is folded on its own.
    """
    reach, w = int(gap_seconds * p.fps), Window.partitionBy("run_id", "type").orderBy("frame", F.desc("confidence"))
    own = [c for c in events.columns if c not in ("run_id", "type")]
    chains = events.withColumn("_new", (F.coalesce(F.col("frame") - F.lag("frame").over(w), F.lit(reach + 1)) > reach).cast("int")).withColumn("_chain", F.sum("_new").over(w))
    rows = F.array_sort(F.collect_list(F.struct(F.col("frame").alias("_at"), (-F.col("confidence")).alias("_less"), F.struct(*own).alias("_row"))))
    grouped = chains.groupBy("run_id", "type", "_chain").agg(rows.alias("rows"))

    def step(acc, e):
        last = F.element_at(acc, -1)
        far = e["_at"] - last["_at"] > reach
        better = e["_less"] < last["_less"]
        return F.when(F.size(acc) == 0, F.array(e)).when(far, F.array_append(acc, e)).when(better, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), e)).otherwise(acc)

    kept = grouped.select("run_id", "type", F.explode(F.aggregate("rows", F.slice("rows", 1, 0), step)).alias("e"))
    return kept.select("run_id", "type", *(F.col("e._row")[c].alias(c) for c in own)).select(*events.columns)


def last_holder(moments: DataFrame, spans: DataFrame) -> DataFrame:
    """moments(run_id, frame, ...) with player_id and team of the last span that ended by then: one pass over both in order of frames."""
    own = [c for c in moments.columns if c not in ("run_id", "frame")]
    ends = spans.select("run_id", F.col("end_frame").alias("frame"), F.struct("player_id", "team").alias("_s"), F.lit(0).alias("_kind"), *(F.lit(None).cast(moments.schema[c].dataType).alias(c) for c in own))
    asked = moments.select("run_id", "frame", F.lit(None).cast(ends.schema["_s"].dataType).alias("_s"), F.lit(1).alias("_kind"), *own)
    last = F.last("_s", True).over(Window.partitionBy("run_id").orderBy("frame", "_kind"))
    return ends.union(asked.select(*ends.columns)).withColumn("_last", last).where("_kind = 1").select("run_id", "frame", *own, F.col("_last.player_id").alias("player_id"), F.col("_last.team").alias("team"))
