"""Player, team and field statistics over tracks and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.presets import TEMPLATE, Preset

MAX_GAP_SECONDS, MAX_PLAYER_SPEED = 1.0, 12.0


def player_kinematics(players: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, player_id, observed_frames, distance_m, max_speed_mps, avg_speed_mps; steps over a second or past 12 m/s don't count."""
    w = Window.partitionBy("run_id", "player_id").orderBy("frame", "ord")
    steps = players.select("run_id", "player_id", "frame", "x", "y", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("frame", "x", "y")))
    dt = (F.col("frame") - F.col("p_frame")) / p.fps
    dx, dy = F.col("x") - F.col("p_x"), F.col("y") - F.col("p_y")
    d = F.sqrt(dx * dx + dy * dy)
    ok = (dt > 0) & (dt <= MAX_GAP_SECONDS) & (d / dt <= MAX_PLAYER_SPEED)
    rows = steps.select("run_id", "player_id", F.when(ok, d).alias("d"), F.when(ok, d / dt).alias("v"), F.when(ok, dt).alias("dt"))
    return rows.groupBy("run_id", "player_id").agg(
        F.count("*").alias("observed_frames"), F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 2).alias("distance_m"), F.round(F.coalesce(F.max("v"), F.lit(0.0)), 2).alias("max_speed_mps"),
        F.round(F.coalesce(F.sum("d") / F.sum("dt"), F.lit(0.0)), 2).alias("avg_speed_mps"),
    )


TOUCHES = ("possession", "pass", "shot", "carry")


def player_stats(players: DataFrame, events: DataFrame, seconds: tuple | None = None, p: Preset = TEMPLATE) -> DataFrame:
    """player_kinematics() with touches, passes, successful passes, shots and goals; players of either table.

    seconds bounds tracks by frames cut to whole ones and events by time rounded to 2 places, ends included.
    A pass is successful unless its outcome is 'failed'.
    """
    if seconds:
        players = players.where(F.col("frame").between(int(seconds[0] * p.fps), int(seconds[1] * p.fps)))
        events = events.where(F.round(F.col("frame") / p.fps, 2).between(*seconds))
    is_type = lambda t: F.col("type") == t
    counts = events.where("player_id IS NOT NULL").groupBy("run_id", "player_id").agg(
        F.count_if(F.col("type").isin(*TOUCHES)).alias("touches"), F.count_if(is_type("pass")).alias("passes"),
        F.count_if(is_type("pass") & (F.coalesce("outcome", F.lit("")) != "failed")).alias("successful"), F.count_if(is_type("shot")).alias("shots"), F.count_if(is_type("goal")).alias("goals"),
    )
    both = player_kinematics(players, p).join(counts, ["run_id", "player_id"], "full")
    return both.select("run_id", "player_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in both.columns[2:]))


def team_stats(events: DataFrame) -> DataFrame:
    """run_id, team, possession_pct of all spans' frames, and counts of passes, successful passes with their rate in percent, shots, goals, tackles and interceptions.

    events(run_id, type, frame, end_frame, team, outcome). Frames of spans without a team count in the total.
    """
    is_type = lambda t: F.col("type") == t
    held = F.when(is_type("possession"), F.greatest(F.lit(1), F.col("end_frame") - F.col("frame") + 1)).otherwise(0)
    sums = events.groupBy("run_id", "team").agg(
        F.sum(held).alias("frames"), F.count_if(is_type("pass")).alias("passes"), F.count_if(is_type("pass") & (F.coalesce("outcome", F.lit("")) != "failed")).alias("successful"),
        *(F.count_if(is_type(t)).alias(t + "s") for t in ("shot", "goal", "tackle", "interception")),
    )
    share = F.when(F.sum("frames").over(Window.partitionBy("run_id")) > 0, 100.0 * F.col("frames") / F.sum("frames").over(Window.partitionBy("run_id"))).otherwise(0.0)
    rate = F.when(F.col("passes") > 0, 100.0 * F.col("successful") / F.col("passes")).otherwise(0.0)
    with_share = sums.withColumn("share", share).where("team IS NOT NULL")
    return with_share.select("run_id", "team", F.round("share", 1).alias("possession_pct"), "passes", "successful", F.round(rate, 1).alias("pass_rate"), "shots", "goals", "tackles", "interceptions")


def of_team(players: DataFrame, teams: DataFrame, team: str) -> DataFrame:
    """Rows of players whose assigned team, or own team where the rows have one, is the given one."""
    named = players.join(teams.select("player_id", F.col("team").alias("_assigned")), "player_id", "left")
    own = F.col("team") == team if "team" in players.columns else F.lit(False)
    return named.where((F.col("_assigned") == team) | own).select(*players.columns)


def heatmap(players: DataFrame, bins: int = 40, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, player_id, bin_x, bin_y, n; the last bin is closed on the right, points off the field are dropped."""
    cell = lambda c, half: F.least(F.floor((F.col(c) + half) / (2 * half) * bins), F.lit(bins - 1)).cast("long")
    on = players.where((F.abs("x") <= p.half_length) & (F.abs("y") <= p.half_width))
    return on.select("run_id", "player_id", cell("x", p.half_length).alias("bin_x"), cell("y", p.half_width).alias("bin_y")).groupBy("run_id", "player_id", "bin_x", "bin_y").agg(F.count("*").alias("n"))


def pass_network(passes: DataFrame, min_passes: int = 2) -> DataFrame:
    """run_id, player_id, receiver_id, passes of edges with at least min_passes passes that didn't fail."""
    return passes.where("outcome <> 'failed'").groupBy("run_id", "player_id", "receiver_id").agg(F.count("*").alias("passes")).where(F.col("passes") >= min_passes)


def pass_nodes(passes: DataFrame) -> DataFrame:
    """run_id, player_id, touches and mean position over both ends of passes that didn't fail."""
    good = passes.where("outcome <> 'failed'")
    points = good.select("run_id", "player_id", "x", "y").union(good.select("run_id", "receiver_id", "end_x", "end_y"))
    return points.groupBy("run_id", "player_id").agg(F.count("*").alias("touches"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.avg("y"), 6).alias("mean_y"))


def presence_runs(players: DataFrame, max_gap_seconds: float = 1.0, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, player_id, start_frame, end_frame of stretches whose frames lie at most a second apart."""
    w = Window.partitionBy("run_id", "player_id").orderBy("frame")
    far = max(1, int(max_gap_seconds * p.fps))
    marked = players.select("run_id", "player_id", "frame", F.coalesce(F.col("frame") - F.lag("frame").over(w) > far, F.lit(False)).cast("int").alias("new"))
    return marked.withColumn("part", F.sum("new").over(w)).groupBy("run_id", "player_id", "part").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).drop("part")


def off_field(players: DataFrame, margin: float = 1.5, share: float = 0.85, min_obs: int = 30, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, player_id, n, outside of players mostly beyond the lines plus a margin."""
    out = (F.abs("x") > p.half_length + margin) | (F.abs("y") > p.half_width + margin)
    return players.groupBy("run_id", "player_id").agg(F.count("*").alias("n"), F.avg(out.cast("double")).alias("outside")).where((F.col("n") >= min_obs) & (F.col("outside") >= share))


def track_summary(players: DataFrame, margin: float = 3.0, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, player_id, first_frame, last_frame, n, edge_share: how much of a track lies within 3 m of a line or beyond; rows without a place count as such."""
    edge = F.coalesce((F.abs("x") > p.half_length - margin) | (F.abs("y") > p.half_width - margin), F.lit(True))
    return players.groupBy("run_id", "player_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n"), F.round(F.avg(edge.cast("double")), 3).alias("edge_share"))


def identity_switches(players: DataFrame, stride: int = 1, jump: float = 5.0) -> DataFrame:
    """Jumps of at least 5 m within three strides: run_id, player_id, frame, jump_m."""
    w = Window.partitionBy("run_id", "player_id").orderBy("frame")
    steps = players.select("run_id", "player_id", "frame", "x", "y", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("frame", "x", "y")))
    dx, dy = F.col("x") - F.col("p_x"), F.col("y") - F.col("p_y")
    d = F.sqrt(dx * dx + dy * dy)
    return steps.where((F.col("frame") - F.col("p_frame") <= 3 * stride) & (d >= jump)).select("run_id", "player_id", "frame", d.alias("jump_m"))


def event_counts(events: DataFrame) -> DataFrame:
    """run_id, type, n."""
    return events.groupBy("run_id", "type").agg(F.count("*").alias("n"))


def list_events(events: DataFrame, types=None, team: str | None = None, player_id: str | None = None, seconds: tuple | None = None, limit: int = 50) -> DataFrame:
    """The first events in order that pass the given filters; times are compared rounded to 2 places, both ends included.

    truncated says whether there are more: one row over the limit is looked for and dropped.
    """
    time = F.round("match_time", 2)
    if types:
        events = events.where(F.col("type").isin(*types))
    if team:
        events = events.where(F.col("team") == team)
    if player_id:
        events = events.where(F.col("player_id") == player_id)
    if seconds:
        events = events.where(time.between(*seconds))
    limit = min(max(limit, 1), 200)
    first = events.orderBy("run_id", "frame", "type", "player_id").limit(limit + 1)
    place = F.row_number().over(Window.orderBy("run_id", "frame", "type", "player_id"))  # of 201 rows at most
    rows = first.select("*", place.alias("place"), (F.count("*").over(Window.partitionBy()) > limit).alias("truncated")).where(F.col("place") <= limit)
    return rows.select("run_id", "type", "frame", time.alias("time"), "player_id", "team", "outcome", "truncated")
