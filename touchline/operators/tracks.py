"""Track quality, identity votes, embeddings and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import apply_homography, box_overlap, hypot, invert_homography
from ..plans.presets import TEMPLATE, Preset

GOAL_AREA = 16.5


def zone_label(x: Column, y: Column, p: Preset = TEMPLATE, scene: bool = False) -> Column:
    """Coarse place on the field; with scene, the middle is split into three bands by x and two by y."""
    if scene:
        band = F.when(x < -p.half_length / 3, "left").when(x > p.half_length / 3, "right").otherwise("mid")
        rest = F.concat(band, F.lit("_"), F.when(y > 0, "top").otherwise("bot"))
    else:
        rest = F.when(F.abs(y) > 0.7 * p.half_width, "sideline").otherwise("midfield")
    out = (F.abs(x) > p.half_length + 0.5) | (F.abs(y) > p.half_width + 0.5)
    return F.when(out, "outside").when(x < GOAL_AREA - p.half_length, "near_left_goal").when(x > p.half_length - GOAL_AREA, "near_right_goal").otherwise(rest)


def position_zones(players: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, player_id, label, scene: the zones of each player's median position."""
    middle = players.groupBy("run_id", "player_id").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    return middle.select("run_id", "player_id", zone_label(F.col("mx"), F.col("my"), p).alias("label"), zone_label(F.col("mx"), F.col("my"), p, True).alias("scene"))


def referee_check(players: DataFrame, min_obs: int = 30, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, player_id, moves_like_one: false for short tracks and for those that stand still beside a side line."""
    span = lambda c: F.percentile(c, F.lit(0.95)) - F.percentile(c, F.lit(0.05))
    stats = players.groupBy("run_id", "player_id").agg(F.count("*").alias("n"), span("x").alias("rx"), span("y").alias("ry"), F.median("y").alias("my"))
    still = (F.col("rx") < 3.0) & (F.col("ry") < 3.0) & (F.abs("my") > 0.7 * p.half_width)
    return stats.select("run_id", "player_id", ((F.col("n") >= min_obs) & ~still).alias("moves_like_one"))


def cooccurring_pairs(players: DataFrame) -> DataFrame:
    """run_id, a, b, frames: pairs seen in one frame, who can't be one person. A frame holds a few dozen players at most."""
    rows = players.select("run_id", "frame", "player_id").distinct()
    pairs = rows.withColumnRenamed("player_id", "a").join(rows.withColumnRenamed("player_id", "b"), ["run_id", "frame"]).where("a < b")
    return pairs.groupBy("run_id", "a", "b").agg(F.count("*").alias("frames"))


def ball_outliers(ball: DataFrame, max_deviation: float = 5.0, max_speed: float = 30.0, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame, deviation of positions far from the line between neighbours that agree with one another."""
    w = Window.partitionBy("run_id").orderBy("frame")
    around = ball.select("run_id", "frame", "x", "y", *(f(c).over(w).alias(f"{n}_{c}") for n, f in (("p", F.lag), ("n", F.lead)) for c in ("frame", "x", "y")))
    c = F.col
    dt = (c("n_frame") - c("p_frame")) / p.fps
    calm = hypot(c("n_x") - c("p_x"), c("n_y") - c("p_y")) / dt <= max_speed
    part = (c("frame") - c("p_frame")) / (c("n_frame") - c("p_frame"))
    far = hypot(c("x") - (c("p_x") + part * (c("n_x") - c("p_x"))), c("y") - (c("p_y") + part * (c("n_y") - c("p_y"))))
    return around.where(calm & (far > max_deviation)).select("run_id", "frame", F.round(far, 6).alias("deviation"))


def without_outliers(ball: DataFrame, max_deviation: float = 5.0, max_speed: float = 30.0, p: Preset = TEMPLATE) -> DataFrame:
    """ball without its outliers."""
    return ball.join(ball_outliers(ball, max_deviation, max_speed, p).select("run_id", "frame"), ["run_id", "frame"], "left_anti")


def kicks(ball: DataFrame, threshold: float = 50.0) -> DataFrame:
    """run_id, frame, jerk: where the second difference of the position is over a threshold."""
    w = Window.partitionBy("run_id").orderBy("frame")
    second = lambda c: F.col(c) - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)
    rows = ball.select("run_id", "frame", second("x").alias("dx"), second("y").alias("dy"))
    return rows.select("run_id", "frame", F.round(hypot(F.col("dx"), F.col("dy")), 6).alias("jerk")).where(F.col("jerk") > threshold)


def observation_gaps(ball: DataFrame) -> DataFrame:
    """run_id, gap_start, gap_end, left_anchor, right_anchor of frames without an observation between two with one."""
    nxt = F.lead("frame").over(Window.partitionBy("run_id").orderBy("frame"))
    rows = ball.select("run_id", F.col("frame").alias("left_anchor"), nxt.alias("right_anchor")).where("right_anchor - left_anchor > 1")
    return rows.select("run_id", (F.col("left_anchor") + 1).alias("gap_start"), (F.col("right_anchor") - 1).alias("gap_end"), "left_anchor", "right_anchor")


def moving_mean(ball: DataFrame, reach: int = 2) -> DataFrame:
    """run_id, frame, x, y weighted by confidence over the observations before and after; decimal sums don't hang on their order."""
    w = Window.partitionBy("run_id").orderBy("frame").rowsBetween(-reach, reach)
    total = lambda c: F.sum(c.cast("decimal(18,8)")).over(w).cast("double")
    mean = lambda c: (total(F.col(c) * F.col("confidence")) / total(F.col("confidence"))).alias(c)
    return ball.select("run_id", "frame", mean("x"), mean("y"))


def spread_sample(players: DataFrame, n: int = 10) -> DataFrame:
    """run_id, player_id, frame: n observations per track, evenly spaced from the first to the last; all of a shorter track."""
    w = Window.partitionBy("run_id", "player_id")
    rows = players.select("run_id", "player_id", "frame", (F.row_number().over(w.orderBy("frame", "ord")) - 1).alias("i"), F.count("*").over(w).alias("all"))
    # Is i one of floor(k (all - 1) / (n - 1))? The least k that reaches i tells.
    last = F.col("all") - 1
    k = F.ceil(F.col("i") * (n - 1) / F.greatest(last, F.lit(1)))
    return rows.where((F.col("all") <= n) | (F.floor(k * last / (n - 1)) == F.col("i"))).select("run_id", "player_id", "frame")


def number_votes(readings: DataFrame) -> DataFrame:
    """track_id, number, confidence, readings: the number of most summed confidence, of equal ones the first read.

    readings(track_id, ord, reading, confidence); blank readings and those outside 1 to 99 only count as
    turnout. The confidence is the root of turnout times consensus.
    """
    weight = F.greatest(F.lit(0), F.least(F.lit(1), F.coalesce("confidence", F.lit(0.0)))).cast("decimal(18,12)")
    valid = F.col("reading").between(1, 99) & (weight > 0)
    votes = readings.select("track_id", "ord", F.when(valid, F.col("reading")).alias("number"), F.when(valid, weight).otherwise(F.lit(0)).cast("decimal(18,12)").alias("w"))
    score = votes.groupBy("track_id", "number").agg(F.sum("w").alias("score"), F.count("*").alias("n"), F.min("ord").alias("first"))
    best = F.max_by("number", F.when(F.col("number").isNotNull(), F.struct("score", -F.col("first"))))
    sums = score.groupBy("track_id").agg(best.alias("number"), F.max("score").cast("double").alias("top"), F.sum("score").cast("double").alias("total"), F.sum("n").alias("readings"))
    share = F.when(F.col("total") > 0, F.sqrt(F.col("top") / F.col("readings") * F.col("top") / F.col("total"))).otherwise(F.lit(0.0))
    return sums.select("track_id", "number", F.round(share, 6).alias("confidence"), "readings")


def centroids(features: DataFrame) -> DataFrame:
    """run_id, track_id, n, centroid: the normalised mean of a track's embeddings; null where the mean has no length."""
    cells = features.select("run_id", "track_id", F.posexplode("embedding").alias("pos", "v")).groupBy("run_id", "track_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    mean = cells.groupBy("run_id", "track_id").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda acc, v: acc + v * v))
    return mean.select("run_id", "track_id", "n", F.when(length >= 1e-6, F.transform("mean", lambda v: v / length)).alias("centroid"))


def similar_tracks(features: DataFrame, threshold: float) -> DataFrame:
    """run_id, a, b, cosine: tracks of one run whose centroids are alike; a run holds thousands of tracks at most."""
    mids = centroids(features).where("centroid IS NOT NULL").select("run_id", "track_id", "centroid")
    pairs = mids.select("run_id", F.col("track_id").alias("a"), F.col("centroid").alias("ca")).join(mids.select("run_id", F.col("track_id").alias("b"), F.col("centroid").alias("cb")), "run_id").where("a < b")
    cosine = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    return pairs.select("run_id", "a", "b", F.round(cosine, 6).alias("cosine")).where(F.col("cosine") >= threshold)


def projected(points: DataFrame, h: list) -> DataFrame:
    """run_id, frame, px, py, x, y: points of the field in the image of homography h, and back by its inverse."""
    px, py = apply_homography(h, F.col("x"), F.col("y"))
    image = points.select("run_id", "frame", px.alias("px"), py.alias("py"))
    x, y = apply_homography(invert_homography(h), F.col("px"), F.col("py"))
    return image.select("run_id", "frame", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def box_steps(boxes: DataFrame) -> DataFrame:
    """run_id, player_id, frame, w, h, foot_x, overlap: width and height of each box, its foot, and its overlap with the track's box before."""
    w = Window.partitionBy("run_id", "player_id").orderBy("frame")
    sides = ("x1", "y1", "x2", "y2")
    rows = boxes.select("run_id", "player_id", "frame", *sides, *(F.lag(c).over(w).alias(f"p_{c}") for c in sides))
    overlap = F.when(F.col("p_x1").isNotNull(), box_overlap([F.col(c) for c in sides], [F.col(f"p_{c}") for c in sides]))
    return rows.select("run_id", "player_id", "frame", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), ((F.col("x1") + F.col("x2")) / 2).alias("foot_x"), F.round(overlap, 6).alias("overlap"))


def speed_percentiles(states: DataFrame) -> DataFrame:
    """run_id, n and percentiles 5 to 95 of the ball's speed."""
    cut = lambda q: F.round(F.percentile("speed", F.lit(q / 100)), 6).alias(f"p{q}")
    return states.groupBy("run_id").agg(F.count("*").alias("n"), *map(cut, (5, 25, 50, 75, 95)))


def roster(players: DataFrame, teams: DataFrame) -> DataFrame:
    """run_id, player_id, team, jersey_number, role, frames; ids that start with 'unmapped-' are left out.

    Team is the assigned one, else the first that the rows name, else unknown; number and role are the
    first that are not null, in order of frame and ord. Tables without those columns give null.
    """
    own = players.where(~F.col("player_id").startswith("unmapped-"))
    kinds = {"team": "string", "jersey_number": "int", "role": "string"}
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("frame", "ord"))) if c in players.columns else F.lit(None).cast(kinds[c])
    rows = own.groupBy("run_id", "player_id").agg(F.count("*").alias("frames"), first("team").alias("_team"), first("jersey_number").alias("jersey_number"), first("role").alias("role"))
    return rows.join(teams, "player_id", "left").select("run_id", "player_id", F.coalesce("team", "_team", F.lit("unknown")).alias("team"), "jersey_number", "role", "frames")


def side_of_teams(players: DataFrame, teams: DataFrame) -> DataFrame:
    """run_id, team, side: left or right by the mean x of the two teams."""
    mean = players.join(teams, "player_id").where("team IN ('team_A', 'team_B')").groupBy("run_id", "team").agg(F.avg("x").alias("mx"))
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("mx", "team")) == 1
    return mean.select("run_id", "team", F.when(first, "left").otherwise("right").alias("side"))
