"""Lists and votes of players, teams and tracks, and views of events for a match page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.presets import TEMPLATE, Preset


def list_players(players: DataFrame, teams: DataFrame) -> DataFrame:
    """run_id, rank, player_id, team, frames: players by frames seen, of equal ones the first seen."""
    seen = players.groupBy("run_id", "player_id").agg(F.count("*").alias("frames"), F.min(F.struct("frame", "ord")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("frames"), "first")).cast("long")
    return seen.withColumn("rank", rank).join(teams, "player_id", "left").select("run_id", "rank", "player_id", F.coalesce("team", F.lit("unknown")).alias("team"), "frames")


def list_teams(teams: DataFrame, events: DataFrame) -> DataFrame:
    """team: the different teams that players are assigned to or events name."""
    return teams.select("team").union(events.select("team")).where("team <> ''").distinct()


def cluster_numbers(candidates: DataFrame, min_confidence: float = 0.25) -> DataFrame:
    """run_id, cluster, number, confidence: the number of most summed score over a cluster's tracks; its confidence is the greatest single score.

    candidates(run_id, cluster, track_id, ord, number, score, track_confidence); tracks under the
    confidence don't vote. Of equal sums the number first met, by ord, wins.
    """
    votes = candidates.where((F.col("track_confidence") >= min_confidence) & F.col("number").isNotNull())
    sums = votes.groupBy("run_id", "cluster", "number").agg(F.sum(F.col("score").cast("decimal(18,6)")).alias("sum"), F.max("score").alias("confidence"), F.min("ord").alias("first"))
    best = sums.groupBy("run_id", "cluster").agg(F.max_by(F.struct("number", "confidence"), F.struct("sum", -F.col("first"))).alias("b"))
    return best.select("run_id", "cluster", "b.number", "b.confidence")


def cluster_teams(tracks: DataFrame) -> DataFrame:
    """run_id, cluster, team, role: the team of most frames, unknown only where no track has one; goalkeeper if any track is one, else the role of most frames. tracks(run_id, cluster, ord, team, role, frames)."""
    frames = F.greatest(F.lit(1), F.col("frames"))
    known = ~F.coalesce("team", F.lit("")).isin("unknown", "")

    def winner(c, rows):
        sums = rows.groupBy("run_id", "cluster", c).agg(F.sum(frames).alias("n"), F.min("ord").alias("first"))
        return sums.groupBy("run_id", "cluster").agg(F.max_by(c, F.struct("n", -F.col("first"))).alias(c), F.max((F.col(c) == "goalkeeper").cast("int")).alias("keeper"))

    team, role = winner("team", tracks.where(known)).drop("keeper"), winner("role", tracks)
    both = role.join(team, ["run_id", "cluster"], "left")
    return both.select("run_id", "cluster", F.coalesce("team", F.lit("unknown")).alias("team"), F.when(F.col("keeper") == 1, "goalkeeper").otherwise(F.col("role")).alias("role"))


def majority(rows: DataFrame, keys: list, value: str, order: str, last: int | None = None) -> DataFrame:
    """keys, value, share, n: the most frequent value that is not null, of equal ones the first seen, over all rows or the last few by order."""
    if last is not None:
        rows = rows.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_back") <= last)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    best = counts.groupBy(*keys).agg(F.max_by(F.struct(value, "c"), F.struct("c", -F.col("first"))).alias("b"), F.sum("c").alias("n"))
    return best.select(*keys, F.col("b")[value].alias(value), (F.col("b.c") / F.col("n")).alias("share"), "n")


def calibration_stats(frames: DataFrame, without_interpolated: bool = False) -> DataFrame:
    """run_id, processed, calibrated, rate, mean_error, median_error of frames(run_id, frame, calibrated, interpolated, error)."""
    good = F.col("calibrated") & (~F.col("interpolated") if without_interpolated else F.lit(True))
    error = F.when(good, F.col("error"))
    return frames.groupBy("run_id").agg(F.count("*").alias("processed"), F.count_if(F.col("calibrated")).alias("calibrated"), F.avg(F.col("calibrated").cast("double")).alias("rate"), F.round(F.avg(error), 6).alias("mean_error"), F.median(error).alias("median_error"))


def error_buckets(frames: DataFrame, edges: tuple = (5.0, 15.0, 30.0)) -> DataFrame:
    """run_id, bucket, n: frames by size of error; 'none' where a frame has no calibration."""
    bucket = F.lit(f">={edges[-1]:g}")
    for edge in reversed(edges):
        bucket = F.when(F.col("error") < edge, f"<{edge:g}").otherwise(bucket)
    bucket = F.when(~F.col("calibrated") | F.col("error").isNull(), "none").otherwise(bucket)
    return frames.groupBy("run_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def widest_frame(players: DataFrame) -> DataFrame:
    """run_id, frame, n: the frame with most tracks, the first of equal ones."""
    counts = players.groupBy("run_id", "frame").agg(F.count("*").alias("n"))
    best = counts.groupBy("run_id").agg(F.max_by(F.struct("frame", "n"), F.struct("n", -F.col("frame"))).alias("b"))
    return best.select("run_id", "b.frame", "b.n")


def lifetimes(players: DataFrame) -> DataFrame:
    """run_id, player_id, first_frame, last_frame, n, frames (a player's frames in order; one track's, so bounded by the run); 'unmapped-' ids are left out."""
    own = players.where(~F.col("player_id").startswith("unmapped-"))
    return own.groupBy("run_id", "player_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n"), F.sort_array(F.collect_list("frame")).alias("frames"))


def first_rows(players: DataFrame, start: int, end: int) -> DataFrame:
    """run_id, player_id, frame, x, y: players' places in a range of frames, the first row of a frame by ord."""
    rows = players.where(F.col("frame").between(start, end)).groupBy("run_id", "player_id", "frame").agg(F.min_by(F.struct("x", "y"), "ord").alias("p"))
    return rows.select("run_id", "player_id", "frame", "p.x", "p.y")


def active_frames(events: DataFrame, total: int, banner: int = 50) -> DataFrame:
    """run_id, frame, n: events shown at each frame. Possessions and carries with a start and an end that are not 0 show from start to end and a banner's length on, others for a banner's length."""
    span = F.col("type").isin("possession", "carry") & (F.coalesce("start_frame", F.lit(0)) != 0) & (F.coalesce("end_frame", F.lit(0)) != 0)
    begin = F.when(span, F.col("start_frame")).otherwise(F.col("frame"))
    stop = F.least(F.when(span, F.col("end_frame")).otherwise(F.col("frame")) + banner, F.lit(total))
    shown = events.select("run_id", begin.alias("a"), stop.alias("b")).where("a < b").select("run_id", F.explode(F.sequence("a", F.col("b") - 1)).alias("frame"))
    return shown.groupBy("run_id", "frame").agg(F.count("*").alias("n"))


def timeline(windows: DataFrame, limit: int = 200) -> DataFrame:
    """run_id, place, type, frame, window_start, window_end: the first events of each run but possessions, in order."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("frame", "type", "player_id")).cast("long")
    return windows.where("type <> 'possession'").withColumn("place", place).where(F.col("place") <= limit).select("run_id", "place", "type", "frame", "window_start", "window_end")


def celebrations(events: DataFrame, total: int, seconds: float = 10.0, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame, match_time, celebration_end of goals."""
    return events.where("type = 'goal'").select("run_id", "frame", F.coalesce("match_time", F.col("frame") / p.fps).alias("match_time"), F.least(F.col("frame") + int(seconds * p.fps), F.lit(total - 1)).cast("long").alias("celebration_end"))


def ball_boxes_at(ball: DataFrame, size: float = 80.0) -> DataFrame:
    """run_id, frame, x1, y1, x2, y2: boxes of a fixed size about the ball, for a camera to follow."""
    edge = lambda c, s: (F.col(c) + s * size / 2).alias(f"{c}{1 if s < 0 else 2}")
    return ball.select("run_id", "frame", edge("x", -1), edge("y", -1), edge("x", 1), edge("y", 1))


def without_tracks(players: DataFrame, dropped: DataFrame, teams: DataFrame) -> DataFrame:
    """run_id, team, players, rows of what is left when tracks(run_id, player_id) are dropped."""
    left = players.join(dropped, ["run_id", "player_id"], "left_anti").join(teams, "player_id", "left")
    return left.groupBy("run_id", F.coalesce("team", F.lit("unknown")).alias("team")).agg(F.count_distinct("player_id").alias("players"), F.count("*").alias("rows"))


def nearest_centre(rows: DataFrame, centres: dict, far: float = 1.0) -> DataFrame:
    """run_id, track_id, label, distance: the nearest of a few centres {label: values}, or referee where none is within `far`. rows(run_id, track_id, v array)."""
    options = [F.struct(F.sqrt(F.aggregate(F.zip_with("v", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)).alias("d"), F.lit(n).alias("label")) for n, c in sorted(centres.items())]
    best = rows.select("run_id", "track_id", F.array_min(F.array(*options)).alias("b"))
    return best.select("run_id", "track_id", F.when(F.col("b.d") > far, "referee").otherwise(F.col("b.label")).alias("label"), F.col("b.d").alias("distance"))


def zone_roles(middles: DataFrame, depth: float = 16.5, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, player_id, role by mean place(x, y): goalkeeper in front of a goal, linesman by a side line, else player."""
    keeper = (F.abs("x") > p.half_length - depth) & (F.abs("y") < 0.6 * p.half_width)
    return middles.select("run_id", "player_id", F.when(F.abs("y") > p.half_width - 2.0, "linesman").when(keeper, "goalkeeper").otherwise("player").alias("role"))


def balances(rows: DataFrame, column: str, values: tuple) -> DataFrame:
    """run_id, column, n: rows by value, with 0 for those of the given values that a run lacks."""
    runs = rows.select("run_id").distinct().select("run_id", F.explode(F.array(*map(F.lit, values))).alias(column))
    counts = rows.groupBy("run_id", column).agg(F.count("*").alias("n"))
    return runs.join(counts, ["run_id", column], "left").select("run_id", column, F.coalesce("n", F.lit(0)).alias("n"))


def gallery_means(features: DataFrame) -> DataFrame:
    """run_id, track_id, mean: the plain mean of a track's embeddings."""
    cells = features.select("run_id", "track_id", F.posexplode("embedding").alias("pos", "v")).groupBy("run_id", "track_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return cells.groupBy("run_id", "track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def cosine(a, b):
    """Cosine of two arrays of doubles; 0 where one is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    la, lb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((la >= 1e-6) & (lb >= 1e-6), dot(a, b) / (la * lb)).otherwise(F.lit(0.0))


def gallery_matches(queries: DataFrame, gallery: DataFrame, least: float) -> DataFrame:
    """run_id, query, track_id, similarity: of the gallery's other tracks of the run the most alike, if alike enough. queries(run_id, query, v), gallery(run_id, track_id, mean)."""
    pairs = queries.join(gallery, "run_id").where(F.col("query") != F.col("track_id")).withColumn("similarity", cosine(F.col("v"), F.col("mean")))
    best = pairs.groupBy("run_id", "query").agg(F.max_by(F.struct("track_id", "similarity"), F.struct("similarity", -F.col("track_id"))).alias("b"))
    return best.select("run_id", "query", "b.track_id", F.round("b.similarity", 6).alias("similarity")).where(F.col("similarity") >= least)


def top_frames(boxes: DataFrame, k: int) -> DataFrame:
    """run_id, player_id, frame: of a track's 3k largest boxes k spread over time; all of those where there are fewer."""
    keys = ["run_id", "player_id"]
    large = Window.partitionBy(*keys).orderBy(F.desc("area"), "frame")
    pool = boxes.withColumn("r", F.row_number().over(large)).where(F.col("r") <= 3 * k)
    w = Window.partitionBy(*keys)
    rows = pool.select(*keys, "frame", (F.row_number().over(w.orderBy("frame")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    # Is i one of floor(j n / k)? The least j that reaches i tells.
    j = F.ceil(F.col("i") * k / F.col("n"))
    return rows.where((F.col("n") <= k) | ((j < k) & (F.floor(j * F.col("n") / k) == F.col("i")))).select(*keys, "frame")
