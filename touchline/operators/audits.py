"""What tracking and calibration missed, and which frames, crops and tracks to look at again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timelines import bracketed


def camera_checks(cameras: DataFrame) -> DataFrame:
    """run_id, frame, good, reason of cameras(run_id, frame, focal, cx, cy, cz): bounds on the focal length and the position, the first that fails."""
    there = F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("cz").isNotNull()
    reason = (
        F.when(F.col("focal").isNull(), "fx-recovery-failed")
        .when(~F.col("focal").between(10, 20_000), F.format_string("fx-out-of-range(%d)", F.rint("focal").cast("long")))
        .when(~there, "pos-recovery-failed")
        .when((F.abs("cx") >= 250) | (F.abs("cy") >= 250), "pos-xy-out-of-range")
        .when((F.col("cz") == 0) | (F.abs("cz") >= 100), "pos-z-out-of-range")
        .otherwise("ok")
    )
    return cameras.select("run_id", "frame", (reason == "ok").alias("good"), reason.alias("reason"))


def nearest_detections(asked: DataFrame, detections: DataFrame, max_gap: int = 30) -> DataFrame:
    """run_id, frame, x, y: centre of the surest detection(run_id, frame, ord, x, y, confidence) of the nearest frame that has any.

    Of two frames as near the earlier one counts, of detections as sure the first. Null beyond max_gap frames.
    """
    best = detections.groupBy("run_id", "frame").agg(F.max_by(F.struct("x", "y"), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("ord"))).alias("c"))
    both = bracketed(asked, best.select("run_id", "frame", "c.x", "c.y"))
    back, ahead = F.col("frame") - F.col("a_frame"), F.col("b_frame") - F.col("frame")
    later = F.col("a_frame").isNull() | (ahead < back)
    near = F.when(F.when(later, ahead).otherwise(back) <= max_gap, F.when(later, F.col("b")).otherwise(F.col("a")))
    return both.select("run_id", "frame", near["x"].alias("x"), near["y"].alias("y"))


def dropouts(tracks: DataFrame, detections: DataFrame, stride: int = 1, gap_max: int = 30, gate: float = 4.0) -> DataFrame:
    """run_id, track_id, frame_before, frame_gap, frame_after, gap_samples, x, y, ord, distance: gaps of a track in which a detection lies where it should be.

    In each sampled frame of a gap of at most gap_max frames the track's position is interpolated;
    the nearest detection(run_id, frame, ord, x, y) less than gate metres away is listed.
    """
    w = Window.partitionBy("run_id", "track_id").orderBy("frame")
    rows = tracks.select("run_id", "track_id", F.col("frame").alias("frame_after"), "x", "y", *(F.lag(c).over(w).alias(n) for c, n in (("frame", "frame_before"), ("x", "ax"), ("y", "ay"))))
    gap = F.col("frame_after") - F.col("frame_before")
    rows = rows.where((gap > stride) & (gap <= gap_max) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("ax").isNotNull() & F.col("ay").isNotNull())
    gaps = rows.withColumn("frame", F.explode(F.sequence(F.col("frame_before") + stride, F.col("frame_after") - 1, F.lit(stride).cast("long"))))
    t = (F.col("frame") - F.col("frame_before")) / gap
    spots = gaps.select("run_id", "track_id", "frame", "frame_before", "frame_after", (gap / stride).cast("long").alias("gap_samples"), (F.col("ax") + t * (F.col("x") - F.col("ax"))).alias("gx"), (F.col("ay") + t * (F.col("y") - F.col("ay"))).alias("gy"))
    dx, dy = F.col("x") - F.col("gx"), F.col("y") - F.col("gy")
    seen = spots.join(detections.select("run_id", "frame", "ord", "x", "y"), ["run_id", "frame"]).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") < gate)
    own = ["run_id", "track_id", "frame_before", "frame", "frame_after", "gap_samples", "gx", "gy"]
    best = seen.groupBy(*own).agg(F.min(F.struct("distance", "ord")).alias("m"))
    return best.select("run_id", "track_id", "frame_before", F.col("frame").alias("frame_gap"), "frame_after", "gap_samples", F.col("gx").alias("x"), F.col("gy").alias("y"), "m.ord", "m.distance")


def candidate_frames(frames: DataFrame, n: int = 12) -> DataFrame:
    """run_id, frame: at most n frames spread evenly over the middle nine tenths of each run."""
    w = Window.partitionBy("run_id")
    rows = frames.select("run_id", "frame", (F.row_number().over(w.orderBy("frame")) - 1).alias("i"), F.count("*").over(w).alias("all"))
    low, high = F.floor(F.col("all") * 0.05), F.floor(F.col("all") * 0.95)
    rows = rows.withColumns({"low": F.when(high > low, low).otherwise(F.lit(0)), "m": F.when(high > low, high - low).otherwise(F.col("all"))}).withColumn("r", F.col("i") - F.col("low"))
    picked = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("m") / n)) == F.col("r"))
    return rows.where((F.col("r") >= 0) & (F.col("r") < F.col("m")) & ((F.col("m") <= n) | picked)).select("run_id", "frame")


def second_pass_frames(asked: DataFrame, positions: DataFrame, old_gap: int, new_gap: int) -> DataFrame:
    """run_id, frame, x, y of asked frames without a position that lie in a gap wider than old_gap frames and of at most new_gap, interpolated."""
    both = bracketed(asked, positions.select("run_id", "frame", "x", "y")).where("a_frame < frame AND b_frame > frame")
    gap = F.col("b_frame") - F.col("a_frame")
    t = (F.col("frame") - F.col("a_frame")) / gap
    return both.where((gap > old_gap) & (gap <= new_gap)).select("run_id", "frame", *((F.col(f"a.{c}") + t * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c) for c in ("x", "y")))


def without_lonely(clusters: DataFrame) -> DataFrame:
    """clusters(run_id, cluster, team, role, tracks as an array) without unknown ones of at most one track that have no special role."""
    special = F.coalesce(F.col("role").isin("goalkeeper", "referee", "linesman"), F.lit(False))
    lonely = F.coalesce((F.col("team") == "unknown") & ~special & (F.coalesce(F.size("tracks"), F.lit(0)) <= 1), F.lit(False))
    return clusters.where(~lonely)


def final_tracks(observations: DataFrame) -> DataFrame:
    """run_id, track_id, jersey, team, n, first_frame, last_frame of observations(run_id, track_id, frame, jersey, team).

    Jersey and team are the most frequent that aren't null, of equals the one seen first.
    """
    keys = ["run_id", "track_id"]
    out = observations.groupBy(*keys).agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    for c in ("jersey", "team"):
        counts = observations.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("k"), F.min("frame").alias("f"))
        out = out.join(counts.groupBy(*keys).agg(F.max_by(c, F.struct("k", -F.col("f"))).alias(c)), keys, "left")
    return out.select(*keys, "jersey", "team", "n", "first_frame", "last_frame")


def exemplars(references: DataFrame, crops: DataFrame, n: int) -> DataFrame:
    """run_id, team, place, track_id, frame: the best crop(run_id, track_id, frame, score) of each reference(run_id, team, place, track_id), the first n of a team."""
    best = crops.groupBy("run_id", "track_id").agg(F.max_by("frame", F.struct("score", -F.col("frame"))).alias("frame"))
    rows = references.join(best, ["run_id", "track_id"])
    rank = F.row_number().over(Window.partitionBy("run_id", "team").orderBy("place", "track_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("run_id", "team", "place", "track_id", "frame")


def zone_quota(tracks: DataFrame, total: int) -> DataFrame:
    """run_id, track_id, zone, place: at most `total` tracks(run_id, track_id, ord, zone, score) of a run, spread over its zones.

    Each zone gives an equal share of its best first, the zone seen first before the others; what is
    left is filled in the same order.
    """
    run, zone = Window.partitionBy("run_id"), Window.partitionBy("run_id", "zone")
    zones = F.size(F.collect_set("zone").over(run))
    rows = tracks.select("run_id", "track_id", "zone", F.row_number().over(zone.orderBy(F.desc("score"), "ord")).alias("rank"), F.min("ord").over(zone).alias("seen"), zones.alias("zones"))
    late = F.col("rank") > F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("zones")))
    place = F.row_number().over(run.orderBy(late, "seen", "rank"))
    return rows.select("run_id", "track_id", "zone", place.alias("place")).where(F.col("place") <= total)


def keypoint_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """run_id, frame, expected, found, phantoms, mean_error: of keypoints(run_id, frame, id, x, y) how many were found, how far off, and how many predicted ids don't belong there."""
    a = truth.select("run_id", "frame", "id", F.struct("x", "y").alias("a"))
    both = a.join(predicted.select("run_id", "frame", "id", F.struct("x", "y").alias("b")), ["run_id", "frame", "id"], "full")
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    return both.groupBy("run_id", "frame").agg(F.count("a").alias("expected"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("found"), F.count_if(F.col("a").isNull()).alias("phantoms"), F.avg(F.sqrt(dx * dx + dy * dy)).alias("mean_error"))


def both_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Detections of two passes over a run, with the pass each came from as `source`."""
    return first.withColumn("source", F.lit("pass1")).unionByName(second.withColumn("source", F.lit("pass2")))


#: Keys of an event's metadata that its summary shows.
SUMMARY_KEYS = ("outcome", "receiver_id", "receiver_team", "pass_length", "duration_sec", "shooter_frame", "is_successful")


def event_summaries(events: DataFrame, fps: float = 25.0) -> DataFrame:
    """event_id, type, time_s, frame, player_id, team_id, shown of events with a metadata map: shown has the keys worth showing that are there."""
    shown = F.map_filter("metadata", lambda k, _: k.isin(*SUMMARY_KEYS))
    return events.select("run_id", "event_id", "type", F.round(F.col("frame") / fps, 2).alias("time_s"), "frame", "player_id", "team_id", F.coalesce(shown, F.create_map().cast("map<string,string>")).alias("shown"))


def movement_patterns(positions: DataFrame, length: float = 105.0, width: float = 68.0, least: int = 40) -> DataFrame:
    """run_id, track_id, pattern, description of positions(run_id, track_id, x, y): how a track moves over the match, null for a short one.

    Ranges are between the 5th and 95th percentile; positions beyond twice the field are left out.
    Numbers in the description round half up.
    """
    keys, half_l, half_w = ["run_id", "track_id"], length / 2, width / 2
    sane = (F.abs("x") <= length) & (F.abs("y") <= width)
    quantiles = lambda c: F.percentile(F.when(sane, F.col(c)), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    rows = positions.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(sane).alias("ok"), quantiles("x").alias("qx"), quantiles("y").alias("qy"))
    at = lambda c, i: F.element_at(c, i)
    rows = rows.select(*keys, "n", "ok", at("qx", 2).alias("mx"), at("qy", 2).alias("my"), (at("qx", 3) - at("qx", 1)).alias("rx"), (at("qy", 3) - at("qy", 1)).alias("ry"))
    mx, my, rx, ry = F.col("mx"), F.col("my"), F.col("rx"), F.col("ry")
    goal, touch = F.least(F.abs(mx + half_l), F.abs(mx - half_l)), F.least(F.abs(my - half_w), F.abs(my + half_w))
    inside = (F.abs(mx) <= half_l + 0.5) & (F.abs(my) <= half_w + 0.5)
    pattern = (
        F.when((F.col("n") < least) | (F.col("ok") < 3), None)
        .when(inside & (goal <= 18.0) & (rx / length <= 0.18) & (F.abs(my) <= 6.0), "tight_near_goal")
        .when(inside & (rx / length >= 0.6) & (ry / width >= 0.55), "covers_whole_pitch")
        .when(inside & (touch <= 5.0) & (ry <= 12.0) & (rx / length >= 0.35), "touchline_runner")
        .when(~inside, "off_pitch_lateral")
        .otherwise("outfield")
    )
    side, line = F.when(mx <= 0, "left").otherwise("right"), F.when(my >= 0, "top").otherwise("bottom")
    # The wording that readers of these lines expect.
    text = {
        "tight_near_goal": F.format_string("stays within ~%.1fm of the %s goal line (%.1fm from goal), y_med=%.1fm. This is the goalkeeper pattern.", rx, side, goal, my),
        "covers_whole_pitch": F.format_string("x-range %.1fm (%.0f%% of pitch length), y-range %.1fm (%.0f%% of pitch width). Only the main referee covers this much area.", rx, rx / length * 100, ry, ry / width * 100),
        "touchline_runner": F.format_string("stays within %.1fm of the %s touchline (median %.1fm from it), runs %.1fm along it. This is the linesman pattern.", ry, line, touch, rx),
        "off_pitch_lateral": F.format_string("median position is off the playing area (x=%.1f, y=%.1f). Coach / substitute / staff.", mx, my),
        "outfield": F.format_string("x-range %.1fm (%.0f%% of length), y-range %.1fm (%.0f%% of width). Normal outfield player movement.", rx, rx / length * 100, ry, ry / width * 100),
    }
    said = F.coalesce(*(F.when(F.col("pattern") == k, F.concat(F.lit(f"pattern={k}. {k}: "), v)) for k, v in text.items()))
    return rows.withColumn("pattern", pattern).select(*keys, "pattern", said.alias("description"))
