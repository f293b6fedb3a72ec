"""Filters, scores and matches of detection boxes; every operator works within a run and a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import apply_homography, box_overlap, hypot
from ..plans.presets import TEMPLATE, Preset

#: Class numbers of people and balls.
PERSON, BALL = 0, 32
SIDES = ("x1", "y1", "x2", "y2")


def _size() -> tuple[Column, Column]:
    return F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")


def player_boxes(detections: DataFrame, heights: tuple = (50.0, 500.0), aspects: tuple = (0.2, 1.5)) -> DataFrame:
    """Boxes of a player's height and width to height, both bounds included."""
    w, h = _size()
    return detections.where(h.between(*heights) & (w / h).between(*aspects))


def ball_boxes(detections: DataFrame, sizes: tuple = (4.0, 120.0), aspects: tuple = (0.5, 2.0), sure: float = 0.6) -> DataFrame:
    """Boxes of a ball's size; a blurred ball may be of any shape if its confidence is at least `sure`."""
    w, h = _size()
    shape = F.when(h > 0, w / h).otherwise(F.lit(0.0))
    return detections.where(w.between(*sizes) & h.between(*sizes) & (shape.between(*aspects) | (F.coalesce("confidence", F.lit(0.0)) >= sure)))


def in_image_band(detections: DataFrame, image_height: float, band: tuple = (0.15, 0.85)) -> DataFrame:
    """Boxes whose centre lies in the middle of the image's height."""
    return detections.where(((F.col("y1") + F.col("y2")) / 2).between(band[0] * image_height, band[1] * image_height))


def by_class(detections: DataFrame, person: float = 0.3, ball: float = 0.1) -> DataFrame:
    """detections with kind, player or ball, of at least the kind's confidence; other classes are dropped."""
    kind = F.when((F.col("class") == PERSON) & (F.col("confidence") >= person), "player").when((F.col("class") == BALL) & (F.col("confidence") >= ball), "ball")
    return detections.withColumn("kind", kind).where("kind IS NOT NULL")


def on_field(detections: DataFrame, h: list, margin: float = 2.0, p: Preset = TEMPLATE) -> DataFrame:
    """detections whose place on the field, of a person's feet or a ball's centre by homography h, is within the lines and a margin: x and y are added."""
    foot = F.when(F.col("class") == PERSON, F.col("y2")).otherwise((F.col("y1") + F.col("y2")) / 2)
    x, y = apply_homography(h, (F.col("x1") + F.col("x2")) / 2, foot)
    return detections.withColumns({"x": x, "y": y}).where((F.abs("x") <= p.half_length + margin) & (F.abs("y") <= p.half_width + margin))


def box_geometry(detections: DataFrame) -> DataFrame:
    """run_id, frame, ord, and of each box its foot, centre and area."""
    w, h = _size()
    middle = (F.col("x1") + F.col("x2")) / 2
    return detections.select("run_id", "frame", "ord", middle.alias("foot_x"), F.col("y2").alias("foot_y"), middle.alias("center_x"), ((F.col("y1") + F.col("y2")) / 2).alias("center_y"), (w * h).alias("area"))


def best_balls(detections: DataFrame) -> DataFrame:
    """run_id, frame, ord, score: the ball of each frame, by confidence and roundness; of equal ones the first."""
    w, h = _size()
    score = 0.7 * F.col("confidence") + 0.3 * (1.0 - F.abs(1.0 - F.when(h > 0, w / h).otherwise(F.lit(0.0))))
    rows = detections.where(F.col("class") == BALL).withColumn("score", score)
    best = rows.groupBy("run_id", "frame").agg(F.max_by(F.struct("ord", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("run_id", "frame", "b.ord", "b.score")


def stage_totals(detections: DataFrame, h: list, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, n_frames, raw_players, raw_balls, post_conf_players, post_size_players, post_pitch_players: what each filter leaves, one after the other."""
    sure = by_class(detections).where("kind = 'player'")
    sized = player_boxes(sure)
    left = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    raw = detections.groupBy("run_id").agg(F.count_distinct("frame").alias("n_frames"), F.count_if(F.col("class") == PERSON).alias("raw_players"), F.count_if(F.col("class") == BALL).alias("raw_balls"))
    for df, name in ((sure, "post_conf_players"), (sized, "post_size_players"), (on_field(sized, h, p=p), "post_pitch_players")):
        raw = raw.join(left(df, name), "run_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return raw


def long_tracks(players: DataFrame, min_seconds: float = 3.0, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, player_id, n of tracks with enough frames."""
    return players.groupBy("run_id", "player_id").agg(F.count("*").alias("n")).where(F.col("n") >= int(min_seconds * p.fps))


def ever_confirmed(rows: DataFrame) -> DataFrame:
    """Rows of tracks that are confirmed at some time, those from before included: rows(run_id, track_id, frame, confirmed)."""
    return rows.withColumn("_ever", F.max(F.col("confirmed").cast("int")).over(Window.partitionBy("run_id", "track_id"))).where("_ever = 1").drop("_ever")


def pair_costs(tracks: DataFrame, detections: DataFrame, gate: float = 4.0, absolute_max: float = 8.0, barred: float = 1e5) -> DataFrame:
    """run_id, frame, track_id, ord, iou_cost, pitch_cost, allowed: costs of giving a detection to a track of the same frame.

    iou_cost is one less the overlap of the boxes, pitch_cost the distance on the field, `barred` where a
    place is missing. The gate widens with the frames since the track's last update and never bars a pair
    without a place.
    """
    own = tracks.select("run_id", "frame", "track_id", "time_since_update", F.col("x").alias("tx"), F.col("y").alias("ty"), *(F.col(c).alias(f"t_{c}") for c in SIDES))
    pairs = own.join(detections, ["run_id", "frame"])
    d = hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    reach = F.least(gate * (F.col("time_since_update") + 1), F.lit(absolute_max))
    overlap = box_overlap([F.col(f"t_{c}") for c in SIDES], [F.col(c) for c in SIDES])
    return pairs.select("run_id", "frame", "track_id", "ord", (1.0 - overlap).alias("iou_cost"), F.coalesce(d, F.lit(barred)).alias("pitch_cost"), F.coalesce(d <= reach, F.lit(True)).alias("allowed"))


def best_overlaps(tracks: DataFrame, detections: DataFrame, least: float = 0.3) -> DataFrame:
    """run_id, frame, track_id, ord, overlap: the detection that a track's box overlaps most, over a least share; of equal ones the first."""
    pairs = pair_costs(tracks, detections).withColumn("overlap", 1.0 - F.col("iou_cost")).where(F.col("overlap") > least)
    best = pairs.groupBy("run_id", "frame", "track_id").agg(F.max_by(F.struct("ord", "overlap"), F.struct("overlap", -F.col("ord"))).alias("b"))
    return best.select("run_id", "frame", "track_id", "b.ord", "b.overlap")


def image_holders(balls: DataFrame, detections: DataFrame, reach: float = 250.0) -> DataFrame:
    """run_id, frame, ord, distance, kind, x1, y1, x2, y2: the person whose feet are nearest to the ball's centre in the image, nearer than reach.

    kind is player and the box that person's; where there is none, ord and distance are null, kind is ball and the box the ball's.
    """
    bx, by = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    at = balls.select("run_id", "frame", bx.alias("bx"), by.alias("by"), F.struct(*SIDES).alias("ball"))
    feet = detections.where(F.col("class") == PERSON).select("run_id", "frame", "ord", bx.alias("fx"), F.col("y2").alias("fy"), F.struct(*SIDES).alias("body"))
    d = hypot(F.col("fx") - F.col("bx"), F.col("fy") - F.col("by"))
    near = at.join(feet, ["run_id", "frame"], "left").withColumn("d", F.when(d < reach, d))
    best = near.groupBy("run_id", "frame").agg(F.min_by(F.struct("ord", "d", "body"), F.when(F.col("d").isNotNull(), F.struct("d", "ord"))).alias("b"), F.first("ball").alias("ball"))
    box = F.coalesce("b.body", "ball")
    return best.select("run_id", "frame", "b.ord", F.col("b.d").alias("distance"), F.when(F.col("b").isNull(), "ball").otherwise("player").alias("kind"), *(box[c].alias(c) for c in SIDES))
