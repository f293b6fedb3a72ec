"""Nearest and bracketing rows in time, moving means, and camera chains: windows over a run's frames, never a join of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.presets import TEMPLATE, Preset


def bracketed(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked(run_id, frame) with a_frame, a and b_frame, b: the last row of known up to the frame and the first from it on, as structs of known's other columns."""
    value = F.struct(*(c for c in known.columns if c not in ("run_id", "frame")))
    rows = known.select("run_id", "frame", F.struct(F.col("frame").alias("at"), value.alias("v")).alias("k"))
    both = rows.union(asked.select("run_id", "frame", F.lit(None).cast(rows.schema["k"].dataType)))
    w = Window.partitionBy("run_id").orderBy("frame")
    before = F.last("k", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("k", True).over(w.rangeBetween(0, Window.unboundedFollowing))
    found = both.select("run_id", "frame", "k", before.alias("a"), after.alias("b")).where("k IS NULL")
    return found.select("run_id", "frame", F.col("a.at").alias("a_frame"), F.col("a.v").alias("a"), F.col("b.at").alias("b_frame"), F.col("b.v").alias("b"))


def nearest_frames(asked: DataFrame, known: DataFrame, reach: int | None = None, later_wins: bool = False) -> DataFrame:
    """run_id, frame, found_frame: the nearest frame of known, the earlier of two as near unless later_wins; null beyond reach."""
    both = bracketed(asked, known.select("run_id", "frame", F.lit(1).alias("one")))
    back, ahead = F.col("frame") - F.col("a_frame"), F.col("b_frame") - F.col("frame")
    first = (ahead <= back) if later_wins else (ahead < back)
    near = F.when(F.col("a_frame").isNull() | first, F.col("b_frame")).otherwise(F.col("a_frame"))
    near = near if reach is None else F.when(F.abs(near - F.col("frame")) <= reach, near)
    return both.select("run_id", "frame", near.alias("found_frame"))


EASINGS = {
    "linear": lambda t: t,
    "ease_in": lambda t: t * t,
    "ease_out": lambda t: 1.0 - (1.0 - t) * (1.0 - t),
    "ease_in_out": lambda t: F.when(t < 0.5, 2.0 * t * t).otherwise(1.0 - (2.0 - 2.0 * t) * (2.0 - 2.0 * t) / 2.0),
}


def interpolated(asked: DataFrame, known: DataFrame, columns: list, max_gap: int | None = None, clamp: bool = True, easing: str = "linear") -> DataFrame:
    """run_id, frame and columns between the rows of known around each frame.

    With clamp, frames before the first and after the last row take its values, else null. A bracket
    wider than max_gap frames gives null.
    """
    both = bracketed(asked, known.select("run_id", "frame", *columns))
    wide = F.col("b_frame") - F.col("a_frame")
    t = EASINGS[easing](F.when(wide > 0, (F.col("frame") - F.col("a_frame")) / wide).otherwise(F.lit(0.0)))
    near = F.lit(True) if max_gap is None else wide <= max_gap

    def between(c):
        a, b = F.col("a")[c], F.col("b")[c]
        inside = F.when(near, a + t * (b - a))
        return F.when(F.col("a").isNull(), b if clamp else None).when(F.col("b").isNull(), a if clamp else None).otherwise(inside).alias(c)

    return both.select("run_id", "frame", *(between(c) for c in columns))


def moving_means(rows: DataFrame, columns: list, reach: int = 2, weight: str | None = None, divide_by: str | None = None) -> DataFrame:
    """run_id, frame and means of columns over the rows around each, weighted if asked, and divided by the mean of one of them (a homography by its last entry)."""
    w = Window.partitionBy("run_id").orderBy("frame").rowsBetween(-reach, reach)
    factor = F.col(weight) if weight else F.lit(1.0)
    means = rows.select("run_id", "frame", *((F.sum(F.col(c) * factor).over(w) / F.sum(factor).over(w)).alias(c) for c in columns))
    return means if divide_by is None else means.select("run_id", "frame", *((F.col(c) / F.col(divide_by)).alias(c) for c in columns))


def merged_both_ways(forward: DataFrame, backward: DataFrame, columns: list, divide_by: str | None = None) -> DataFrame:
    """run_id, frame, columns, confidence, source of two chains(run_id, frame, distance, confidence, columns), each weighted by the inverse of its distance to its anchor plus one."""
    f = forward.select("run_id", "frame", F.struct("distance", "confidence", *columns).alias("f"))
    b = backward.select("run_id", "frame", F.struct("distance", "confidence", *columns).alias("b"))
    both = f.join(b, ["run_id", "frame"], "full")
    wf, wb = 1.0 / (F.col("f.distance") + 1), 1.0 / (F.col("b.distance") + 1)
    share = wf / (wf + wb)
    mix = lambda c: F.when(F.col("f").isNull(), F.col("b")[c]).when(F.col("b").isNull(), F.col("f")[c]).otherwise(share * F.col("f")[c] + (1.0 - share) * F.col("b")[c])
    source = F.when(F.col("f").isNull(), "backward").when(F.col("b").isNull(), "forward").otherwise("both")
    out = both.select("run_id", "frame", *(mix(c).alias(c) for c in columns), mix("confidence").alias("confidence"), source.alias("source"))
    return out if divide_by is None else out.withColumns({c: F.when(F.col("source") == "both", F.col(c) / F.col(divide_by)).otherwise(F.col(c)) for c in columns})


def drift(steps: DataFrame, limit: float = 50.0) -> DataFrame:
    """run_id, frame, cumulative, confidence of steps(run_id, frame, h (nine entries, null if unknown), inlier_ratio) from frame to frame.

    A step adds its shift and ten times its rotation in radians, an unknown one ten; confidence falls
    with the inliers below 0.7 and exponentially with what has added up, and is 0 at an unknown step.
    """
    h = lambda i: F.get("h", F.lit(i))
    turn = F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (h(3) - h(1)) / 2))))
    add = F.when(F.col("h").isNull(), F.lit(10.0)).otherwise(F.sqrt(h(2) * h(2) + h(5) * h(5)) + 10.0 * turn)
    total = F.sum("add").over(Window.partitionBy("run_id").orderBy("frame"))
    rows = steps.withColumn("add", add).withColumn("cumulative", total)
    sure = F.least(F.lit(1.0), F.coalesce("inlier_ratio", F.lit(0.5)) / 0.7) * F.exp(-F.col("cumulative") / limit)
    return rows.select("run_id", "frame", "cumulative", F.when(F.col("h").isNull(), F.lit(0.0)).otherwise(sure).alias("confidence"))


def anchor_gaps(anchors: DataFrame, min_gap: int) -> DataFrame:
    """run_id, start_frame, end_frame, gap of neighbouring anchors at least min_gap frames apart."""
    rows = anchors.select("run_id", F.col("frame").alias("start_frame"), F.lead("frame").over(Window.partitionBy("run_id").orderBy("frame")).alias("end_frame"))
    return rows.withColumn("gap", F.col("end_frame") - F.col("start_frame")).where(F.col("gap") >= min_gap)


def turning_points(anchors: DataFrame, rate: float = -0.5, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, start_frame, end_frame, t, frame: where between neighbouring anchors(run_id, frame, pan) the camera turns back, if it pans at `rate` degrees a second first; t must lie in 0.2 to 0.8."""
    w = Window.partitionBy("run_id").orderBy("frame")
    rows = anchors.select("run_id", F.col("frame").alias("start_frame"), F.lead("frame").over(w).alias("end_frame"), (F.lead("pan").over(w) - F.col("pan")).alias("turn")).where("end_frame IS NOT NULL")
    whole = rate * (F.col("end_frame") - F.col("start_frame")) / p.fps
    rows = rows.withColumn("t", F.when(F.abs(whole) >= 0.1, F.col("turn") / (2.0 * whole) + 0.5)).where(F.col("t").between(0.2, 0.8))
    return rows.select("run_id", "start_frame", "end_frame", "t", F.floor(F.col("start_frame") + F.col("t") * (F.col("end_frame") - F.col("start_frame"))).cast("long").alias("frame"))


def warm_starts(calibrations: DataFrame, limit: float = 15.0) -> DataFrame:
    """run_id, frame, warm: may a frame start from the one before? Only if that one's error is under the limit."""
    before = F.lag("error").over(Window.partitionBy("run_id").orderBy("frame"))
    return calibrations.select("run_id", "frame", F.coalesce(before < limit, F.lit(False)).alias("warm"))


def reanchor_frames(steps: DataFrame, limit: float = 50.0, sure: float = 0.3, least: float = 0.4) -> DataFrame:
    """run_id, frame of steps, as drift() takes them, that need a new anchor.

    One does where the drift so far is over the limit, where its confidence is under `sure`, or where the
    mean inlier ratio of the last three frames is under a least one; the first two of a run have no such mean.
    """
    w = Window.partitionBy("run_id").orderBy("frame").rowsBetween(-2, 0)
    trend = steps.select("run_id", "frame", F.avg("inlier_ratio").over(w).alias("mean"), F.count("*").over(w).alias("n"))
    rows = drift(steps, limit).join(trend, ["run_id", "frame"])
    low = F.coalesce((F.col("n") >= 3) & (F.col("mean") < least), F.lit(False))
    return rows.where((F.col("cumulative") > limit) | (F.col("confidence") < sure) | low).select("run_id", "frame")


def focal_gate(calibrations: DataFrame, prior: float, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Rows whose focal length is within a share of the prior, bounds included."""
    return calibrations.where(F.col("focal").between(prior * low, prior * high))


def key_frames(metrics: DataFrame, threshold: float) -> DataFrame:
    """run_id, frame of the first frame of each run and of those that differ by more than a threshold: metrics(run_id, frame, difference to the frame before)."""
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("frame")) == 1
    return metrics.withColumn("first", first).where(F.col("first") | (F.col("difference") > threshold)).select("run_id", "frame")


def ratio_test(matches: DataFrame, ratio: float = 0.75) -> DataFrame:
    """run_id, query, train, distance of the best match, where it is clearly nearer than the second; queries with one match are dropped."""
    w = Window.partitionBy("run_id", "query").orderBy("distance", "train")
    two = matches.select("run_id", "query", "train", "distance", F.row_number().over(w).alias("rank"), F.lead("distance").over(w).alias("second"))
    return two.where((F.col("rank") == 1) & (F.col("distance") < ratio * F.col("second"))).select("run_id", "query", "train", "distance")


def sustained_kicks(goals: DataFrame, states: DataFrame, back_seconds: float = 5.0, slow: float = 7.0, fast: float = 10.0, floor: float = 8.0, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame, kick_frame: the last slow observation before the ball, fast at once, keeps its speed up to the goal; null where there is none."""
    back = int(back_seconds * p.fps)
    marks = goals.select("run_id", F.col("frame").alias("goal")).distinct()
    seen = marks.withColumn("frame", F.explode(F.sequence(F.greatest(F.lit(0), F.col("goal") - back), "goal"))).join(states.select("run_id", "frame", "speed"), ["run_id", "frame"])
    w = Window.partitionBy("run_id", "goal").orderBy("frame")
    rest = F.min("speed").over(w.rowsBetween(0, Window.unboundedFollowing))
    steps = seen.select("run_id", "goal", "speed", F.lag("frame").over(w).alias("before"), F.lag("speed").over(w).alias("was"), rest.alias("least"))
    kicks = steps.where((F.col("was") <= slow) & (F.col("speed") >= fast) & (F.col("least") >= floor)).groupBy("run_id", "goal").agg(F.max("before").alias("kick_frame"))
    return marks.join(kicks, ["run_id", "goal"], "left").select("run_id", F.col("goal").alias("frame"), "kick_frame")


def positions_before(moments: DataFrame, states: DataFrame, frames: int = 30) -> DataFrame:
    """moments with x and y of the last ball state up to the frame, null if it is more than some frames back."""
    found = bracketed(moments.select("run_id", "frame").distinct(), states.select("run_id", "frame", "x", "y"))
    near = F.col("frame") - F.col("a_frame") <= frames
    return moments.join(found.select("run_id", "frame", F.when(near, F.col("a.x")).alias("x"), F.when(near, F.col("a.y")).alias("y")), ["run_id", "frame"], "left")
