"""Passes told by the ball's speed alone, and their union with those between possession spans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.presets import TEMPLATE, Preset
from ..plans.staging import stored
from .shots import kick_holders, without_self_passes


@dataclass(frozen=True)
class TransitionPreset:
    """Speeds in m/s before, at and after a pass, reach in metres of passer and receiver, times in seconds."""

    slow_before: float = 7.0
    fast: float = 10.0
    floor: float = 8.0
    settled: float = 7.0
    passer_reach: float = 1.0
    receiver_reach: float = 2.0
    passer_seconds: float = 1.0
    receiver_seconds: float = 1.5
    flight_seconds: float = 4.0
    cover_seconds: float = 0.5


def speed_envelopes(states: DataFrame, q: TransitionPreset = TransitionPreset(), p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame, x, y, settle_frame, settle_x, settle_y: flights of the ball from a slow state over a fast one to a slow one.

    A flight starts at a slow state followed by a fast one and settles at the first slow state within
    the longest flight. States are gone through once: after a flight the search goes on behind its
    end, and after a start that doesn't settle in time behind all states of the time it had.  Starts
    are few; only runs of them that overlap are folded in order, each on its own.
    """
    w = Window.partitionBy("run_id").orderBy("frame")
    reach = int(q.flight_seconds * p.fps)
    ends = F.struct("frame", "x", "y", "i")
    rows = states.select("run_id", "frame", "x", "y", "speed", F.row_number().over(w).alias("i"), F.count("*").over(w.rangeBetween(Window.unboundedPreceding, reach)).alias("within"))
    calm = F.when((F.col("speed") <= q.settled) & (F.col("speed") < q.floor), ends)
    before = F.lag(F.struct("frame", "x", "y", "speed", "within")).over(w)
    # The next calm state is the last one of those gone through backwards: one pass, where a look ahead from each row would be a pass for each.
    behind = Window.partitionBy("run_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"before": before, "calm": F.last(calm, ignorenulls=True).over(behind)})
    starts = rows.where((F.col("before.speed") <= q.slow_before) & (F.col("speed") >= q.fast))
    settles = F.coalesce(F.col("calm.frame") <= F.col("before.frame") + reach, F.lit(False))
    # The next state to look at: behind the settled one, or behind the first state beyond the time.
    starts = starts.select("run_id", "i", F.when(settles, F.col("calm.i") + 1).otherwise(F.greatest(F.col("before.within") + 1, F.col("i")) + 1).alias("next"), F.when(settles, F.struct(F.col("before.frame").alias("frame"), F.col("before.x").alias("x"), F.col("before.y").alias("y"), F.col("calm.frame").alias("settle_frame"), F.col("calm.x").alias("settle_x"), F.col("calm.y").alias("settle_y"))).alias("flight"))
    o = Window.partitionBy("run_id").orderBy("i")
    busy = F.max("next").over(o.rowsBetween(Window.unboundedPreceding, -1))
    chains = starts.withColumn("chain", F.sum((F.col("i") >= F.coalesce(busy, F.lit(0))).cast("int")).over(o))
    folded = chains.groupBy("run_id", "chain").agg(F.array_sort(F.collect_list(F.struct("i", "next", "flight"))).alias("starts"))
    begin = F.struct(F.lit(0).cast("long").alias("from"), F.slice("starts", 1, 0).alias("taken"))
    step = lambda acc, s: F.when(s["i"] < acc["from"], acc).otherwise(F.struct(s["next"].cast("long").alias("from"), F.array_append(acc["taken"], s).alias("taken")))
    taken = folded.select("run_id", F.explode(F.aggregate("starts", begin, step)["taken"]).alias("s")).where("s.flight IS NOT NULL")
    return taken.select("run_id", "s.flight.*")


def receivers(settled: DataFrame, near: DataFrame, q: TransitionPreset = TransitionPreset(), p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame, receiver_id, receiver_team, receive_frame: who first is near the ball after a frame, none where nobody is in time. settled(run_id, frame)."""
    marks = settled.select("run_id", F.col("frame").alias("settle")).distinct().withColumn("frame", F.explode(F.sequence(F.col("settle"), F.col("settle") + int(q.receiver_seconds * p.fps))))
    met = marks.join(near.where(F.col("player_id").isNotNull() & (F.col("distance") <= q.receiver_reach)).select("run_id", "frame", "player_id", "team"), ["run_id", "frame"])
    first = met.groupBy("run_id", "settle").agg(F.min_by(F.struct("player_id", "team", "frame"), "frame").alias("r"))
    return first.select("run_id", F.col("settle").alias("frame"), F.col("r.player_id").alias("receiver_id"), F.col("r.team").alias("receiver_team"), F.col("r.frame").alias("receive_frame"))


def transition_passes(states: DataFrame, near: DataFrame, passes: DataFrame, q: TransitionPreset = TransitionPreset(), p: Preset = TEMPLATE) -> DataFrame:
    """Flights between two players that no pass of `passes` covers: run_id, frame, player_id, team, receiver_id, receiver_team, end_frame, x, y, end_x, end_y, pass_length, outcome, receive_frame.

    A flight is covered by a pass within half a second of its start. The passer is who held the ball
    before the start; end_frame is where the ball settles.
    """
    flights = speed_envelopes(states, q, p)
    window = int(q.cover_seconds * p.fps)
    covered = passes.select("run_id", F.explode(F.sequence(F.col("frame") - window, F.col("frame") + window)).alias("frame")).distinct()
    flights = stored(flights.join(covered, ["run_id", "frame"], "left_anti"), "flights")
    passers = kick_holders(flights, near, q.passer_seconds, q.passer_reach, p).where("player_id IS NOT NULL")
    got = receivers(flights.select("run_id", F.col("settle_frame").alias("frame")), near, q, p).withColumnRenamed("frame", "settle_frame")
    found = flights.join(passers, ["run_id", "frame"]).join(got, ["run_id", "settle_frame"]).where("receiver_id <> player_id")
    dx, dy = F.col("settle_x") - F.col("x"), F.col("settle_y") - F.col("y")
    return found.select(
        "run_id", "frame", "player_id", "team", "receiver_id", "receiver_team", F.col("settle_frame").alias("end_frame"), "x", "y", F.col("settle_x").alias("end_x"), F.col("settle_y").alias("end_y"),
        F.sqrt(dx * dx + dy * dy).alias("pass_length"), F.when(F.col("team") == F.col("receiver_team"), "successful").otherwise("failed").alias("outcome"), "receive_frame",
    )


def all_passes(states: DataFrame, near: DataFrame, passes: DataFrame, q: TransitionPreset = TransitionPreset(), p: Preset = TEMPLATE) -> DataFrame:
    """Bridge passes and the transition passes that they don't cover, with source, confidence and event_id by frame."""
    bridge = passes.withColumns({"source": F.lit("possession_bridge"), "confidence": F.lit(1.0), "receive_frame": F.lit(None).cast("long")})
    flown = transition_passes(states, near, passes, q, p).withColumns({"source": F.lit("speed_transition"), "confidence": F.lit(0.9)})
    return without_self_passes(bridge.unionByName(flown))
