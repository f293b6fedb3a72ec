"""Running speed and ball carrier, frame by frame: one rule for a table and for a stream.

A table is numbered by key and frame and read batch by batch, with the state of one key at a time; a
table that lies by run already is not shuffled for it. A stream keeps each key's state in Spark's state
store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.geometry import hypot

#: Steps that a speed spans, weight of the newest, most m/s, frames after which a track starts anew.
SPAN, WEIGHT, TOP, STALE = 5, 0.4, 15.0, 25
#: Reach of a carrier in metres, frames that a new one must hold the ball, teams that carry.
CARRIER_REACH, CONFIRM, TEAMS = 2.0, 5, ("team_A", "team_B")


def _speed(state: tuple | None, row: tuple, fps: float) -> tuple:
    """(state, speed) after a row (frame, x, y); state is (frames, xs, ys, speed) of the last SPAN + 1 rows."""
    frames, xs, ys, speed = state if state and row[0] - state[0][-1] <= STALE else ([], [], [], None)
    frames, xs, ys = ([*old, new][-SPAN - 1 :] for old, new in zip((frames, xs, ys), row))
    seconds = (frames[-1] - frames[0]) / fps
    if seconds > 0:
        now = min(TOP, ((xs[-1] - xs[0]) ** 2 + (ys[-1] - ys[0]) ** 2) ** 0.5 / seconds)
        speed = now if speed is None else WEIGHT * now + (1 - WEIGHT) * speed
    return (frames, xs, ys, speed), speed


def _carrier(state: tuple | None, row: tuple) -> tuple:
    """(state, carrier) after a row (frame, player nearest to the ball or None); state is (carrier, pending, count)."""
    carrier, pending, count = state or (None, None, 0)
    near = row[1]
    if near is None:
        carrier, pending, count = None, None, 0
    elif near == carrier:
        pending, count = None, 0
    else:
        pending, count = near, count + 1 if near == pending else 1
        if count >= CONFIRM:
            carrier, pending, count = near, None, 0
    return (carrier, pending, count), carrier


def _folded(rows: DataFrame, keys: list, columns: list, step: Callable, name: str, kind: str, state: str) -> DataFrame:
    """(*keys, frame, name): what step gives for each row of a key in order of frame; rows of one frame go by the other columns."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "frame long", f"{name} {kind}"])
    picked = rows.select(*keys, *columns)
    if not rows.isStreaming:

        def run(batches: Iterator[pa.RecordBatch]):
            held = None
            for batch in batches:
                *own, places = [batch.column(i).to_pylist() for i in range(len(keys), batch.num_columns)]
                out = []
                for place, row in zip(places, zip(*own)):
                    held, value = step(None if place == 1 else held, row)
                    out.append(value)
                names = [*keys, "frame", name]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.array(out, pa.float64() if kind == "double" else pa.string())], names=names)

        # The window deals rows by key where they don't lie so yet, and leaves them in order; a repartition would move them all.
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*columns))
        return picked.withColumn("_place", place).sortWithinPartitions(*keys, *columns).mapInArrow(run, schema)

    def update(key, frames, kept):
        held = kept.get if kept.exists else None
        held = held and tuple(list(x) if hasattr(x, "__len__") and not isinstance(x, str) else x for x in held)
        held = held and tuple(None if isinstance(x, float) and pd.isna(x) else x for x in held)
        new = pd.concat(list(frames)).sort_values(columns)
        out = []
        for row in new[columns].itertuples(index=False):
            held, value = step(held, tuple(None if not isinstance(x, str) and pd.isna(x) else x for x in row))
            out.append(value)
        kept.update(held)
        yield pd.DataFrame({**{k: [v] * len(new) for k, v in zip(keys, key)}, "frame": new["frame"].to_numpy(), name: pd.Series(out, dtype="float64" if kind == "double" else "object")})

    return picked.groupBy(*keys).applyInPandasWithState(update, schema, state, "append", GroupStateTimeout.NoTimeout)


def running_speeds(rows: DataFrame, fps: float = 25.0) -> DataFrame:
    """run_id, track_id, frame, speed of rows(run_id, track_id, frame, x, y), a table or a stream whose frames come in order.

    A speed is the way over the last six rows by their time, at most 15 m/s, mixed 0.4 to 0.6 with the
    one before; null for a first row. After more than 25 frames without a row a track starts anew. Rows
    without a place don't count.
    """
    seen = rows.where("x IS NOT NULL AND y IS NOT NULL").select("run_id", "track_id", F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return _folded(seen, ["run_id", "track_id"], ["frame", "x", "y"], lambda s, r: _speed(s, r, fps), "speed", "double", "frames array<long>, xs array<double>, ys array<double>, speed double")


def nearest_carriers(frames: DataFrame, ball: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """run_id, frame, player_id: who of the two teams is nearest to the ball and within 2 m, null if nobody or without a ball.

    frames(run_id, frame) are all that count; a team table with roles leaves goalkeepers out. Of equally near ones the first by ord.
    """
    own = teams.where(F.col("team").isin(*TEAMS) & (F.coalesce("role", F.lit("")) != "goalkeeper" if "role" in teams.columns else F.lit(True))).select("player_id")
    here = players.select("run_id", "frame", "ord", "player_id", F.col("x").alias("px"), F.col("y").alias("py"))
    d = hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    # The ball's places are hashed, so bodies of all frames are not sorted; the few within reach are asked for their team, so that join moves no others.
    close = ball.select("run_id", "frame", "x", "y").hint("shuffle_hash").join(here, ["run_id", "frame"]).select("run_id", "frame", "ord", "player_id", d.alias("d")).where(F.col("d") <= CARRIER_REACH)
    near = close.join(own, "player_id").groupBy("run_id", "frame").agg(F.min_by("player_id", F.struct("d", "ord")).alias("player_id"))
    return frames.select("run_id", "frame").distinct().join(near, ["run_id", "frame"], "left")


def carriers(near: DataFrame) -> DataFrame:
    """run_id, frame, carrier of near(run_id, frame, player_id), a table or a stream whose frames come in order.

    A player becomes the carrier at the fifth frame in a row as the nearest; a frame without anybody ends it.
    """
    seen = near.select("run_id", F.col("frame").cast("long").alias("frame"), "player_id")
    return _folded(seen, ["run_id"], ["frame", "player_id"], _carrier, "carrier", "string", "carrier string, pending string, count long")
