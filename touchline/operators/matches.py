"""All events of a match as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.presets import TEMPLATE, Preset
from ..plans.staging import stored
from .events import ball_states, bridge_passes, interceptions, nearest_player, possession_spans
from .shots import detected_shots


def match_events(ball: DataFrame, players: DataFrame, teams: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """All events as rows: run_id, type, frame, match_time, player_id, team, outcome.

    Shots and goals come by the whole chain: crossings and approaches, outcomes, shooters, de-duplication.
    """
    states = stored(ball_states(ball, p), "states")
    spans = stored(possession_spans(nearest_player(states, players, teams), p), "spans")
    return events_of(spans, stored(bridge_passes(spans, states, p), "passes"), detected_shots(states, ball, players, teams, p=p), p)


def events_of(spans: DataFrame, passes: DataFrame, shots: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """The same from tables that are there already."""
    row = lambda df, kind, outcome: df.select("run_id", kind.alias("type"), "frame", (F.col("frame") / p.fps).alias("match_time"), "player_id", "team", outcome.cast("string").alias("outcome"))
    return (
        row(spans.withColumnRenamed("start_frame", "frame"), F.lit("possession"), F.lit(None))
        .unionByName(row(passes, F.lit("pass"), F.col("outcome")))
        .unionByName(row(interceptions(passes), F.lit("interception"), F.lit(None)))
        .unionByName(row(shots, F.col("type"), F.col("outcome")))
    )
