"""Presence of players over a stream of sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence_sessions(sightings: DataFrame, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """player_id, started, ended, n: stretches in which a player is seen again within the gap.

    sightings(player_id, ts), a stream or a table. In a stream a stretch is given out when the watermark
    has passed its end; sightings later than `late` are dropped.
    """
    seen = sightings.withWatermark("ts", late) if sightings.isStreaming else sightings
    stretches = seen.groupBy("player_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("ended"))
    return stretches.select("player_id", F.col("session_window.start").alias("started"), "ended", "n")
