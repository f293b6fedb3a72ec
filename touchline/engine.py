"""Event detection with detectors that can be added to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import duels, events, passes, shots
from .plans.presets import TEMPLATE, Preset
from .plans.staging import stored

EVENT_COLUMNS = ("run_id", "type", "frame", "player_id", "team", "outcome", "confidence")
_DETECTORS: dict[str, Callable[[dict, Preset], DataFrame]] = {}


def detector(name: str):
    """Adds a detector: a function of the match's tables and a preset that gives EVENT_COLUMNS, or some of them.

    Beside ball, players and teams the tables have states, spans and passes, computed once.
    """

    def add(function):
        _DETECTORS[name] = function
        return function

    return add


def _rows(df: DataFrame, kind: str, confidence: float, **columns) -> DataFrame:
    return df.withColumns({"type": F.lit(kind), "confidence": F.lit(confidence)} | columns)


@detector("possession")
def _possession(t, p):
    return _rows(t["spans"].withColumnRenamed("start_frame", "frame"), "possession", 1.0)


@detector("pass")
def _pass(t, p):
    return _rows(t["passes"], "pass", 1.0)


@detector("interception")
def _interception(t, p):
    return _rows(events.interceptions(t["passes"]), "interception", 0.8)


@detector("carry")
def _carry(t, p):
    return _rows(duels.carries(t["spans"], t["players"], t["teams"], p), "carry", 1.0)


@detector("tackle")
def _tackle(t, p):
    return _rows(duels.tackles(t["spans"], t["passes"], t["states"], t["players"], t["teams"], p=p), "tackle", 0.8)


@detector("shot")
def _shot(t, p):
    return shots.detected_shots(t["states"], t["ball"], t["players"], t["teams"], t.get("kicks"), p=p)


def detect_events(tables: dict[str, DataFrame], p: Preset = TEMPLATE, names: tuple | None = None, seconds: tuple | None = None) -> DataFrame:
    """EVENT_COLUMNS and match_time of all detectors, or the named ones, within a range of rounded times if asked.

    tables has ball, players and teams, as match_tables() and match_context() give them.
    """
    unknown = set(names or ()) - set(_DETECTORS)
    if unknown:
        raise KeyError(f"no detector is called {sorted(unknown)}")
    states = stored(events.ball_states(tables["ball"], p), "states")
    spans = stored(events.possession_spans(events.nearest_player(states, tables["players"], tables["teams"]), p), "spans")
    whole = tables | {"states": states, "spans": spans, "passes": stored(events.bridge_passes(spans, states, p), "passes")}
    found = None
    for name in names or tuple(_DETECTORS):
        rows = _DETECTORS[name](whole, p)
        rows = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast({"frame": "long", "confidence": "double"}.get(c, "string") if c != "run_id" else rows.schema["run_id"].dataType).alias(c) for c in EVENT_COLUMNS))
        found = rows if found is None else found.union(rows)
    out = found.withColumn("match_time", F.col("frame") / p.fps)
    return out if seconds is None else out.where(F.round("match_time", 2).between(*seconds))
