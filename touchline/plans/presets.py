"""Detector parameters: the built-in defaults and the shipped match template."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Preset:
    fps: float = 25.0
    half_length: float = 52.5
    half_width: float = 34.0
    goal_half_width: float = 3.66
    goal_height: float = 2.44
    ball_confidence: float = 0.1
    possession_distance: float = 1.5
    possession_seconds: float = 1.0
    possession_speed_break: float = 15.0
    pass_speed: float = 5.0
    pass_transit_seconds: float = 1.0
    shot_speed: float = 10.0
    carry_seconds: float = 2.0
    carry_total: float = 5.0
    carry_forward: float = 3.0


CODE_DEFAULTS = Preset()
TEMPLATE = Preset(
    ball_confidence=0.15,
    possession_distance=3.0,
    possession_seconds=0.5,
    possession_speed_break=20.0,
    pass_speed=3.0,
    pass_transit_seconds=3.0,
    shot_speed=8.0,
    carry_seconds=1.0,
    carry_total=3.0,
    carry_forward=2.0,
)
