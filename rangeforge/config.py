"""Parameters of the operators, with the defaults the sensor programs use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AxisSpec:
    """Which column looks ahead and with what sign, which is sideways, which is up."""

    forward: str = "y"
    sign: int = -1
    lateral: str = "x"
    vertical: str = "z"


@dataclass(frozen=True)
class Grid:
    """Half-open bins of width res from lo to hi in both directions of a plane."""

    u_lo: float = -5.0
    u_hi: float = 5.0
    v_lo: float = -4.0
    v_hi: float = 4.0
    res: float = 0.5


@dataclass(frozen=True)
class ShadowConfig:
    d0: float = 30.0
    res: float = 0.10
    margin: float = 0.5
    frac: float = 0.5
    min_px: int = 6
    f_min: float = 0.3
    window: int = 5
    buffer: int = 10
    prime: int = 5


@dataclass(frozen=True)
class RadarGrid:
    theta_step: float = 0.3
    d_min: float = 2.0
    d_near: float = 13.2
    d_max: float = 40.0
    near_step: float = 0.02
    far_step: float = 1.0
    wall_score: float = 200.0


@dataclass(frozen=True)
class SliceConfig:
    chunk: float = 2.0
    width: float = 3.0
    height: float = 2.1
    eps: float = 0.25
    min_pts: int = 3
    min_size: float = 0.1
    gauge: float = 1.52
    rail_height: float = 1.075
    d_lo: float = 0.5
    d_hi: float = 60.0


@dataclass(frozen=True)
class OccupancyConfig:
    d_bin: float = 2.0
    y_bin: float = 0.1
    d_max: float = 180.0
    y_max: float = 3.5
    fill: float = 0.6
    excess: float = 2.0
