"""Coordinate conversions into metres on the canonical pitch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchspark.constants import PITCH_LENGTH_M, PITCH_WIDTH_M

# The event provider's 120 x 80 grid.
GRID_LENGTH = 120.0
GRID_WIDTH = 80.0


def to_meters_from_normalized(
    x: Column, y: Column, length: float = PITCH_LENGTH_M, width: float = PITCH_WIDTH_M
) -> tuple[Column, Column]:
    """Coordinates in 0..1 to metres."""
    return x * F.lit(length), y * F.lit(width)


def center_to_top_left(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres around the centre spot (y up) to metres from the top-left corner (y down)."""
    both = x.isNotNull() & y.isNotNull()
    return (
        F.when(both, x + F.lit(PITCH_LENGTH_M / 2)),
        F.when(both, F.lit(PITCH_WIDTH_M / 2) - y),
    )


def grid_to_meters(location: Column) -> tuple[Column, Column]:
    """An ``[x, y, ...]`` array on the 120 x 80 grid to metres; null when shorter than two."""
    long_enough = F.size(location) >= 2
    return (
        F.when(long_enough, F.get(location, F.lit(0)) / F.lit(GRID_LENGTH) * F.lit(PITCH_LENGTH_M)),
        F.when(long_enough, F.get(location, F.lit(1)) / F.lit(GRID_WIDTH) * F.lit(PITCH_WIDTH_M)),
    )


def clamp(c: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; unlike bare ``greatest``/``least``, a missing value stays missing."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def on_pitch(x: Column, y: Column, length: float, width: float) -> Column:
    return x.between(0.0, length) & y.between(0.0, width)
