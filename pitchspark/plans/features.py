"""The feature table: tracking plus 13 movement and tactical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pitchspark.operators.frames import BALL_DISTANCE, NEAREST, TEAM_SHAPE, add_frame_features
from pitchspark.operators.kinematics import add_kinematics
from pitchspark.operators.skew import HOT_AGENT_ROWS, HOT_FRAME_ROWS
from pitchspark.schema import FEATURE_VALUES, TRACKING_COLUMNS, canonical_tracking


def compute_features(
    tracking: DataFrame,
    hot_agent_rows: int | None = HOT_AGENT_ROWS,
    hot_frame_rows: int | None = HOT_FRAME_ROWS,
) -> DataFrame:
    """Add all feature columns, in two shuffles: by agent, then by frame."""
    base = canonical_tracking(tracking).drop(*FEATURE_VALUES)
    extras = [c for c in base.columns if c not in TRACKING_COLUMNS]
    moving = add_kinematics(base, hot_agent_rows)
    out = add_frame_features(
        moving, BALL_DISTANCE + NEAREST + TEAM_SHAPE, hot_frame_rows, counted=base
    )
    return out.select(*TRACKING_COLUMNS, *extras, *FEATURE_VALUES)
