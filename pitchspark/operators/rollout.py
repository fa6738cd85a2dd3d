"""Constant-velocity baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.constants import PITCH_LENGTH_M, PITCH_WIDTH_M
from pitchspark.functions.coordinates import clamp


def constant_velocity_rollout(
    anchors: DataFrame, future_steps: int, dt: float, clip_players: bool = True
) -> DataFrame:
    """Roll each row's position forward for steps 1..future_steps at its own velocity.

    Needs x_m, y_m, vx_mps and vy_mps. Adds ``step``, ``pred_x_m`` and ``pred_y_m``. Clipping
    holds every agent on the pitch, the ball included. A missing input stays missing.
    """
    if future_steps < 1:
        return anchors.where(F.lit(False)).withColumns({
            "step": F.lit(0), "pred_x_m": F.lit(0.0), "pred_y_m": F.lit(0.0)
        })
    ahead = F.col("step").cast("double") * F.lit(float(dt))
    x = F.col("x_m") + ahead * F.col("vx_mps")
    y = F.col("y_m") + ahead * F.col("vy_mps")
    if clip_players:
        x, y = clamp(x, 0.0, PITCH_LENGTH_M), clamp(y, 0.0, PITCH_WIDTH_M)
    return anchors.withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(future_steps)))
    ).withColumns({"pred_x_m": x, "pred_y_m": y})
