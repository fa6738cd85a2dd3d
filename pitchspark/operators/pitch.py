"""Row-wise pitch operators: clipping, flipping and bounds checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.constants import PITCH_LENGTH_M, PITCH_WIDTH_M
from pitchspark.functions.casts import no_nan
from pitchspark.functions.coordinates import clamp, on_pitch

ROW_KEYS = ["match_id", "period", "frame_id", "time_s", "agent_id"]


def _number(name: str) -> Column:
    return no_nan(F.col(name).try_cast("double"))


def _replace(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.withColumns({name: c for name, c in changes.items() if name in df.columns})


def clip_to_pitch(
    df: DataFrame, length: float = PITCH_LENGTH_M, width: float = PITCH_WIDTH_M
) -> DataFrame:
    """Limit positions to the pitch; missing ones stay missing."""
    return _replace(df, {
        "x_m": clamp(_number("x_m"), 0.0, length),
        "y_m": clamp(_number("y_m"), 0.0, width),
    })


def flip_left_to_right(
    df: DataFrame, length: float = PITCH_LENGTH_M, width: float = PITCH_WIDTH_M
) -> DataFrame:
    """Turn the pitch by half a turn: positions mirrored, velocities negated."""
    return _replace(df, {
        "x_m": F.lit(length) - _number("x_m"),
        "y_m": F.lit(width) - _number("y_m"),
        "vx_mps": -_number("vx_mps"),
        "vy_mps": -_number("vy_mps"),
    })


def off_pitch(length: float = PITCH_LENGTH_M, width: float = PITCH_WIDTH_M) -> Column:
    """Whether a row has a position, off the pitch."""
    x, y = _number("x_m"), _number("y_m")
    return x.isNotNull() & y.isNotNull() & ~on_pitch(x, y, length, width)


def out_of_bounds_rows(
    df: DataFrame, length: float = PITCH_LENGTH_M, width: float = PITCH_WIDTH_M
) -> DataFrame:
    """Keys and positions of the rows off the pitch; none when a position column is missing."""
    shown = [c for c in [*ROW_KEYS, "x_m", "y_m"] if c in df.columns]
    if not {"x_m", "y_m"} <= set(df.columns):
        return df.select(*shown).where(F.lit(False))
    return df.where(off_pitch(length, width)).select(*shown)


def validate_pitch_bounds(
    df: DataFrame, length: float = PITCH_LENGTH_M, width: float = PITCH_WIDTH_M
) -> DataFrame:
    """One row: ok, out_of_bounds_rows, message."""
    if not {"x_m", "y_m"} <= set(df.columns):
        return df.sparkSession.createDataFrame(
            [(False, 0, "Both x_m and y_m are needed.")],
            "ok boolean, out_of_bounds_rows bigint, message string",
        )
    count = df.agg(F.count_if(off_pitch(length, width)).alias("out_of_bounds_rows"))
    ok = F.col("out_of_bounds_rows") == 0
    return count.select(
        ok.alias("ok"),
        "out_of_bounds_rows",
        F.when(ok, "ok").otherwise("Some positions lie outside the pitch.").alias("message"),
    )
