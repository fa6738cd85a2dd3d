"""Data-quality checks on canonical tracking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchspark.constants import (
    AGENT_KEYS,
    BALL,
    BALL_SPEED_LIMIT_MPS,
    PLAYER_SPEED_LIMIT_MPS,
)
from pitchspark.operators.kinematics import add_kinematics
from pitchspark.operators.pitch import off_pitch, out_of_bounds_rows, validate_pitch_bounds
from pitchspark.operators.skew import HOT_AGENT_ROWS, SLICE_ROWS, HotKeys, sliced
from pitchspark.operators.timeseries import neighbours, nulls_last
from pitchspark.schema import canonical_tracking

FRAME_FALLS = "frame_id decreases"


def _falls() -> Column:
    ordered = Window.partitionBy(*AGENT_KEYS).orderBy(*nulls_last(["time_s", "frame_id"]))
    return F.col("frame_id") < F.lag("frame_id").over(ordered)


def _falls_in_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("_falls", _falls()).groupBy(*AGENT_KEYS).agg(F.bool_or("_falls").alias("_falls"))


def _falls_in_slices(df: DataFrame, slice_rows: int) -> DataFrame:
    """Rows of one time shrink to their lowest and highest frame, then slices are compared."""
    moments = df.groupBy(*AGENT_KEYS, "time_s").agg(
        F.min("frame_id").alias("low"),
        # A row without a frame comes last at its time and is compared with nothing.
        F.when(F.count("*") == F.count("frame_id"), F.max("frame_id")).alias("high"),
    )
    moments = sliced(moments, nulls_last([*AGENT_KEYS, "time_s"]), slice_rows)
    around = neighbours(
        moments, AGENT_KEYS, nulls_last(["time_s"]), F.struct("low", "high"), 1, "_slice"
    )
    return around.groupBy(*AGENT_KEYS).agg(
        F.bool_or(F.col("low") < F.col("prev1.high")).alias("_falls")
    )


def frame_monotonicity(
    tracking: DataFrame,
    hot_rows: int | None | HotKeys = HOT_AGENT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The (match, period, agent) series whose frame_id falls while time goes on."""
    df = tracking.select(*AGENT_KEYS, "time_s", "frame_id")
    hot = HotKeys.of(df, AGENT_KEYS, hot_rows)
    out = _falls_in_rows(hot.cool(df))
    if hot.any:
        out = out.unionByName(_falls_in_slices(hot.hot(df), slice_rows))
    return out.where("_falls").select(*AGENT_KEYS, F.lit(FRAME_FALLS).alias("issue"))


def _speed_limit() -> Column:
    """Everything that is not a ball, also without a type, is held to the player limit."""
    return F.when(F.col("agent_type") == BALL, BALL_SPEED_LIMIT_MPS).otherwise(
        PLAYER_SPEED_LIMIT_MPS
    )


def impossible_speeds(moving: DataFrame) -> DataFrame:
    """Rows faster than the limit of their kind."""
    return moving.where(F.col("speed_mps") > _speed_limit()).select(
        "match_id", "frame_id", "agent_id", "speed_mps", _speed_limit().alias("threshold_mps")
    )


def missingness_by_agent(tracking: DataFrame) -> DataFrame:
    """Rows and missing positions per agent over all matches; a null agent is called ``nan``."""
    return tracking.groupBy(F.coalesce("agent_id", F.lit("nan")).alias("agent_id")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("x_m").isNull()).alias("missing_x_m"),
        F.count_if(F.col("y_m").isNull()).alias("missing_y_m"),
    )


@dataclass(frozen=True)
class QualityReport:
    """Each part is lazy and stays distributed; ``coordinate_bounds`` and ``summary`` have one row."""

    frame_monotonicity: DataFrame
    coordinate_bounds: DataFrame
    out_of_bounds: DataFrame
    impossible_speeds: DataFrame
    missingness_by_agent: DataFrame
    summary: DataFrame


def summarised(falls: DataFrame, fast: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row from the parts of a report: the number of issues of each kind, and ``ok``."""
    def count(df: DataFrame, part: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n", F.lit(True)
                                                      .alias("ok"))

    counts = (
        count(falls, "order")
        .unionByName(count(fast, "speed"))
        .unionByName(bounds.select(
            F.lit("bounds").alias("part"), F.col("out_of_bounds_rows").alias("n"), "ok"
        ))
    )

    def n(part: str) -> Column:
        return F.max(F.when(F.col("part") == part, F.col("n")))

    return counts.agg(
        n("order").alias("frame_issues"),
        n("speed").alias("speed_issues"),
        n("bounds").alias("out_of_bounds_rows"),
        F.min("ok").alias("bounds_readable"),
    ).select(
        (
            (F.col("frame_issues") == 0) & (F.col("speed_issues") == 0)
            & (F.col("out_of_bounds_rows") == 0) & F.col("bounds_readable")
        ).alias("ok"),
        "frame_issues", "speed_issues", "out_of_bounds_rows",
    )


def summarised_in_one_pass(moving: DataFrame) -> DataFrame:
    """The row of ``summarised`` from a table with speeds, scanned once: the order of frames is seen in
    the sort that the derivatives made, and each series is one row before all are added up."""
    per_series = moving.select(
        *AGENT_KEYS,
        _falls().alias("_falls"),
        (F.col("speed_mps") > _speed_limit()).alias("_fast"),
        off_pitch().alias("_off"),
    ).groupBy(*AGENT_KEYS).agg(
        F.coalesce(F.bool_or("_falls"), F.lit(False)).alias("_falls"),
        F.count_if("_fast").alias("_fast"), F.count_if("_off").alias("_off"),
    )
    issues = ["frame_issues", "speed_issues", "out_of_bounds_rows"]
    return per_series.agg(
        F.count_if("_falls").alias(issues[0]),
        F.coalesce(F.sum("_fast"), F.lit(0)).alias(issues[1]),
        F.coalesce(F.sum("_off"), F.lit(0)).alias(issues[2]),
    ).select((F.greatest(*issues) == 0).alias("ok"), *issues)


def check_quality(
    tracking: DataFrame, hot_rows: int | None = HOT_AGENT_ROWS
) -> QualityReport:
    """Report on frame order, pitch bounds, speeds and missing positions.

    An existing ``speed_mps`` column is used; otherwise speeds are computed. Missing positions do
    not count against ``ok``.
    """
    tracking = canonical_tracking(tracking)
    hot = HotKeys(tracking, AGENT_KEYS, hot_rows)
    moving = tracking if "speed_mps" in tracking.columns else add_kinematics(tracking, hot)
    falls = frame_monotonicity(tracking, hot)
    bounds = validate_pitch_bounds(tracking)
    fast = impossible_speeds(moving)

    summary = summarised(falls, fast, bounds) if hot.any else summarised_in_one_pass(moving)
    return QualityReport(
        falls, bounds, out_of_bounds_rows(tracking), fast, missingness_by_agent(tracking), summary
    )
