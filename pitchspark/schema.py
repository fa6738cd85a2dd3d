"""Canonical tables: their columns and types, coercion into them, and validation.

Every canonical DataFrame holds nulls and never NaN, so that ``avg``, ``max`` and comparisons
skip missing values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from pitchspark.constants import AGENT_TYPES
from pitchspark.functions.casts import coerce


def _schema(columns) -> StructType:
    return StructType([StructField(name, dtype) for name, dtype in columns])


# Names, order and types of the canonical columns.
TRACKING_SCHEMA = _schema([
    ("match_id", StringType()),
    ("dataset", StringType()),
    ("period", IntegerType()),
    ("frame_id", LongType()),
    ("time_s", DoubleType()),
    ("agent_id", StringType()),
    ("agent_type", StringType()),
    ("team_id", StringType()),
    ("player_id", StringType()),
    ("jersey_number", IntegerType()),
    ("role", StringType()),
    ("x_m", DoubleType()),
    ("y_m", DoubleType()),
    ("z_m", DoubleType()),
    ("raw_x", DoubleType()),
    ("raw_y", DoubleType()),
    ("is_visible", BooleanType()),
    ("source_file", StringType()),
])

EVENT_SCHEMA = _schema([
    ("match_id", StringType()),
    ("dataset", StringType()),
    ("period", IntegerType()),
    ("time_s", DoubleType()),
    ("frame_id", LongType()),
    ("team_id", StringType()),
    ("player_id", StringType()),
    ("event_type", StringType()),
    ("event_subtype", StringType()),
    ("x_m", DoubleType()),
    ("y_m", DoubleType()),
    ("end_x_m", DoubleType()),
    ("end_y_m", DoubleType()),
    ("outcome", StringType()),
    ("raw_event", StringType()),
])

# The feature columns, in the order they follow the tracking columns.
FEATURE_VALUES = [
    "vx_mps",
    "vy_mps",
    "speed_mps",
    "ax_mps2",
    "ay_mps2",
    "accel_mps2",
    "distance_to_ball_m",
    "nearest_teammate_distance_m",
    "nearest_opponent_distance_m",
    "team_centroid_x_m",
    "team_centroid_y_m",
    "team_width_m",
    "team_length_m",
]

TRACKING_COLUMNS = TRACKING_SCHEMA.names
EVENT_COLUMNS = EVENT_SCHEMA.names
FEATURE_SCHEMA = StructType(
    TRACKING_SCHEMA.fields + [StructField(name, DoubleType()) for name in FEATURE_VALUES]
)


def ensure_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """Put the schema's columns first, adding the missing ones as typed nulls; keep the extras."""
    known = [
        F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    return df.select(*known, *[c for c in df.columns if c not in schema.names])


def order_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Put the known columns that exist first and keep the extras after them."""
    known = [c for c in columns if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known])


def canonical(df: DataFrame, schema: StructType, clean: frozenset[str] = frozenset()) -> DataFrame:
    """Cast to a schema; unreadable numbers and NaN become null, missing columns are added as nulls,
    and extras are kept. Columns named in ``clean`` are doubles known to hold no NaN; they stay as
    they are, so that filters on them reach the scan."""
    types = dict(df.dtypes)
    columns = []
    for field in schema:
        target = field.dataType.simpleString()
        source = types.get(field.name)
        if field.name in clean:
            columns.append(field.name)
            continue
        value = coerce(field.name, source, target) if source else f"CAST(NULL AS {target})"
        columns.append(f"{value} AS {field.name}")
    for name in df.columns:
        if name not in schema.names:
            quoted = "`" + name.replace("`", "``") + "`"
            value = coerce(name, "double", "double") if types[name] == "double" else quoted
            columns.append(f"{value} AS {quoted}")
    return df.selectExpr(*columns)


def canonical_tracking(df: DataFrame) -> DataFrame:
    """Cast to the tracking schema; unreadable numbers and NaN become null, extras are kept."""
    return canonical(df, TRACKING_SCHEMA)


def canonical_events(df: DataFrame) -> DataFrame:
    """Cast to the event schema; unreadable numbers and NaN become null, extras are kept."""
    return canonical(df, EVENT_SCHEMA)


@dataclass(frozen=True)
class SchemaValidation:
    """``invalid_agent_types`` has one row per distinct bad value; ``summary`` has one row."""

    missing_columns: list[str]
    invalid_agent_types: DataFrame
    summary: DataFrame


def validate_tracking_schema(df: DataFrame) -> SchemaValidation:
    """Report missing canonical columns and agent types outside the domain.

    The bad values stay a distributed table, since a corrupt column may hold any number of them.
    """
    missing = [c for c in TRACKING_COLUMNS if c not in df.columns]
    if "agent_type" in df.columns:
        invalid = (
            df.select(F.col("agent_type").cast("string").alias("agent_type"))
            .where(~F.col("agent_type").isin(*AGENT_TYPES))
            .distinct()
        )
    else:
        invalid = df.sparkSession.createDataFrame([], "agent_type string")
    summary = invalid.agg(F.count("*").alias("invalid_agent_types")).select(
        ((F.col("invalid_agent_types") == 0) & F.lit(not missing)).alias("ok"),
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"),
        "invalid_agent_types",
    )
    return SchemaValidation(missing, invalid, summary)
