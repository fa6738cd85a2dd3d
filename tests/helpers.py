"""Small canonical tables and plain-Python results to compare with."""

import math

from pitchspark.schema import TRACKING_SCHEMA, canonical_tracking

DEFAULTS = {
    "match_id": "m", "dataset": "synthetic", "period": 1, "frame_id": 0, "time_s": 0.0,
    "agent_id": "a", "agent_type": "player", "team_id": "home", "player_id": None,
    "jersey_number": None, "role": None, "x_m": 0.0, "y_m": 0.0, "z_m": None, "raw_x": None,
    "raw_y": None, "is_visible": True, "source_file": "f",
}


def table(spark, rows):
    """Canonical tracking from partial row dicts."""
    filled = [tuple({**DEFAULTS, **r}[c] for c in TRACKING_SCHEMA.names) for r in rows]
    return canonical_tracking(spark.createDataFrame(filled, TRACKING_SCHEMA))


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def as_set(df, columns=None):
    """Rows as a sorted list with rounded numbers, so that copies count."""
    columns = columns or df.columns
    rows = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
