"""Tracking as a stream: derivatives and order with bounded state, frame features by watermark.

A stream is a canonical tracking table with a timestamp column for the moment a frame was taken,
the same for all rows of the frame. Watermarks follow it, so matches with clocks of their own may be
mixed. A finished match that is streamed in pieces gives the rows that the batch operators give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitchspark.constants import AGENT_KEYS, FRAME_KEYS
from pitchspark.operators.frames import ball_of_frame, shape_of_team

DELAY = "5 seconds"
# Without a sample for so long, in event time, an agent's series is over and its last rows leave.
SERIES_GAP_S = 10.0
_VALUES = ["vx_mps", "vy_mps", "speed_mps", "ax_mps2", "ay_mps2", "accel_mps2"]
_OUT = (
    "match_id string, period int, agent_id string, frame_id long, time_s double, x_m double, y_m double, "
    + ", ".join(f"{c} double" for c in _VALUES) + ", frame_falls boolean, late boolean"
)
# Samples of which the first ``done`` were handed on; they are kept as neighbours of the next.
_STATE = "frames array<bigint>, times array<double>, xs array<double>, ys array<double>, done int, begun boolean"
# Second derivatives reach two samples to either side.
_REACH = 2


def gradient(times: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Second-order differences at increasing times along the last axis, one-sided at both ends; with
    equal steps the middle value isn't read, so it may be missing (NaN). One sample alone doesn't
    move."""
    n = len(times)
    if n < 2:
        return np.zeros(values.shape)
    out, step = np.empty(values.shape), np.diff(times)
    out[..., 0] = (values[..., 1] - values[..., 0]) / step[0]
    out[..., -1] = (values[..., -1] - values[..., -2]) / step[-1]
    hs, hd, (v0, v1, v2) = step[:-1], step[1:], (values[..., :-2], values[..., 1:-1], values[..., 2:])
    weighted = (
        -hd / (hs * (hs + hd)) * v0 + (hd - hs) / (hs * hd) * v1 + hs / (hd * (hs + hd)) * v2
    )
    out[..., 1:-1] = np.where(hs == hd, (v2 - v0) / (2 * hd), weighted)
    return out


def _repeated(value, n: int) -> np.ndarray:
    return np.full(n, value, dtype=np.int64 if isinstance(value, (int, np.integer)) else object)


def _numbers(frames: np.ndarray) -> np.ndarray | pd.api.extensions.ExtensionArray:
    """Frame numbers, of which negative ones are missing."""
    missing = frames < 0
    return pd.arrays.IntegerArray(frames, missing) if missing.any() else frames


def _series(gap_s: float, at: str):
    """Arrays throughout: a series has few rows in a batch, and a table's columns cost more than they."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.getOption if state.exists else ([], [], [], [], 0, True)
        frame = np.array(held[0], dtype=np.int64)
        t, x, y = (np.array(v, dtype=float) for v in held[1:4])
        done, begun = held[4], held[5]
        rest_frame, rest = np.zeros(0, dtype=np.int64), np.zeros((3, 0))
        over = state.hasTimedOut
        if not over:
            parts = list(frames)
            new = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            numbers = new["frame_id"]
            numbers = numbers.to_numpy() if numbers.dtype == np.int64 else numbers.to_numpy(float, na_value=np.nan)
            places = np.array([new[c].to_numpy(dtype=float) for c in ("time_s", "x_m", "y_m")])
            # As a sort by these columns, ties in the order they came in, what is missing last.
            order = np.lexsort((places[2], places[1], numbers, places[0]))
            numbers, places = numbers[order], places[:, order]
            if numbers.dtype != np.int64:
                numbers = np.where(np.isnan(numbers), -1, numbers).astype(np.int64)
            times = places[0]
            use = np.isfinite(times) & (times > (t[-1] if len(t) else -np.inf))
            use[1:] &= times[1:] != times[:-1]
            rest_frame, rest = numbers[~use], places[:, ~use]
            frame = np.concatenate([frame, numbers[use]])
            t, x, y = (np.concatenate(pair) for pair in zip((t, x, y), places[:, use]))
        ready = len(t) if over else max(done, len(t) - _REACH)
        velocity = gradient(t, np.array([x, y]))
        acceleration = gradient(t, velocity)
        values = np.array([*velocity, np.hypot(*velocity), *acceleration, np.hypot(*acceleration)])
        falls = np.zeros(len(t), dtype=bool)
        falls[1:] = (frame[1:] < frame[:-1]) & (frame[1:] >= 0) & (frame[:-1] >= 0)
        n, late = ready - done, len(rest_frame)
        if n + late:
            out = dict(zip(AGENT_KEYS, (_repeated(k, n + late) for k in key), strict=True))
            out["frame_id"] = _numbers(np.concatenate([frame[done:ready], rest_frame]))
            for name, own, other in zip(("time_s", "x_m", "y_m"), (t, x, y), rest, strict=True):
                out[name] = np.concatenate([own[done:ready], other])
            # Missing numbers are NaN here, and null in what Spark makes of it.
            none = np.full(late, np.nan)
            for name, own in zip(_VALUES, values, strict=True):
                out[name] = np.concatenate([own[done:ready], none])
            out["frame_falls"] = np.concatenate([falls[done:ready], np.zeros(late, dtype=bool)])
            out["late"] = np.arange(n + late) >= n
            table = pd.DataFrame(out)
        if over:
            state.remove()
        else:
            cut = max(0, ready - _REACH)
            state.update((frame[cut:].tolist(), t[cut:].tolist(), x[cut:].tolist(), y[cut:].tolist(),
                          ready - cut, begun and not cut))
            moment = int(new[at].max().timestamp() * 1000) + int(gap_s * 1000)
            state.setTimeoutTimestamp(max(moment, state.getCurrentWatermarkMs() + 1))
        if n + late:
            yield table

    return run


def stream_kinematics(
    tracking: DataFrame, at: str, delay: str = DELAY, gap_s: float = SERIES_GAP_S
) -> DataFrame:
    """Velocity, speed and acceleration of each row of a stream, and whether its frame number falls.

    A series is that of a match, period and agent. A row leaves when two more of its series are
    there, or when ``gap_s`` of event time went by without one. Four samples of a series are held.
    A row that isn't later than the last one of its series, or has no time, leaves at once as
    ``late``, without derivatives. Rows of unknown series (null keys) are series of their own.
    """
    rows = tracking.select(*AGENT_KEYS, "frame_id", "time_s", "x_m", "y_m", at).withWatermark(at, delay)
    return rows.groupBy(*AGENT_KEYS).applyInPandasWithState(
        _series(gap_s, at), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_team_shape(tracking: DataFrame, at: str, delay: str = DELAY) -> DataFrame:
    """Centroid, width and length of each team in each frame, once the watermark passed the frame;
    rows that come later are dropped and counted by ``groups_too_late``."""
    return shape_of_team(tracking.withWatermark(at, delay), [*FRAME_KEYS, at, "team_id"]).drop(at)


def stream_ball_distance(tracking: DataFrame, at: str, delay: str = DELAY) -> DataFrame:
    """Every row's distance from its frame's ball, once the watermark passed the frame. A frame's
    rows, some two dozen, are held until then."""
    columns = [c for c in tracking.columns if c not in (*FRAME_KEYS, at)]
    frames = tracking.withWatermark(at, delay).groupBy(*FRAME_KEYS, at).agg(
        ball_of_frame().alias("_ball"), F.collect_list(F.struct(*columns)).alias("_rows")
    )
    rows = frames.select(*FRAME_KEYS, at, "_ball", F.explode("_rows").alias("_row"))
    rows = rows.select(*FRAME_KEYS, at, "_ball", "_row.*")
    distance = F.hypot(F.col("x_m") - F.col("_ball.x_m"), F.col("y_m") - F.col("_ball.y_m"))
    return rows.select(*tracking.columns, F.nanvl(distance, F.lit(None)).alias("distance_to_ball_m"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what the source has now to Parquet files, in micro-batches; go on from ``checkpoint`` if
    it is there. Waits for the end."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def groups_too_late(query: StreamingQuery) -> int:
    """Groups of late rows that the watermark dropped, over the batches the query still remembers; the
    late rows of a frame are one group in each task that reads them."""
    return sum(
        op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]
    )
