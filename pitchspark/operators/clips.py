"""Selections for showing a stretch of play: rows, frames, and the trail behind each agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchspark.constants import BALL
from pitchspark.operators.skew import HotKeys
from pitchspark.operators.timeseries import joined_on

# More points than this for one agent within two buckets of time are compared by time, not by row.
HOT_TRAIL_ROWS = 100_000
# Points in an array of an agent's trails.
SLICE_POINTS = 4096
TRAIL_KEYS = ["match_id", "agent_id", "bucket"]


def clip_rows(
    tracking: DataFrame, start_time_s: float, duration_s: float, period: int | None = None,
    require_rows: bool = False,
) -> DataFrame:
    """Rows with start <= time <= start + duration, of every period unless one is named."""
    rows = tracking.where(F.col("time_s").between(start_time_s, start_time_s + duration_s))
    if period is not None:
        rows = rows.where(F.col("period") == period)
    if require_rows and rows.isEmpty():
        raise ValueError("no tracking rows in the requested time range")
    return rows


def clip_frames(clip: DataFrame) -> DataFrame:
    """Distinct frames of a clip in playing order."""
    return clip.select("match_id", "period", "frame_id", "time_s").distinct().orderBy(
        "match_id", F.col("time_s").asc_nulls_last(), F.col("frame_id").asc_nulls_last(), "period"
    )


def _beside(points: DataFrame) -> DataFrame:
    """Times of the points just before and after each point of its agent."""
    along = Window.partitionBy(*TRAIL_KEYS).orderBy("point_time_s")
    return points.withColumns({
        "_before": F.lag("point_time_s").over(along),
        "_after": F.lead("point_time_s").over(along),
    })


def _beside_by_time(points: DataFrame) -> DataFrame:
    """The same where points repeat without end: repeats are counted before they are ordered."""
    times = points.groupBy(*TRAIL_KEYS, "point_time_s").agg((F.count("*") > 1).alias("_shared"))
    beside = _beside(times).withColumns({
        c: F.when(F.col("_shared"), F.col("point_time_s")).otherwise(F.col(c))
        for c in ("_before", "_after")
    })
    return joined_on(points, beside, [*TRAIL_KEYS, "point_time_s"]).drop("_shared")


def _frames_and_points(
    clip: DataFrame, trail_s: float, hot_rows: int | None
) -> tuple[DataFrame, DataFrame]:
    """Distinct frames with their bucket, and points under their own bucket and the next one, with the
    times of their agent's points beside them. A trail ends in its frame's bucket and begins there or
    in the one before."""
    width = 1.5 * trail_s if trail_s > 0 else 1.0
    bucket = F.floor(F.col("time_s") / F.lit(width))
    points = clip.where(F.col("agent_id").isNotNull() & (F.col("agent_id") != BALL)).select(
        "match_id", "agent_id",
        F.explode(F.array(bucket, bucket + 1)).alias("bucket"),
        F.col("frame_id").alias("point_frame_id"),
        F.col("time_s").alias("point_time_s"),
        "team_id", "x_m", "y_m",
    )
    hot = HotKeys(points, TRAIL_KEYS, hot_rows)
    beside = _beside(hot.cool(points))
    if hot.any:
        beside = beside.unionByName(_beside_by_time(hot.hot(points)))
    frames = clip.select(
        F.col("match_id").alias("_match"), "period", "frame_id", "time_s"
    ).distinct().withColumn("_bucket", bucket)
    return frames, beside


def _in_trail(point_time: Column, before: Column, after: Column, trail_s: float) -> Column:
    """Whether a point is in the trail up to ``time_s``, and isn't the only one."""
    oldest = F.col("time_s") - F.lit(float(trail_s))
    return (
        (point_time >= oldest) & (point_time <= F.col("time_s"))
        & ((before >= oldest) | (after <= F.col("time_s")))
    )


def agent_trails(
    clip: DataFrame, trail_s: float = 1.0, hot_rows: int | None = HOT_TRAIL_ROWS
) -> DataFrame:
    """One row per frame, agent and point of that agent in the ``trail_s`` seconds up to the frame.

    The agent called ``ball`` has no trail, nor has an agent with a single point. Periods are not
    told apart. Times are bucketed wider than a trail, so a frame finds its points under its own
    bucket or the one before, and an equi-join takes the place of a range join. A point is the
    only one of a trail when neither the point before it nor the one after it is within reach.
    """
    frames, beside = _frames_and_points(clip, trail_s, hot_rows)
    columns = [F.col(c) for c in ("point_time_s", "_before", "_after")]
    return frames.join(
        beside,
        F.col("_match").eqNullSafe(F.col("match_id"))
        & (F.col("_bucket") == F.col("bucket"))
        & _in_trail(*columns, trail_s),
    ).select(
        "match_id", "period", "frame_id", "time_s", "agent_id", "team_id",
        "point_frame_id", "point_time_s", "x_m", "y_m",
    )


def agent_trail_slices(
    clip: DataFrame, trail_s: float = 1.0, hot_rows: int | None = HOT_TRAIL_ROWS, most: int = SLICE_POINTS
) -> DataFrame:
    """The points of ``agent_trails`` as arrays, by time: one row per frame and agent, with ``trail``.

    An agent's points of two buckets are one sorted array, which is what is shuffled, and a trail is
    a stretch of it: rows and shuffle grow with the frames and points, not with their pairs. Arrays
    of more than about ``most`` points are cut by agent into parts, told by ``part``, and so are the
    trails that they hold.
    """
    frames, beside = _frames_and_points(clip, trail_s, hot_rows)
    sizes = beside.groupBy(*TRAIL_KEYS).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    point = F.struct("point_time_s", "point_frame_id", "team_id", "x_m", "y_m", "_before", "_after")
    cut = sizes.where("_parts > 1")
    if cut.isEmpty():
        parted = beside.withColumn("part", F.lit(0))
    else:
        spread = F.pmod(F.xxhash64("point_time_s", "point_frame_id", "x_m", "y_m"), F.coalesce("_parts", F.lit(1)))
        renamed = cut.toDF(*[f"_{k}" for k in TRAIL_KEYS], "_parts")
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in TRAIL_KEYS]
        parted = beside.join(renamed, on, "left").withColumn("part", spread.cast("int"))
    blocks = parted.groupBy(*TRAIL_KEYS, "part").agg(F.array_sort(F.collect_list(point)).alias("_points"))
    joined = frames.join(
        blocks, F.col("_match").eqNullSafe(F.col("match_id")) & (F.col("_bucket") == F.col("bucket"))
    )
    stretch = F.filter(
        "_points", lambda p: _in_trail(p["point_time_s"], p["_before"], p["_after"], trail_s)
    )
    return joined.select(
        "match_id", "period", "frame_id", "time_s", "agent_id", "part",
        F.transform(stretch, lambda p: p.dropFields("_before", "_after")).alias("trail"),
    ).where(F.size("trail") > 0)
