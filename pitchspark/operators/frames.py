"""Features of a row within its frame: ball distance, team shape, nearest players."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchspark.constants import BALL, FRAME_KEYS, PLAYER
from pitchspark.functions.casts import is_finite, no_nan
from pitchspark.operators.nearest import nearest_other
from pitchspark.operators.skew import HEAVY_ROWS, HOT_FRAME_ROWS, HotKeys, attach
from pitchspark.operators.timeseries import sort_struct

BALL_DISTANCE = ["distance_to_ball_m"]
NEAREST = ["nearest_teammate_distance_m", "nearest_opponent_distance_m"]
TEAM_SHAPE = ["team_centroid_x_m", "team_centroid_y_m", "team_width_m", "team_length_m"]


def _is_player() -> Column:
    return F.coalesce(F.col("agent_type") == PLAYER, F.lit(False))


def _has_place() -> Column:
    """Players that can be near someone."""
    return _is_player() & is_finite(F.col("x_m")) & is_finite(F.col("y_m"))


def ball_of_frame() -> Column:
    """The frame's first ball row, lowest agent_id and time; it counts even without coordinates."""
    ball = F.when(F.col("agent_type") == BALL, sort_struct(["agent_id", "time_s", "x_m", "y_m"]))
    return F.min(ball)


def _ball_distance() -> Column:
    return no_nan(F.hypot(F.col("x_m") - F.col("_ball.x_m"), F.col("y_m") - F.col("_ball.y_m")))


def _shape(over: Callable[[Column], Column] = lambda c: c) -> dict[str, Column]:
    """Centroid, width and length of a team's players; ``over`` turns aggregates into windows."""
    x, y = F.when(_is_player(), F.col("x_m")), F.when(_is_player(), F.col("y_m"))
    return {
        "team_centroid_x_m": no_nan(over(F.avg(x))),
        "team_centroid_y_m": no_nan(over(F.avg(y))),
        "team_width_m": no_nan(over(F.max(y)) - over(F.min(y))),
        "team_length_m": no_nan(over(F.max(x)) - over(F.min(x))),
    }


# Squared distance from this row to a listed place.
SQUARED = "(px, py) -> (px - x_m) * (px - x_m) + (py - y_m) * (py - y_m)"
# The row itself is among its team's places, at distance zero, so the second smallest is wanted.
NEAREST_MATE = f"get(sort_array(zip_with(_xs, _ys, {SQUARED})), 1)"
NEAREST_OPPONENT = f"""array_min(transform(
    filter(_teams, t -> NOT (t.team_id <=> team_id)),
    t -> array_min(zip_with(t._xs, t._ys, {SQUARED}))))"""


def _by_window(df: DataFrame, added: list[str]) -> DataFrame:
    """One shuffle by frame serves the windows over frames and over the teams within them.

    The places of a team's players are listed per team, and the teams per frame, so that no list
    element has to be tested for its team.
    """
    frame = Window.partitionBy(*FRAME_KEYS)
    team = Window.partitionBy(*FRAME_KEYS, "team_id")
    by_team, by_frame, computed = {}, {}, {}
    if TEAM_SHAPE[0] in added:
        by_team |= _shape(lambda c: c.over(team))
    if NEAREST[0] in added:
        for listed, name in (("_xs", "x_m"), ("_ys", "y_m")):
            by_team[listed] = F.collect_list(F.when(_has_place(), F.col(name))).over(team)
        lists = F.when(_has_place(), F.struct("team_id", "_xs", "_ys"))
        by_frame["_teams"] = F.collect_set(lists).over(frame)
        for name, squared in zip(NEAREST, (NEAREST_MATE, NEAREST_OPPONENT)):
            computed[name] = F.when(_has_place(), F.sqrt(F.expr(squared)))
    if BALL_DISTANCE[0] in added:
        by_frame["_ball"] = ball_of_frame().over(frame)
        computed["distance_to_ball_m"] = _ball_distance()
    out = df.repartition(*FRAME_KEYS)
    # Teams first: their sort also serves the windows over whole frames.
    for columns in (by_team, by_frame, computed):
        out = out.withColumns(columns) if columns else out
    return out.select(*df.columns, *added)


def _nearest_places(df: DataFrame) -> DataFrame:
    """Nearest distances for each distinct (frame, team, place) of players."""
    places = df.where(_has_place()).groupBy(*FRAME_KEYS, "team_id", "x_m", "y_m").agg(
        (F.count("*") > 1).alias("shared")
    )
    at = [F.col("x_m").alias("x"), F.col("y_m").alias("y")]
    mates = nearest_other(places.select(
        F.struct(*FRAME_KEYS, "team_id").alias("grp"), F.struct("x_m", "y_m").alias("label"), *at
    )).select(
        F.col("grp").alias("team_grp"), F.col("x").alias("x_m"), F.col("y").alias("y_m"),
        F.col("distance").alias("mate"),
    )
    others = nearest_other(places.select(
        F.struct(*FRAME_KEYS).alias("grp"), F.struct("team_id").alias("label"), *at
    )).select(
        F.struct("grp.*", "label.team_id").alias("team_grp"),
        F.col("x").alias("x_m"), F.col("y").alias("y_m"), F.col("distance").alias("opponent"),
    )
    return (
        places.withColumn("team_grp", F.struct(*FRAME_KEYS, "team_id"))
        .join(mates.hint("merge"), ["team_grp", "x_m", "y_m"])
        .join(others.hint("merge"), ["team_grp", "x_m", "y_m"])
        .select(
            F.col("team_grp").alias("_team"), F.col("x_m").alias("_x"), F.col("y_m").alias("_y"),
            F.when(F.col("shared"), 0.0).otherwise(F.col("mate")).alias(NEAREST[0]),
            F.col("opponent").alias(NEAREST[1]),
        )
    )


def _by_parts(df: DataFrame, added: list[str], few: bool) -> DataFrame:
    """The same results for frames too large for one task: aggregate, then join back."""
    out = df
    spread = F.struct("agent_id", "time_s", "x_m", "y_m")
    looked_up = BALL_DISTANCE[0] in added or TEAM_SHAPE[0] in added
    heavy = None if few or not looked_up else HotKeys(df, FRAME_KEYS, HEAVY_ROWS)
    if BALL_DISTANCE[0] in added:
        ball = df.groupBy(*FRAME_KEYS).agg(ball_of_frame().alias("_ball"))
        out = attach(out, ball, FRAME_KEYS, few, spread, heavy=heavy).withColumn(
            "distance_to_ball_m", _ball_distance()
        )
    if TEAM_SHAPE[0] in added:
        keys = [*FRAME_KEYS, "team_id"]
        shape = df.groupBy(*keys).agg(*[c.alias(name) for name, c in _shape().items()])
        out = attach(out, shape, keys, False, spread, heavy=heavy)
    if NEAREST[0] in added:
        out = out.join(
            _nearest_places(df).hint("merge"),
            (F.struct(*FRAME_KEYS, "team_id") == F.col("_team"))
            & (F.col("x_m") == F.col("_x"))
            & (F.col("y_m") == F.col("_y"))
            & _is_player(),
            "left",
        )
    return out.select(*df.columns, *added)


def add_frame_features(
    df: DataFrame,
    added: list[str],
    hot_rows: int | None = HOT_FRAME_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add the given frame features.

    Frames with more than ``hot_rows`` rows take a plan that never gathers a frame; None skips the
    check. ``counted`` is a cheaper table with the same frame keys to count rows on.
    """
    df = df.drop(*added)
    hot = HotKeys(df if counted is None else counted, FRAME_KEYS, hot_rows)
    out = _by_window(hot.cool(df), added)
    if hot.any:
        out = out.unionByName(_by_parts(hot.hot(df), added, hot.few))
    return out


def add_distance_to_ball(df: DataFrame, hot_rows: int | None = HOT_FRAME_ROWS) -> DataFrame:
    """Add the distance from every row to its frame's first ball row."""
    return add_frame_features(df, BALL_DISTANCE, hot_rows)


def add_team_shape(df: DataFrame, hot_rows: int | None = HOT_FRAME_ROWS) -> DataFrame:
    """Add nearest team-mate and opponent to player rows, and team shape to every row of a team."""
    return add_frame_features(df, NEAREST + TEAM_SHAPE, hot_rows)


def team_shape(df: DataFrame) -> DataFrame:
    """One row per (frame, team): centroid, width and length over its players."""
    return shape_of_team(df, [*FRAME_KEYS, "team_id"])


def shape_of_team(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per value of the keys, which tell a frame and a team."""
    return df.where(_is_player()).groupBy(*keys).agg(
        *[c.alias(name) for name, c in _shape().items()]
    )
