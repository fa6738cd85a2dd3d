"""Velocity, speed and acceleration of each agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.constants import AGENT_KEYS
from pitchspark.functions.casts import is_finite
from pitchspark.operators.skew import HEAVY_ROWS, HOT_AGENT_ROWS, SLICE_ROWS, HotKeys, attach, sliced
from pitchspark.operators.timeseries import (
    collapsed,
    joined_on,
    neighbours,
    nulls_last,
    sort_struct,
    total_order,
)
from pitchspark.schema import canonical_tracking

KINEMATICS = ["vx_mps", "vy_mps", "speed_mps", "ax_mps2", "ay_mps2", "accel_mps2"]


def _gradient(before: str, here: str, after: str, name: str) -> str:
    """Second-order derivative of ``name`` at ``here``, one-sided where a neighbour is missing.

    With evenly spaced times the middle value is not read, so it may be missing. The points are
    struct columns with a time ``t``.
    """
    hs, hd = f"({here}.t - {before}.t)", f"({after}.t - {here}.t)"
    v0, v1, v2 = (f"{p}.{name}" for p in (before, here, after))
    return f"""CASE
        WHEN {before} IS NULL THEN try_divide({v2} - {v1}, {hd})
        WHEN {after} IS NULL THEN try_divide({v1} - {v0}, {hs})
        WHEN _even THEN try_divide({v2} - {v0}, 2D * {hd})
        ELSE try_divide(-{hd}, {hs} * ({hs} + {hd})) * {v0}
           + try_divide({hd} - {hs}, {hs} * {hd}) * {v1}
           + try_divide({hs}, {hd} * ({hs} + {hd})) * {v2} END"""


def _forward(before: str, here: str, after: str, name: str) -> str:
    """Slope to the next row, null unless time advances; the last row repeats the slope before it."""
    hs, hd = f"({here}.t - {before}.t)", f"({after}.t - {here}.t)"
    v0, v1, v2 = (f"{p}.{name}" for p in (before, here, after))
    return f"""CASE
        WHEN {after} IS NULL THEN CASE WHEN {hs} > 0 THEN try_divide({v1} - {v0}, {hs}) END
        WHEN {hd} > 0 THEN try_divide({v2} - {v1}, {hd}) END"""


def _by_flags(repeated: str, otherwise: str) -> str:
    """Zero in a flat series, else the derivative for its kind; never NaN."""
    return f"""nanvl(CASE WHEN _flat THEN 0D WHEN _repeats THEN {repeated} ELSE {otherwise} END,
        CAST(NULL AS DOUBLE))"""


def _with_magnitudes(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "speed_mps": F.hypot("vx_mps", "vy_mps"),
        "accel_mps2": F.hypot("ax_mps2", "ay_mps2"),
    })


# What a whole series says about each of its rows, given its number of rows, whether all times are
# finite, and its least and greatest time and step. flat: too few rows or times, or an unusable
# time, so every derivative is zero. repeats: some time occurs twice. even: all steps are equal.
FLAGS = {
    "_flat": "coalesce(_rows < 2 OR NOT _times_ok OR _low_t = _high_t, true)",
    "_repeats": "coalesce(_low_dt <= 0, false)",
    "_even": "coalesce(_low_dt = _high_dt, false)",
}


def _flags() -> dict[str, Column]:
    return {name: F.expr(text) for name, text in FLAGS.items()}


# How the derivative at a row is taken, by the series flags and the steps to its neighbours.
KIND = """CASE WHEN _flat THEN 'zero'
    WHEN _repeats AND _t2 IS NULL THEN CASE WHEN _hs > 0 THEN 'back' END
    WHEN _repeats THEN CASE WHEN _hd > 0 THEN 'ahead' END
    WHEN _t0 IS NULL THEN 'ahead'
    WHEN _t2 IS NULL THEN 'back'
    WHEN _even THEN 'even' ELSE 'weighted' END"""


def _derivative(before: str, here: str, after: str) -> str:
    return f"""nanvl(CASE _kind WHEN 'zero' THEN 0D
        WHEN 'even' THEN try_divide({after} - {before}, 2D * _hd)
        WHEN 'weighted' THEN _w0 * {before} + _w1 * {here} + _w2 * {after}
        WHEN 'ahead' THEN try_divide({after} - {here}, _hd)
        WHEN 'back' THEN try_divide({here} - {before}, _hs) END, CAST(NULL AS DOUBLE))"""


def _whole_series(df: DataFrame, order: list[str]) -> DataFrame:
    """One shuffle and one sort serve every window below.

    What depends on the times alone is worked out once for both axes and both derivatives. The
    steps are separate projections, which keeps the generated methods small enough to compile.
    """
    keys = ", ".join(AGENT_KEYS)
    quoted = ["`" + c.replace("`", "``") + "`" for c in order]
    by = ", ".join(f"{c} ASC NULLS LAST" for c in quoted)
    ordered = f"OVER (PARTITION BY {keys} ORDER BY {by})"
    series = f"OVER (PARTITION BY {keys})"

    def around(*columns: tuple[str, str]) -> list[str]:
        return [
            f"{function}({c}) {ordered} AS _{short}{i}"
            for c, short in columns for function, i in (("lag", 0), ("lead", 2))
        ]

    out = (
        df.repartition(*AGENT_KEYS)
        .selectExpr("*", *around(("time_s", "t"), ("x_m", "x"), ("y_m", "y")))
        .selectExpr("*", "time_s - _t0 AS _hs", "_t2 - time_s AS _hd")
        .selectExpr(
            "*",
            f"count(*) {series} AS _rows",
            f"min(coalesce(NOT isnan(time_s) AND abs(time_s) < double('inf'), false)) {series} "
            "AS _times_ok",
            f"min(time_s) {series} AS _low_t",
            f"max(time_s) {series} AS _high_t",
            f"min(_hd) {series} AS _low_dt",
            f"max(_hd) {series} AS _high_dt",
        )
        .withColumns(_flags())
        .selectExpr(
            "*",
            f"{KIND} AS _kind",
            "try_divide(-_hd, _hs * (_hs + _hd)) AS _w0",
            "try_divide(_hd - _hs, _hs * _hd) AS _w1",
            "try_divide(_hs, _hd * (_hs + _hd)) AS _w2",
        )
        .selectExpr(
            "*",
            f"{_derivative('_x0', 'x_m', '_x2')} AS vx_mps",
            f"{_derivative('_y0', 'y_m', '_y2')} AS vy_mps",
        )
        .selectExpr("*", *around(("vx_mps", "vx"), ("vy_mps", "vy")))
    )
    return out.selectExpr(
        *["`" + c.replace("`", "``") + "`" for c in df.columns], "vx_mps", "vy_mps",
        f"{_derivative('_vx0', 'vx_mps', '_vx2')} AS ax_mps2",
        f"{_derivative('_vy0', 'vy_mps', '_vy2')} AS ay_mps2",
    )


def _sliced_series(df: DataFrame, order: list[str], few: bool, slice_rows: int) -> DataFrame:
    """The same results for series too long for one task.

    Copies of a row are collapsed to one with a count before anything is ordered, then rows of
    equal time to their first and last, so that neither can fill a slice. Derivatives are taken
    between times, slice by slice, and joined back to the rows.
    """
    distinct = collapsed(df, order)
    place = sort_struct(order[1:])
    moments = distinct.groupBy(*AGENT_KEYS, "time_s").agg(
        F.sum("_copies").alias("_n"), F.min(place).alias("_first"), F.max(place).alias("_last")
    )
    moments = sliced(moments, nulls_last([*AGENT_KEYS, "time_s"]), slice_rows)
    moment = F.struct(
        F.col("time_s").alias("t"),
        F.col("_n").alias("n"),
        F.col("_first.x_m").alias("fx"),
        F.col("_first.y_m").alias("fy"),
        F.col("_last.x_m").alias("x"),
        F.col("_last.y_m").alias("y"),
    )
    around = neighbours(
        moments, AGENT_KEYS, nulls_last(["time_s"]), moment, depth=2, slice_col="_slice"
    )
    step = F.col("next1.t") - F.col("time_s")
    whole = around.groupBy(*AGENT_KEYS).agg(
        F.sum("_n").alias("_rows"),
        F.min(is_finite(F.col("time_s"))).alias("_times_ok"),
        F.min("time_s").alias("_low_t"),
        F.max("time_s").alias("_high_t"),
        F.least(F.min(step), F.min(F.when(F.col("_n") > 1, 0.0))).alias("_low_dt"),
        F.max(step).alias("_high_dt"),
    )
    whole = whole.withColumns(_flags()).select(*AGENT_KEYS, *FLAGS)
    heavy = None if few else HotKeys(moments, AGENT_KEYS, HEAVY_ROWS)
    around = attach(around, whole, AGENT_KEYS, few, F.col("_slice"), heavy=heavy)

    def last_row_velocity(before: str, here: str, after: str) -> Column:
        """Velocity of the last row at the moment ``here``.

        Where times repeat, that row looks ahead to the first row of the next moment. The last
        row of the series looks back, and has no slope when the row before it has the same time.
        """
        ahead = f"named_struct('t', {after}.t, 'x', {after}.fx, 'y', {after}.fy)"
        slope = {}
        for name in ("x", "y"):
            repeated = f"""CASE WHEN {after} IS NOT NULL THEN {_forward(before, here, ahead, name)}
                WHEN {here}.n = 1 THEN {_forward(before, here, after, name)} END"""
            slope[name] = _by_flags(repeated, _gradient(before, here, after, name))
        return F.expr(f"""CASE WHEN {here} IS NOT NULL THEN named_struct(
            't', {here}.t, 'n', {here}.n, 'x', {slope['x']}, 'y', {slope['y']}) END""")

    around = around.withColumns({
        "_v_before": last_row_velocity("prev2", "prev1", "here"),
        "_v": last_row_velocity("prev1", "here", "next1"),
        "_v_after": last_row_velocity("here", "next1", "next2"),
    })
    # Of several rows at one time only the last has a velocity.
    around = around.withColumn("_v_first_after", F.expr("""CASE WHEN _v_after IS NOT NULL THEN
        named_struct('t', _v_after.t, 'x', CASE WHEN _v_after.n = 1 THEN _v_after.x END,
                     'y', CASE WHEN _v_after.n = 1 THEN _v_after.y END) END"""))
    accel = {}
    for c in ("x", "y"):
        repeated = f"""CASE WHEN _v_after IS NOT NULL OR _v.n = 1
            THEN {_forward('_v_before', '_v', '_v_first_after', c)} END"""
        accel[c] = F.expr(_by_flags(repeated, _gradient("_v_before", "_v", "_v_after", c)))
    solved = around.select(
        *AGENT_KEYS, "time_s",
        F.col("_last").alias("_m_last"),
        F.col("_flat").alias("_m_flat"),
        F.col("_v.x").alias("_vx"), F.col("_v.y").alias("_vy"),
        accel["x"].alias("_ax"), accel["y"].alias("_ay"),
    )
    rows = joined_on(distinct, solved, [*AGENT_KEYS, "time_s"]).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    )
    has_value = F.col("_m_flat") | (
        (place == F.col("_m_last")) & (F.col("_copy") == F.col("_copies"))
    )
    return rows.select(
        *["`" + c.replace("`", "``") + "`" for c in df.columns],
        *[
            F.when(has_value, F.col(c)).alias(name)
            for name, c in [("vx_mps", "_vx"), ("vy_mps", "_vy"),
                            ("ax_mps2", "_ax"), ("ay_mps2", "_ay")]
        ],
    )


def add_kinematics(
    tracking: DataFrame,
    hot_rows: int | None | HotKeys = HOT_AGENT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add velocity, speed, acceleration and its magnitude per (match, period, agent).

    Series of fewer than two rows or times, or with a missing time, get zeros. A series with
    repeated times gets forward differences, all others central ones; of rows tied in all that
    orders a series the last one in the order of the other columns carries them. Series with more
    than ``hot_rows`` rows are split into slices of about ``slice_rows`` times; None skips the
    check.
    """
    df = canonical_tracking(tracking).drop(*KINEMATICS)
    names = df.columns
    hot = HotKeys.of(df, AGENT_KEYS, hot_rows)
    df, order = total_order(df)
    out = _whole_series(hot.cool(df), order)
    if hot.any:
        out = out.unionByName(_sliced_series(hot.hot(df), order, hot.few, slice_rows))
    return _with_magnitudes(out.drop(*[c for c in order if c not in names]))
