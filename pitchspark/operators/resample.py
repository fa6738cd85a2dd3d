"""Resampling of each agent's series to a fixed frame rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchspark.constants import AGENT_KEYS
from pitchspark.functions.casts import half_even, is_finite
from pitchspark.operators.skew import HEAVY_ROWS, HOT_AGENT_ROWS, SLICE_ROWS, HotKeys, attach, sliced
from pitchspark.operators.timeseries import collapsed, joined_on, nulls_last, total_order
from pitchspark.schema import canonical_tracking

# The columns that are interpolated; all others are carried forward, then back.
INTERPOLATED = ["x_m", "y_m", "z_m", "raw_x", "raw_y"]
# Grid points are generated in runs of at most this many.
RUN = 4096


def _grid_time(k: Column, fps: float) -> Column:
    """Time of grid point k of a series, to ten decimals with halves to even."""
    step = F.col("_start") + F.lit(1.0 / fps) - F.col("_start")
    return F.rint((F.col("_start") + k.cast("double") * step) * 1e10) / 1e10


def _grid_columns(fps: float) -> dict[str, Column]:
    """Number of grid points of a series, and which of them a row falls on exactly, if any."""
    dt = 1.0 / fps
    k = F.rint((F.col("time_s") - F.col("_start")) / F.lit(dt)).cast("bigint")
    points = F.ceil((F.col("_end") + F.lit(dt / 2) - F.col("_start")) / F.lit(dt))
    return {
        "_points": points.cast("bigint"),
        "_k": F.when((k < points) & (_grid_time(k, fps) == F.col("time_s")), k),
    }


def _carried(df_columns: list[str]) -> list[str]:
    return [c for c in df_columns if c not in [*AGENT_KEYS, "time_s", "frame_id", *INTERPOLATED]]


def _filled(
    samples: DataFrame, part: list[str], carried: list[str], order: list[str]
) -> DataFrame:
    """For each sample: its row position, the next sample's grid point, and the values around it.

    ``_p_<c>`` and ``_n_<c>`` hold position and value of the last present value up to this row
    and of the first one after it; ``_f_<c>`` and ``_b_<c>`` hold just the value. A row position
    counts every output row, so copies at one time take a position each.
    """
    keys = ", ".join(part)
    quoted = ["`" + c.replace("`", "``") + "`" for c in order]
    ascending = ", ".join(f"{c} ASC NULLS LAST" for c in quoted)
    descending = ", ".join(f"{c} DESC NULLS FIRST" for c in quoted)
    ordered = f"OVER (PARTITION BY {keys} ORDER BY {ascending})"
    so_far = ordered[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    earlier = ordered[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    # Looking ahead as a running value in reverse order: linear, unlike a shrinking frame.
    later = f"""OVER (PARTITION BY {keys} ORDER BY {descending}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    out = samples.selectExpr(
        "*",
        f"CAST(coalesce(lag(_k) {ordered} <> _k, true) AS int) AS _new",
        f"lag(_k) {ordered} IS NULL AS _first",
        f"lead(_k) {ordered} AS _next_k",
        f"coalesce(sum(_copies) {earlier}, 0L) AS _rows_before",
    ).selectExpr("*", f"_k + _rows_before - sum(_new) {so_far} + 1 AS _pos")

    def seen(c: str, pos: str) -> str:
        return f"CASE WHEN {c} IS NOT NULL THEN named_struct('pos', {pos}, 'value', {c}) END"

    return out.selectExpr(
        "*",
        *[f"last({seen(c, '_pos + _copies - 1')}, true) {so_far} AS _p_{c}" for c in INTERPOLATED],
        *[f"last(`{c}`, true) {so_far} AS `_f_{c}`" for c in carried],
    ).selectExpr(
        "*",
        *[f"last({seen(c, '_pos')}, true) {later} AS _n_{c}" for c in INTERPOLATED],
        *[f"last(`{c}`, true) {later} AS `_b_{c}`" for c in carried],
    )


def _filled_in_slices(
    samples: DataFrame, carried: list[str], order: list[str], slice_rows: int
) -> DataFrame:
    """As ``_filled``, with series cut into slices of samples and joined up afterwards.

    What a slice needs from the others is a handful of values: how many rows come before it, and
    the present values nearest to its two ends. These come from one summary row per slice.
    """
    samples = sliced(samples, nulls_last([*AGENT_KEYS, *order]), slice_rows)
    out = _filled(samples, [*AGENT_KEYS, "_slice"], carried, order)
    named = {"_p_": INTERPOLATED, "_f_": carried}
    ahead = {"_n_": INTERPOLATED, "_b_": carried}

    def at_end(name: str) -> Column:
        return F.first(F.when(F.col("_next_k").isNull(), F.col(name)), True)

    def at_start(c: str, name: str) -> Column:
        own = F.col(c)
        if name.startswith("_n_"):
            own = F.when(own.isNotNull(), F.struct(F.col("_pos").alias("pos"),
                                                   own.alias("value")))
        return F.first(F.when(F.col("_first"), F.coalesce(own, F.col(name))), True)

    ends = out.groupBy(*AGENT_KEYS, "_slice").agg(
        (F.sum("_copies") - F.sum("_new")).alias("_extra"),
        F.min("_k").alias("_first_k"),
        F.max("_k").alias("_last_k"),
        *[at_end(p + c).alias(p + c) for p, cs in named.items() for c in cs],
        *[at_start(c, p + c).alias(p + c) for p, cs in ahead.items() for c in cs],
    )
    onward = Window.partitionBy(*AGENT_KEYS).orderBy("_slice")
    before = onward.rowsBetween(Window.unboundedPreceding, -1)
    after = (
        Window.partitionBy(*AGENT_KEYS).orderBy(F.desc("_slice"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # A slice may begin at the grid point where the one before it ends: then that point isn't new.
    again = F.coalesce(F.lag("_last_k").over(onward) == F.col("_first_k"), F.lit(False)).cast("int")
    ends = ends.withColumn("_again", again).withColumn(
        "_shift",
        F.coalesce(F.sum(F.col("_extra") + F.col("_again")).over(before), F.lit(0)) + F.col("_again"),
    )

    def shifted(c: Column) -> Column:
        return F.when(c.isNotNull(), F.struct((c["pos"] + F.col("_shift")).alias("pos"),
                                              c["value"].alias("value")))

    ends = ends.withColumns({
        p + c: shifted(F.col(p + c)) for p in ("_p_", "_n_") for c in INTERPOLATED
    })
    ends = ends.select(
        *AGENT_KEYS, "_slice", "_shift",
        F.lead("_first_k").over(onward).alias("_e_next_k"),
        F.lag("_first_k").over(onward).isNull().alias("_e_first"),
        *[F.last(p + c, True).over(before).alias(f"_e{p}{c}") for p, cs in named.items()
          for c in cs],
        *[F.last(p + c, True).over(after).alias(f"_e{p}{c}") for p, cs in ahead.items()
          for c in cs],
    )
    joined = joined_on(out, ends, [*AGENT_KEYS, "_slice"])
    return joined.withColumns(
        {
            "_pos": F.col("_pos") + F.col("_shift"),
            "_next_k": F.coalesce("_next_k", "_e_next_k"),
            "_first": F.col("_first") & F.col("_e_first"),
        }
        | {
            p + c: F.coalesce(shifted(F.col(p + c)), F.col(f"_e{p}{c}"))
            for p in ("_p_", "_n_") for c in INTERPOLATED
        }
        | {p + c: F.coalesce(p + c, f"_e{p}{c}") for p in ("_f_", "_b_") for c in carried}
    )


def _on_grid(
    filled: DataFrame, columns: list[str], fps: float, limit: int, spread: bool = False
) -> DataFrame:
    """Emit each sample, the empty grid points after it, and those before a series' first.

    With ``spread``, long gaps are dealt out to tasks in runs of grid points before they are
    filled.
    """
    carried = _carried(columns)
    first_k = F.when(F.col("_first"), F.lit(0).cast("bigint")).otherwise(F.col("_k"))
    last_k = F.when(
        F.col("_next_k").isNotNull(), F.greatest(F.col("_next_k") - 1, F.col("_k"))
    ).otherwise(F.col("_points") - 1)
    runs = filled.withColumns({"_from": first_k, "_to": last_k}).withColumn(
        "_run", F.explode(F.sequence("_from", "_to", F.lit(RUN).cast("bigint")))
    )
    if spread:
        runs = runs.repartition(*AGENT_KEYS, "_run")
    points = runs.withColumn(
        "_at", F.explode(F.sequence("_run", F.least(F.col("_to"), F.col("_run") + (RUN - 1))))
    )
    own = F.col("_at") == F.col("_k")
    points = points.withColumn(
        "_copy",
        F.explode(F.sequence(F.lit(0).cast("bigint"),
                             F.when(own, F.col("_copies") - 1).otherwise(F.lit(0)))),
    ).withColumn(
        "_pos",
        F.when(own, F.col("_pos") + F.col("_copy"))
        .otherwise(F.col("_pos") + F.col("_copies") - 1 + F.col("_at") - F.col("_k")),
    )

    def interpolated(c: str) -> str:
        p, n = f"_p_{c}", f"_n_{c}"
        slope = f"try_divide({n}.value - {p}.value, CAST({n}.pos - {p}.pos AS double))"
        return f"""CASE WHEN _at = _k AND {c} IS NOT NULL THEN {c}
            WHEN _at >= _k AND _pos - {p}.pos <= {limit}
            THEN {slope} * CAST(_pos - {p}.pos AS double) + {p}.value END AS {c}"""

    time_s = _grid_time(F.col("_at"), fps)
    values = {c: interpolated(c) for c in INTERPOLATED}
    # A sample in front of the grid gives its keys only.
    values |= {c: f"CASE WHEN _k >= 0 THEN coalesce(`_f_{c}`, `_b_{c}`) END AS `{c}`"
               for c in carried}
    values |= {"time_s": "_grid_t AS time_s",
               "frame_id": f"CAST(rint(_grid_t * {float(fps)}D) AS bigint) AS frame_id"}
    return points.withColumn("_grid_t", time_s).selectExpr(
        *[values.get(c, c) for c in columns],
        *[f"NOT (_at = _k AND {c} IS NOT NULL) AS {c}_was_missing" for c in INTERPOLATED],
    )


def _whole(df: DataFrame, names: list[str], order: list[str], fps: float, limit: int) -> DataFrame:
    """One shuffle: windows over whole series, then the grid is generated from the samples."""
    series = Window.partitionBy(*AGENT_KEYS)
    ordered = series.orderBy(*nulls_last(order))
    rows = df.repartition(*AGENT_KEYS).withColumn("_rank", F.row_number().over(ordered))
    rows = rows.withColumns({
        "_start": F.min("time_s").over(series), "_end": F.max("time_s").over(series)
    }).withColumns(_grid_columns(fps))
    rows = rows.withColumn("_any", F.max(F.col("_k").isNotNull()).over(series))
    # A series that never meets its grid is kept as one sample in front of the grid.
    rows = rows.where(F.col("_k").isNotNull() | (~F.col("_any") & (F.col("_rank") == 1)))
    rows = rows.withColumns({
        "_k": F.coalesce("_k", F.lit(-1).cast("bigint")), "_copies": F.lit(1).cast("bigint")
    })
    return _on_grid(_filled(rows, AGENT_KEYS, _carried(names), order), names, fps, limit)


def _sliced(
    df: DataFrame, names: list[str], order: list[str], fps: float, limit: int, few: bool,
    slice_rows: int,
) -> DataFrame:
    spread = F.struct("time_s", "frame_id")
    extent = df.groupBy(*AGENT_KEYS).agg(
        F.min("time_s").alias("_start"), F.max("time_s").alias("_end")
    )
    heavy = None if few else HotKeys(df, AGENT_KEYS, HEAVY_ROWS)
    rows = attach(df, extent, AGENT_KEYS, few, spread, heavy=heavy).withColumns(_grid_columns(fps))
    # What the grid adds is the same in all copies of a row.
    samples = collapsed(rows.where(F.col("_k").isNotNull()), order)
    carried = _carried(names)
    on_grid = _on_grid(
        _filled_in_slices(samples, carried, order, slice_rows), names, fps, limit, spread=True
    )
    types = dict(df.dtypes)
    unmet = rows.groupBy(*AGENT_KEYS, "_start", "_points").agg(
        F.max("_k").alias("_met")
    ).where(F.col("_met").isNull())
    nothing = {c: F.lit(None).cast(types[c]) for c in names if c not in AGENT_KEYS}
    empty = {f"{p}{c}": F.lit(None).cast("struct<pos:bigint,value:double>")
             for p in ("_p_", "_n_") for c in INTERPOLATED}
    empty |= {f"{p}{c}": nothing[c] for p in ("_f_", "_b_") for c in carried}
    empty |= nothing | {
        "_k": F.lit(-1).cast("bigint"), "_copies": F.lit(1).cast("bigint"),
        "_pos": F.lit(-1).cast("bigint"), "_next_k": F.lit(None).cast("bigint"),
        "_first": F.lit(True),
    }
    return on_grid.unionByName(
        _on_grid(unmet.withColumns(empty), names, fps, limit, spread=True)
    )


def resample_tracking(
    tracking: DataFrame,
    target_fps: float = 10.0,
    max_gap_s: float = 0.5,
    hot_rows: int | None = HOT_AGENT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Put each (match, period, agent) series on a regular grid from its first to its last time.

    Samples whose time is not a grid time are left out. Positions are interpolated over the first
    ``max_gap_s`` of each gap, with a ``<column>_was_missing`` flag; other columns take the value
    before, or else the one after. Series with more than ``hot_rows`` rows or grid points are
    resampled in slices of about ``slice_rows`` samples.
    """
    if target_fps <= 0:
        raise ValueError("target_fps must be positive")
    limit = half_even(max_gap_s * target_fps)
    if limit < 1:
        raise ValueError("max_gap_s must cover at least one frame")
    df = canonical_tracking(tracking).drop(*[f"{c}_was_missing" for c in INTERPOLATED])
    df = df.where(is_finite(F.col("time_s")))
    # A stray time makes a grid far longer than the series has rows.
    span = (F.max("time_s") - F.min("time_s")) * F.lit(float(target_fps))
    hot = HotKeys(df, AGENT_KEYS, hot_rows, F.greatest(F.count("*").cast("double"), span))
    names = df.columns
    df, order = total_order(df)
    out = _whole(hot.cool(df), names, order, target_fps, limit)
    if hot.any:
        out = out.unionByName(
            _sliced(hot.hot(df), names, order, target_fps, limit, hot.few, slice_rows)
        )
    return out


def time_extents(tracking: DataFrame) -> DataFrame:
    """First and last time of each (match, period, agent)."""
    return tracking.groupBy(*AGENT_KEYS).agg(
        F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s")
    )
