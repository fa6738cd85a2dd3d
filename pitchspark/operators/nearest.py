"""Nearest differently-labelled point for groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchspark.operators.skew import HEAVY_ROWS, HotKeys, attach, checkpointed

# Each level of the grid divides a cell into BRANCH x BRANCH.
BRANCH = 4
# The grid is refined until a cell holds about this many points of the largest group.
CELL_POINTS = 64
# Parts of equally many points that each axis is cut into; within a part, cells divide it evenly.
# Groups of few points have fewer parts, a power of two with about so many points each.
PARTS = 128
PART_POINTS = 4


def _share(axis: str) -> Column:
    """Where a value lies among its group's quantiles, from 0 to below 1, rising with the value."""
    value, bounds = F.col(axis), F.col(f"_bounds_{axis}")
    parts = F.size(bounds) - 1
    i = F.greatest(F.lit(1), F.least(parts, F.size(F.filter(bounds, lambda b: b <= value))))
    low, high = F.get(bounds, i - 1), F.get(bounds, i)
    within = F.nanvl(F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0)), F.lit(0.0))
    within = F.greatest(F.lit(0.0), F.least(F.lit(1.0), within))
    return F.least((i - 1 + within) / parts.cast("double"), F.lit(1.0 - 2.0**-40))


def _bounds(points: DataFrame) -> DataFrame:
    """The quantiles of each group on either axis."""
    at = F.lit([i / PARTS for i in range(PARTS + 1)])
    bounds = points.groupBy("grp").agg(F.count("*").alias("_n"), *[
        F.percentile_approx(axis, at, 10 * PARTS).alias(f"_bounds_{axis}") for axis in ("x", "y")
    ])
    halvings = F.greatest(F.lit(0.0), F.floor(F.log2(F.lit(float(PARTS * PART_POINTS)) / F.col("_n"))))
    step = F.least(F.pow(F.lit(2.0), halvings), F.lit(float(PARTS // BRANCH))).cast("int")
    return bounds.withColumn("_step", step).select("grp", *[
        F.filter(f"_bounds_{axis}", lambda b, i: i % F.col("_step") == 0).alias(f"_bounds_{axis}")
        for axis in ("x", "y")
    ])


def _placed(points: DataFrame, heavy: HotKeys) -> DataFrame:
    """Points with their place on either axis of the grid."""
    with_bounds = attach(points, _bounds(points), ["grp"], False, F.struct("x", "y"), "inner", heavy)
    return with_bounds.select(*points.columns, _share("x").alias("_ux"), _share("y").alias("_uy"))


def nearest_other(points: DataFrame) -> DataFrame:
    """For distinct points (grp, label, x, y), add ``distance`` to the nearest of another label.

    Points look only at others of their group. The search goes down a grid of cells shared by all
    points of a group. The grid follows the points, along quantiles of each axis, so that stray
    coordinates don't leave all others in one cell. At every level a point keeps the cells that can
    still hold its nearest neighbour: a cell is out when even its closest corner is further than
    the furthest corner of some other cell known to hold another label. No pair of points is formed
    above the last level, where the cells left hold few points.

    Sides of joins grow with the points, and Spark judges nested columns too small: none may be
    broadcast.
    """
    # Every level looks at the placed points. Only groups too large for a task are dealt out.
    heavy = HotKeys(points, ["grp"], HEAVY_ROWS)
    placed, columns = checkpointed(_placed(points, heavy)), points.columns
    points = placed.select(*columns)
    largest = points.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    depth = max(1, math.ceil(math.log(max(1, largest / CELL_POINTS), BRANCH**2)))

    def at_depth(depth: int) -> DataFrame:
        return placed.withColumns({
            c: F.floor(F.col(u) * F.lit(float(BRANCH**depth))).cast("bigint")
            for c, u in (("cx", "_ux"), ("cy", "_uy"))
        })

    here = Window.partitionBy("grp", "label", "x", "y")
    candidates = points.withColumns({
        "cx": F.lit(0).cast("bigint"), "cy": F.lit(0).cast("bigint")
    })
    for level in range(1, depth + 1):
        cells = at_depth(level).groupBy("grp", "cx", "cy").agg(
            F.min("label").alias("_low"), F.max("label").alias("_high"),
            F.min("x").alias("_left"), F.max("x").alias("_right"),
            F.min("y").alias("_top"), F.max("y").alias("_bottom"),
        ).select(
            "grp", F.floor(F.col("cx") / BRANCH).alias("_px"), F.floor(F.col("cy") / BRANCH).alias("_py"),
            F.struct(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"),
                     "_low", "_high", "_left", "_right", "_top", "_bottom").alias("_cell"),
        )
        # A cell's parts are few, and are one row, which is copied for the one cell that all
        # points of a group begin in.
        parts = cells.groupBy("grp", F.col("_px").alias("cx"), F.col("_py").alias("cy")).agg(
            F.collect_list("_cell").alias("_cells")
        )
        keys = ["grp", "cx", "cy"]
        if level == 1:
            candidates = attach(candidates, parts, keys, False, F.struct("x", "y"), "inner", heavy)
        else:
            candidates = candidates.join(parts.hint("merge"), keys)
        candidates = candidates.withColumn("_cell", F.explode("_cells")).select(
            "grp", "label", "x", "y", "_cell.*"
        )
        x, y = F.col("x"), F.col("y")
        near_x = F.greatest(F.col("_left") - x, x - F.col("_right"), F.lit(0.0))
        near_y = F.greatest(F.col("_top") - y, y - F.col("_bottom"), F.lit(0.0))
        far_x = F.greatest(F.abs(x - F.col("_left")), F.abs(x - F.col("_right")))
        far_y = F.greatest(F.abs(y - F.col("_top")), F.abs(y - F.col("_bottom")))
        candidates = (
            candidates.where((F.col("_low") != F.col("label")) | (F.col("_high") != F.col("label")))
            .withColumns({
                "_near": near_x * near_x + near_y * near_y,
                "_far": far_x * far_x + far_y * far_y,
            })
            .withColumn("_bound", F.min("_far").over(here))
            .where(F.col("_near") <= F.col("_bound"))
            .select("grp", "label", "x", "y", F.col("_cx").alias("cx"), F.col("_cy").alias("cy"))
        )
    last = at_depth(depth).select(
        "grp", "cx", "cy", F.col("label").alias("_label"), F.col("x").alias("_px"),
        F.col("y").alias("_py"),
    )
    found = (
        candidates.join(last.hint("merge"), ["grp", "cx", "cy"])
        .where(F.col("label") != F.col("_label"))
        .groupBy("grp", "label", "x", "y")
        .agg(F.min(F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py")))
             .alias("distance"))
    )
    return points.join(found.hint("merge"), ["grp", "label", "x", "y"], "left")
