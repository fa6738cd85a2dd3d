"""Order and neighbours within one agent's time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchspark.constants import AGENT_KEYS

# Order of a series; ties are settled by ``total_order``.
SERIES_ORDER = ["time_s", "frame_id", "x_m", "y_m", "source_file"]


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def total_order(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table, and the columns that order a series so that only copies of a row are equal.

    Extra columns without an order of their own, such as maps, are ordered by their JSON text, in
    columns added for it.
    """
    order = list(SERIES_ORDER)
    for f in df.schema.fields:
        if f.name in AGENT_KEYS or f.name in SERIES_ORDER:
            continue
        if _sortable(f.dataType):
            order.append(f.name)
        else:
            quoted = F.col("`" + f.name.replace("`", "``") + "`")
            df = df.withColumn(f"_tie{len(order)}", F.to_json(F.struct(quoted)))
            order.append(f"_tie{len(order)}")
    return df, order


def collapsed(df: DataFrame, order: list[str]) -> DataFrame:
    """Copies of a row as one row with their number, ``_copies``; ``order`` is that of
    ``total_order``, and other columns are the same in all copies."""
    keys = [*AGENT_KEYS, *order]
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in df.columns}
    rest = [F.any_value(quoted[c]).alias(c) for c in df.columns if c not in keys]
    return df.groupBy(*[quoted[k] for k in keys]).agg(F.count("*").alias("_copies"), *rest)


def nulls_last(names: list[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`").asc_nulls_last() for c in names]


def sort_struct(names: list[str]) -> Column:
    """A struct whose minimum and maximum follow ascending order with nulls last."""
    fields = []
    for c in names:
        quoted = F.col("`" + c.replace("`", "``") + "`")
        fields += [quoted.isNull().alias(f"{c}_null"), quoted]
    return F.struct(*fields)


def joined_on(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on null-safe equality, keeping one set of the keys."""
    named = side.select(
        *[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in side.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return df.join(named, condition).drop(*[f"_on_{k}" for k in keys])


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    payload: Column,
    depth: int,
    slice_col: str | None = None,
) -> DataFrame:
    """Add ``here``, the payload, and ``prev1..`` and ``next1..``, that of the rows around it.

    Rows beyond an end of the series are null.

    With ``slice_col``, an ordered slice number, each slice is a group of its own. The rows just
    outside a slice are found from the first and last rows of all slices, a table smaller than the
    data by the slice length, so that no task sees a whole series.
    """
    depths = range(1, depth + 1)
    w = Window.partitionBy(*keys, *([slice_col] if slice_col else [])).orderBy(*order)
    inner = df.withColumn("here", payload)
    inner = inner.withColumns(
        {f"prev{d}": F.lag("here", d).over(w) for d in depths}
        | {f"next{d}": F.lead("here", d).over(w) for d in depths}
    )
    if slice_col is None:
        return inner

    def present(*names):
        return F.filter(F.array(*names), lambda p: p.isNotNull())

    ahead = [f"next{d}" for d in depths][: depth - 1]
    behind = [f"prev{d}" for d in reversed(depths)][1:]
    ends = inner.groupBy(*keys, slice_col).agg(
        F.max(F.when(F.col("prev1").isNull(), present("here", *ahead))).alias("_head"),
        F.max(F.when(F.col("next1").isNull(), present(*behind, "here"))).alias("_tail"),
    )
    across = Window.partitionBy(*keys).orderBy(F.col(slice_col).asc_nulls_last())
    # A slice has at least one row, so depth slices on each side hold enough rows.
    empty = F.slice("_head", 1, 0)
    ends = ends.select(
        *keys,
        slice_col,
        F.concat(
            *[F.coalesce(F.lag("_tail", d).over(across), empty) for d in reversed(depths)]
        ).alias("_before"),
        F.concat(*[F.coalesce(F.lead("_head", d).over(across), empty) for d in depths]).alias(
            "_after"
        ),
    )
    joined = joined_on(inner, ends, [*keys, slice_col])
    filled = {}
    for d in depths:
        # How many of the d rows looked back (or ahead) lie inside the slice.
        inside_prev = sum((F.col(f"prev{i}").isNotNull().cast("int") for i in depths if i < d),
                          F.lit(0))
        inside_next = sum((F.col(f"next{i}").isNotNull().cast("int") for i in depths if i < d),
                          F.lit(0))
        filled[f"prev{d}"] = F.coalesce(
            f"prev{d}", F.get("_before", F.size("_before") - (F.lit(d) - inside_prev))
        )
        filled[f"next{d}"] = F.coalesce(
            f"next{d}", F.get("_after", F.lit(d - 1) - inside_next)
        )
    return joined.withColumns(filled).drop("_before", "_after")
