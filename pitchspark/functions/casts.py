"""Coercion and missing-value helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def no_nan(c: Column) -> Column:
    """NaN to null."""
    return F.nanvl(c, F.lit(None).cast("double"))


def is_finite(c: Column) -> Column:
    """True for a present, finite number and never null."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def coerce(name: str, source: str, target: str) -> str:
    """SQL cast that gives null for what cannot be read; whole-number columns keep whole numbers."""
    column = "`" + name.replace("`", "``") + "`"
    as_double = f"try_cast({column} AS double)"
    if target == "double":
        return f"nanvl({as_double}, CAST(NULL AS double))"
    if target in ("int", "bigint") and source not in INTEGRAL:
        return f"CASE WHEN {as_double} = rint({as_double}) THEN try_cast({as_double} AS {target}) END"
    return column if source == target else f"try_cast({column} AS {target})"


def half_even(value: float) -> int:
    """Round a step count to the nearest whole number, halves to even."""
    return int(round(value))
