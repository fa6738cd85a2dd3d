"""Agent labels and tolerant column names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_label(c: Column) -> Column:
    """Lower-case, runs of other characters to one underscore, ``unknown`` when nothing is left."""
    cleaned = F.lower(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.when(cleaned == "", "unknown").otherwise(cleaned)


def trailing_number(c: Column) -> Column:
    """The digits at the end of a label as an integer, or null."""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("int")


def natural_key(c: Column) -> list[Column]:
    """Sort columns that put ``p_2`` before ``p_10``: the text part, then the number or -1."""
    return [
        F.regexp_replace(c, r"\d+$", ""),
        F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).try_cast("decimal(38,0)"), F.lit(-1)),
    ]


def bare_name(name: str) -> str:
    """A column name reduced to lower-case letters and digits."""
    return re.sub("[^a-z0-9]", "", name.lower())


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate matching a column by its bare name; the last duplicate column wins."""
    by_name = {bare_name(c): c for c in columns}
    return next((by_name[bare_name(c)] for c in candidates if bare_name(c) in by_name), None)
