"""Cells of CSV lines, and records that span lines by a parallel scan of the states of quotes.

Whether a line starts inside a quoted cell depends on all lines before it. A line is therefore read
as a function: the state it ends in if it starts outside of quotes, and if it starts inside. Such a
function is constant, a swap, or changes nothing, so the composition of any run of lines follows from
the last constant and the number of swaps behind it: running windows within the blocks of a file, one
row per block, and again running windows over the blocks. Lines inside then take the number of the
record before them, and only records of several lines are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A quoted cell up to its closing quote; doubled quotes stand for themselves. Without backtracking.
_BODY = r'[^"]*+(?:""[^"]*+)*+'
_CELL = rf'(?:\s*+"{_BODY}"[^,]*+|(?!\s*+")[^,]*+)'
# A line that starts outside of quotes and ends inside: whole cells, then one that stays open.
OPENS = rf'^(?:{_CELL},)*+\s*+"{_BODY}$'
# What closes the quoted cell that a line starts in, with the comma after it.
_CLOSE = rf'^{_BODY}"[^,]*+,?'


def fields(line: Column) -> Column:
    """The cells of a CSV line; quoted ones may hold commas and doubled quotes."""
    quoted = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',\s*("(?:[^"]|"")*"|[^,]*)')),
        lambda c: F.when(
            c.startswith('"'), F.replace(F.regexp_extract(c, '(?s)^"(.*)"', 1), F.lit('""'), F.lit('"'))
        ).otherwise(c),
    )
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ",", -1))


def cells(line: Column) -> Column:
    return F.transform(fields(line), lambda c: F.btrim(c, F.lit(' "\r﻿')))


def _functions(value: Column) -> dict[str, Column]:
    """Whether a line ends inside if it starts outside, and if it starts inside."""
    quote = F.coalesce(value.contains('"'), F.lit(False))
    after = F.regexp_replace(value, _CLOSE, "")
    return {
        "_out": F.when(quote, value.rlike(OPENS)).otherwise(False),
        # The comma was taken, so an empty rest is outside as well.
        "_in": F.when(quote & value.rlike(_CLOSE), after.rlike(OPENS)).otherwise(True),
    }


def _odd(n: Column) -> Column:
    return n % 2 == 1


def _with_states(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``_start0`` and ``_start1``: whether a row starts inside, if the rows of its keys begin
    outside or inside. The rows' functions are ``_out`` and ``_in``."""
    along = Window.partitionBy(*keys).orderBy(order)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("_out") == F.col("_in")
    swap = F.when(F.col("_out") & ~F.col("_in"), 1).otherwise(0)
    df = df.withColumn("_swaps", F.sum(swap).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn(
        "_last",
        F.last(F.when(constant, F.struct(F.col("_out").alias("inside"), "_swaps")), True).over(before),
    )
    swaps = F.col("_swaps") - swap
    since = F.col("_last.inside") != _odd(swaps - F.col("_last._swaps"))
    known = F.col("_last").isNotNull()
    return df.withColumns({
        "_start0": F.when(known, since).otherwise(_odd(swaps)),
        "_start1": F.when(known, since).otherwise(~_odd(swaps)),
    }).drop("_swaps", "_last")


def _ends(start: Column) -> Column:
    return F.when(start, F.col("_in")).otherwise(F.col("_out"))


def whole_records(lines: DataFrame, block: Column) -> DataFrame:
    """``lines`` (source_file, line_pos, value and others) with each record in one row.

    A record of several lines has the columns of its first line and their values joined by line
    feeds. A cell is quoted if its first character that isn't white space is a quote; other quotes
    are text. ``block`` cuts the lines of a file into consecutive ranges that one task can sort,
    such as the splits they were read from. Fails if a file ends inside a quoted cell. A null value
    is an empty line. Tables in which no line opens a cell, which takes a scan to see, stay as they
    are.
    """
    opening = lines.where(F.col("value").contains('"') & F.col("value").rlike(OPENS))
    if opening.isEmpty():
        return lines
    files = opening.select("source_file").distinct()
    keys = ["source_file", "_block"]
    along = Window.partitionBy(*keys).orderBy("line_pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.join(files, "source_file", "left_semi").withColumn("_block", block)
    marked = marked.withColumns(_functions(F.coalesce("value", F.lit(""))))
    marked = _with_states(marked, keys, "line_pos").withColumns({
        f"_number{i}": F.sum((~F.col(f"_start{i}")).cast("long")).over(along) for i in (0, 1)
    })
    ends = F.struct(*[_ends(F.col(f"_start{i}")).alias(name) for i, name in enumerate(("_out", "_in"))])
    blocks = marked.groupBy(*keys).agg(
        F.max_by(ends, "line_pos").alias("ends"),
        *[F.max(f"_number{i}").alias(f"_records{i}") for i in (0, 1)],
    ).select(*keys, "ends.*", "_records0", "_records1")
    # One row per block: a file begins outside of quotes.
    of_file = Window.partitionBy("source_file")
    in_order = of_file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    number = F.when(F.col("_start0"), F.col("_records1")).otherwise(F.col("_records0"))
    blocks = _with_states(blocks, ["source_file"], "_block").select(
        *keys,
        F.col("_start0").alias("_inside"),
        F.last(F.when(number > 0, F.struct(F.col("_block").alias("block"), number.alias("number"))), True)
        .over(in_order).alias("_before"),
        F.max_by(_ends(F.col("_start0")), "_block").over(of_file).alias("_unclosed"),
    )
    placed = marked.join(blocks, keys)
    start = F.when(F.col("_inside"), F.col("_start1")).otherwise(F.col("_start0"))
    number = F.when(F.col("_inside"), F.col("_number1")).otherwise(F.col("_number0"))
    own = F.struct(F.col("_block").alias("block"), number.alias("number"))
    value = F.when(~F.col("_unclosed"), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("a quoted cell stays open at the end of "), "source_file"))
    )
    placed = placed.withColumns({
        "value": value,
        "_record": F.when(number > 0, own).otherwise(F.col("_before")),
        "_single": ~start & ~_ends(start),
    })
    columns = lines.columns
    others = [c for c in columns if c not in ("source_file", "line_pos", "value")]
    ordered = F.array_sort(F.collect_list(F.struct("line_pos", F.coalesce("value", F.lit("")).alias("value"))))
    joined = placed.where("NOT _single").groupBy("source_file", "_record").agg(
        F.min("line_pos").alias("line_pos"),
        F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value"),
        *[F.min_by(c, "line_pos").alias(c) for c in others],
    )
    rest = lines.join(files, "source_file", "left_anti").select(*columns)
    return rest.unionAll(placed.where("_single").select(*columns)).unionAll(joined.select(*columns))
