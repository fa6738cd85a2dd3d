"""Canonical tables on storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pitchspark.functions.casts import no_nan
from pitchspark.schema import EVENT_SCHEMA, FEATURE_SCHEMA, TRACKING_SCHEMA, canonical

PARTITIONS = ["dataset", "match_id"]
# Kept in the files' schema for columns that were written without NaN.
NO_NAN = {"no_nan": True}


# A clustered table's cells of time and place, and how many of each a block of the curve spans (a
# power of two); its row groups and pages are small, so that their ranges are.
CELL_S, CELL_M, CELL_BITS = 8.0, 8.0, 4
CLUSTERED_OPTIONS = {"parquet.block.size": 4 << 20, "parquet.page.size": 64 << 10}


def _curve() -> Column:
    """The place of a row on a curve that keeps near times and places together: cells of time, x and y
    in Z-order within a block of 16 of each, blocks by time."""
    last = F.lit((1 << CELL_BITS) - 1)
    time = F.floor(F.coalesce("time_s", F.lit(0.0)) / CELL_S)
    x, y = (
        F.least(F.greatest(F.floor(F.coalesce(c, F.lit(0.0)) / CELL_M), F.lit(0)), last) for c in ("x_m", "y_m")
    )
    curve = F.shiftleft(F.shiftright(time, CELL_BITS), 3 * CELL_BITS)
    for i, cell in enumerate((y, x, time)):
        for bit in range(CELL_BITS):
            curve = curve + F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1)), 3 * bit + i)
    return curve


def write_table(df: DataFrame, path: str, clustered: bool = False) -> str:
    """Write by dataset and match, replacing just the matches present in ``df``.

    The rebalance hint gathers a match into few files and lets adaptive execution split one that
    is too large for a task. NaN becomes null, and the files say so. With ``clustered``, the rows of
    a match follow a curve through time and place, and filters on time_s, x_m and y_m skip most row
    groups and pages; it takes a sort, and needs these columns and the period.
    """
    kinds = dict(df.dtypes)
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in kinds}
    df = df.select(*[
        no_nan(quoted[c]).alias(c, metadata=NO_NAN) if kinds[c] == "double" else quoted[c]
        for c in kinds
    ])
    df, options = df.hint("rebalance", *PARTITIONS), {}
    if clustered:
        df, options = df.sortWithinPartitions(*PARTITIONS, "period", _curve()), CLUSTERED_OPTIONS
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**options)
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )
    return path


def replace_matches(df: DataFrame, path: str) -> None:
    """Write by match, replacing just the matches present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(path)


def read_windows(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Windows or their description, written by ``replace_matches``; a match named by digits keeps its
    name, which Spark would take for a number."""
    if schema is None:
        own = spark.read.option("recursiveFileLookup", True).parquet(path).schema
        schema = StructType([StructField("match_id", StringType()), *own.fields])
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Scan with the files' own types, so that other tools' tables can be read, then canonicalise.

    Whole numbers and decimals are read as their widest type, which files of either width give.
    Values of partition directories are text, so that a match named by digits keeps its name.
    """
    own = spark.read.option("recursiveFileLookup", True).parquet(path).schema
    wide = {"tinyint": LongType(), "smallint": LongType(), "int": LongType(), "float": DoubleType()}
    fields = [
        StructField(f.name, wide.get(f.dataType.simpleString(), f.dataType)) for f in own
    ]
    clean = frozenset(
        f.name for f in own if f.metadata.get("no_nan") and isinstance(f.dataType, DoubleType)
        and f.name in schema.names and isinstance(schema[f.name].dataType, DoubleType)
    )
    for f in spark.read.parquet(path).schema:
        if f.name not in own.names:
            known = f.name in schema.names
            fields.append(StructField(f.name, StringType() if known else f.dataType))
    return canonical(spark.read.schema(StructType(fields)).parquet(path), schema, clean)


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TRACKING_SCHEMA)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, EVENT_SCHEMA)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, FEATURE_SCHEMA)
