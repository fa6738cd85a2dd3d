"""Finding input files."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame | None:
    """``source_file`` of every file below ``root`` whose name matches, named as by ``file_path``;
    None if there is no such directory. Contents are not read."""
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
            .load(str(root))
        )
    except AnalysisException:
        return None
    return files.select(file_path().alias("source_file"))


def literal(path: str) -> str:
    """A path for a reader, which takes some characters as patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def file_path() -> Column:
    """The row's file, as a plain path."""
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
