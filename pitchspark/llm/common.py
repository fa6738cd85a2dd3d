"""Tables in the shared folder, row numbers and column names for the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchspark.operators.skew import shared_folder

# What counts as white space between words, as characters and as a pattern of a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
# Bytes that one batch of rows takes on its way to Python, where ``small_batches`` holds.
BATCH_BYTES = 1 << 21


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: nothing above it is computed twice,
    and no lost executor takes it along."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``stored``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run within give Python rows in small batches. Ten thousand texts, Spark's usual batch, take
    tens of megabytes outside the heap in each task, and as many again in its Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def extended(schema: T.StructType, columns: str) -> T.StructType:
    """The schema with more columns, given as in CREATE TABLE."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(columns).fields])


def settled(df: DataFrame, name: str) -> DataFrame:
    """The table itself if it is a plain scan of files, which gives the same rows in the same order
    every time; any other (repartitioned, joined, made by chance) is written once and read again."""
    plan = df._jdf.queryExecution().optimizedPlan()
    plain = plan.deterministic() and bool(df.inputFiles())
    while plain and plan.nodeName() == "Project":
        plan = plan.children().head()
    return df if plain and plan.nodeName() == "LogicalRelation" else stored(df, name)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Number the rows. Give it a ``settled`` table, not the result of a shuffle: the numbers are
    those of the places in the splits of its files, and so the same in every scan of the session.

    Spark makes the splits from sizes and, if it isn't told how many to make at least, from the
    number of cores at the time; that would change with a lost executor, so it is told here.
    """
    spark, least = df.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(least, None) is None:
        spark.conf.set(least, str(spark.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text has this remainder; false for a missing id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
