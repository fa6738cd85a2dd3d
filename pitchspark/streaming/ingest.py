"""Ingesting raw files as they arrive: each is read once, and each run writes just what is new."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchspark.sources import tables
from pitchspark.sources.files import file_path
from pitchspark.sources.registry import PROVIDERS

# New files that one batch takes at most; the paths of their matches pass the driver.
MAX_FILES = 500
_LISTED = "path string, modificationTime timestamp, length long, content binary"
LEDGER = "batch long, source_file string, match_id string, is_new boolean"


def ingest_new(
    spark: SparkSession, dataset: str, raw_dir: str, out_dir: str, max_files: int = MAX_FILES
) -> DataFrame:
    """Read the files below ``raw_dir`` that no run has read, and write the matches they belong to.

    Spark's file source remembers in ``out_dir/_files`` which files it gave out, by their paths; a
    file that is changed under its name is not read again. A batch of new files is completed by the
    other files of the same matches, and the partitions of these matches are replaced in
    ``tracking.parquet`` and ``events.parquet``, all others left alone. A batch that is run again
    after a failure replaces what it wrote. The result is the ledger, ``out_dir/ledger.parquet``:
    the files that each batch read, the new ones marked.
    """
    provider = PROVIDERS[dataset]

    def write(batch: DataFrame, number: int) -> None:
        new = [r.source_file for r in batch.collect()]  # max_files at most
        files = provider.match_files(spark, raw_dir) if new else None
        if files is None:
            return
        is_new = F.col("source_file").isin(new)
        touched = files.where(is_new).select("match_id").distinct()
        read = files.join(touched, "match_id", "left_semi").select("source_file", "match_id", is_new.alias("is_new"))
        rows = read.collect()  # the files of as many matches
        if not rows:
            return
        paths = [r.source_file for r in rows]
        for kind, reader in (("tracking", provider.read_tracking), ("events", provider.read_events)):
            try:
                table = reader(spark, raw_dir, only=paths)
            except NotImplementedError:
                continue
            if not table.isEmpty():
                tables.write_table(table, f"{out_dir}/{kind}.parquet")
        ledger = spark.createDataFrame([tuple(r) for r in rows], "source_file string, match_id string, is_new boolean")
        ledger.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/ledger.parquet/batch={number}")

    listed = (
        spark.readStream.format("binaryFile").schema(_LISTED)
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files)
        .load(str(raw_dir)).select(file_path().alias("source_file"))
    )
    (
        listed.writeStream.foreachBatch(write).option("checkpointLocation", f"{out_dir}/_files")
        .trigger(availableNow=True).start().awaitTermination()
    )
    try:
        return spark.read.schema(LEDGER).option("basePath", f"{out_dir}/ledger.parquet").parquet(
            f"{out_dir}/ledger.parquet"
        )
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)
