"""What the pipeline's stages hold outside the heap at a time."""

from pyspark.sql.readwriter import DataFrameWriter

import corpus_pipeline
from pitchspark.llm.common import BATCH_BYTES

SF = "/root/testdata/sf0.001"


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Every table that a stage or its caller writes, if Python makes its rows from batches."""
    writes, parquet = [], DataFrameWriter.parquet

    def watched(writer, *args, **kwargs):
        plan = writer._df._jdf.queryExecution().toString()
        size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
        writes.append((stage, "MapInArrow" in plan, size == str(BATCH_BYTES)))
        return parquet(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(f(spark, docs, SF), "memory-test")
    by_python = [w for w in writes if w[1]]
    assert {s for s, _, _ in by_python} == {"toxicity", "exact dedup", "near dedup", "packing"}
    assert {s for s, _, small in by_python if not small} == set()
