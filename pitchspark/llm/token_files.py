"""Token ids in ORC files.

A folder holds one ORC table ``tokens`` with a row per document, in ascending order of ids across
and within its files: doc_id, part (of the table), start_in_part, n_tokens and ids; and a small ORC
table ``parts`` with, per part, its first and last doc_id, its documents and tokens, and start, the
tokens before it. A document's place in the corpus is the sum of two starts, so nothing is
rewritten when the parts become known.

ORC cuts the files into stripes of ``stripe_bytes``, which Spark reads in parallel, stores integers
in runs (RLE version 2), and keeps minima, maxima and Bloom filters of doc_id for each
``index_rows`` rows, so a reader that asks for some ids skips the others' stripes and row groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchspark.llm.tokens import encoder

STRIPE_BYTES = 64 << 20
INDEX_ROWS = 10_000
BLOOM_FALSE = 0.01
# Rows handed on at a time: some thousand documents would be too many if they are long.
_BATCH_IDS = 2_000_000

TOKENS = "doc_id {id}, part int, start_in_part long, n_tokens long, ids array<int>"


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = None,
    stripe_bytes: int = STRIPE_BYTES,
    index_rows: int = INDEX_ROWS,
    compression: str = "snappy",
) -> None:
    """Encode the whole text of every row by the tokenizer's file and write the ids.

    A null text is empty; ``end_id`` is appended to each document. Rows that repeat an id follow
    each other, in the order of their texts; null ids come first. Other columns are not read. No
    row gives empty tables.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = TOKENS.format(id=id_type)
    ordered = (
        docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie", "text")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        end = np.asarray([] if end_id is None else [end_id], dtype=np.int32)
        for batch in batches:
            doc_ids, at, held, n = batch.column("doc_id"), 0, [], 0
            found = encode(batch.column("text").to_pylist())
            for place, ids in enumerate(found, 1):
                held.append(np.concatenate([ids, end]))
                n += len(held[-1])
                if n < _BATCH_IDS and place < batch.num_rows:
                    continue
                sizes = np.asarray([len(x) for x in held], dtype=np.int64)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                    pa.array(np.concatenate(held)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids[at:place],
                        pa.array(np.full(len(held), part, dtype=np.int32)),
                        pa.array(start + ends - sizes),
                        pa.array(sizes),
                        lists,
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += n
                at, held, n = place, [], 0

    (
        ordered.mapInArrow(run, schema)
        .write.option("orc.compress", compression.upper())
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_rows)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FALSE)
        .orc(f"{path}/tokens")
    )
    spark = docs.sparkSession
    totals = (
        spark.read.schema(schema)
        .orc(f"{path}/tokens")
        .groupBy("part")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.max("doc_id").alias("last_id"),
            F.count("*").alias("n_docs"),
            F.sum("n_tokens").alias("n_tokens"),
        )
    )
    # One row per part, not per document.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.orc(
        f"{path}/parts"
    )


def read_tokens(
    spark: SparkSession, path: str, where: Column | None = None, id_type: str = "bigint"
) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids of the documents that
    ``where`` (a condition on doc_id) chooses, all by default. The condition reaches the scan."""
    docs = spark.read.schema(TOKENS.format(id=id_type)).orc(f"{path}/tokens")
    if where is not None:
        docs = docs.where(where)
    parts = spark.read.schema("part int, start long").orc(f"{path}/parts")
    # One row per part: fewer than the tasks that wrote them.
    return docs.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )


def with_crc32(df: DataFrame, ids: str, name: str) -> DataFrame:
    """The table with the CRC-32 of the ids as little-endian 32-bit integers in their place."""
    import zlib

    keep = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            values, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            found = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(found, pa.int64())], names=[*keep, name]
            )

    return df.mapInArrow(run, df.select(*keep).schema.add(name, "long"))
