"""Exact dedup by naming: equal texts get equal integers, unequal texts never do.

A text without white space is cut into blocks of fixed size. All blocks are sorted, and a block's
name is its place among the different blocks. Then neighbouring names are paired and the pairs
named in the same way, until one name is left for each document. Texts that took as many rounds
and got the same last name are equal, and no others: nothing rests on a hash being free of
collisions.

Each round shuffles its rows once, by range over (hash of the key, row, place), so a block that a
third of all documents share is spread over as many tasks as its rows need. Such a block gets a
name in each of them; a table of the first and last keys of every sort partition, a few rows for
each, tells which of these names are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchspark.llm.common import SPACES, fresh, numbered, settled, small_batches, stored

# Bytes of a block, and bits of a name that count within one sort partition.
BLOCK_BYTES = 4096
NAME_BITS = 40


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def named(parts: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Replace the key columns by ``name``, a positive integer that is the same for equal keys.

    ``parts`` has the columns ``row`` and ``pos``, which together are unique.
    """
    rest = [c for c in parts.columns if c not in keys]
    spread = (
        parts.withColumn("_hash", F.xxhash64(*keys))
        .repartitionByRange("_hash", "row", "pos")
        .sortWithinPartitions("_hash", *keys, "row", "pos")
    )
    fields = [parts.schema[c] for c in [*rest, *keys]]
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("name", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << NAME_BITS
        count, last, first_hash, edges, first_edges = 0, None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            hashes = batch.column("_hash").to_numpy()
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is None or last != tuple(c[0].as_py() for c in columns)
            names = base + count + np.cumsum(new)
            count = int(names[-1]) - base
            last = tuple(c[-1].as_py() for c in columns)
            if first_hash is None:
                first_hash = hashes[0]
            # Keys under the first and under the latest hash of this partition, with their names.
            for i in np.flatnonzero(new & (hashes == first_hash)).tolist():
                first_edges.append((int(names[i]), tuple(c[i].as_py() for c in columns)))
            if hashes[-1] != (edges[0][2] if edges else None):
                edges = []
            for i in np.flatnonzero(new & (hashes == hashes[-1])).tolist():
                edges.append((int(names[i]), tuple(c[i].as_py() for c in columns), hashes[-1]))
            out = [batch.column(c) for c in rest]
            out += [pa.nulls(batch.num_rows, c.type) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(names)], names=schema.names)
        both = dict(first_edges) | {name: key for name, key, _ in edges}
        if both:
            out = [pa.nulls(len(both), batch.column(c).type) for c in rest]
            out += [pa.array([k[i] for k in both.values()], c.type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(list(both))], names=schema.names)

    with small_batches(parts.sparkSession):
        found = stored(spread.mapInArrow(run, schema), label)
    edges = found.where(F.col("row").isNull()).select(*keys, F.col("name").alias("_name"))
    same = edges.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_name").alias("_one"))
    match = [F.col(k) == F.col(f"_{k}") for k in keys]
    same = edges.join(same, match).where("_name != _one").select("_name", "_one")
    return (
        found.where(F.col("row").isNotNull())
        # At most two rows for each sort partition.
        .join(F.broadcast(same), F.col("name") == F.col("_name"), "left")
        .select(*rest, F.coalesce("_one", "name").alias("name"))
    )


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: row (its number by ``numbered``), doc_id, keep_id, group_size,
    kept, text_sha256 (of the text without white space).

    Texts are equal when they are so without white space; a null text counts as empty, and empty
    texts are one group. Of a group the row with the most code points in its original text stays,
    then the one with the smallest doc_id (null first), then the first row, so that of rows that
    repeat an id one stays too. Other columns of ``docs`` are not read. No row gives no row.
    """
    docs = settled(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), "exact-dedup-rows")
    clean = numbered(docs, "row").select(
        "row",
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
        normalised(F.col("text")).cast("binary").alias("bytes"),
    )
    size = F.octet_length("bytes")
    blocks = clean.select(
        "row",
        "doc_id",
        "chars",
        F.sha2("bytes", 256).alias("sha"),
        F.greatest(F.lit(1), F.ceil(size / block_bytes)).cast("long").alias("n"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / block_bytes).cast("int") - 1)),
                lambda i: F.substring("bytes", i * block_bytes + 1, block_bytes),
            )
        ).alias("pos", "block"),
    ).select(
        "row",
        F.col("pos").cast("long").alias("pos"),
        "n",
        *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "chars", "sha")],
        "block",
    )
    level, first = 0, named(blocks, ["block"], "exact-dedup-blocks")
    most = first.agg(F.max("n")).first()[0] or 1
    done = [first.where("n = 1").select("row", F.lit(0).alias("rounds"), "name")]
    names = first.where("n > 1").select("row", "pos", "n", "name")
    while most > 1:
        level, most = level + 1, -(-most // 2)
        pairs = names.groupBy(
            "row", F.expr("pos div 2").alias("pos"), F.expr("(n + 1) div 2").alias("n")
        ).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("right"),
        )
        names = named(pairs, ["left", "right"], f"exact-dedup-{level}")
        done.append(names.where("n = 1").select("row", F.lit(level).alias("rounds"), "name"))
        names = names.where("n > 1")
    about = first.where("pos = 0")
    rows = about.where("n = 1").select("row", "doc_id", "chars", "sha", F.lit(0).alias("rounds"), "name")
    if len(done) > 1:
        later = done[1]
        for more in done[2:]:
            later = later.unionAll(more)
        long = about.where("n > 1").select("row", "doc_id", "chars", "sha")
        rows = rows.unionAll(long.join(later, "row").select(rows.columns))
    groups = rows.groupBy("rounds", "name").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("chars")).alias("c"), "doc_id", "row")).alias("best"),
    )
    # A large group's rows stay in the parts that the shuffle's map tasks made: Spark splits it.
    return rows.join(groups, ["rounds", "name"]).select(
        "row",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs, row = settled(docs, "exact-dedup-input"), fresh(docs, "row_number")
    kept = exact_groups(docs, block_bytes).where("kept").select(F.col("row").alias(row))
    return numbered(docs, row).join(kept, row, "left_semi").drop(row)
