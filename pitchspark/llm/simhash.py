"""SimHash near-dedup with Golay-code fuzzy hashing.

A text's fingerprint has 64 bits, each the majority over the XXH64 hashes of its word shingles.
Fingerprints link if they differ in at most 4 bits. To find such pairs, a fingerprint is cut into
segments of 22, 21 and 21 bits, and each segment decoded to indices of codewords of the Golay code
near to it (see ``golay``). 4 differing bits fall on the segments, in rising order, as
(0, 0, any), (0, 1, any), (1, 1, any) or (0, 2, 2). So a pair either has two segments with at most
one differing bit each, or an equal one and two more with two each, and one of these keys finds it:

* for each two segments, the index of the first with all near indices of the second, and the other
  way round: of two words that differ in one bit, the index of either is among the near indices of
  the other;
* for each segment, its bits with all near indices of the next one.

Different fingerprints with a key in common are compared, and what links them kept as links to the
smallest fingerprint of their group in the task, never as all pairs. Keys with very many
fingerprints are cut into blocks, and each two blocks compared in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import fresh, numbered, settled, stored
from pitchspark.llm.components import connected, roots
from pitchspark.llm.golay import decode, near_indices

# Loading pandas takes 46 MB of each worker; where it is needed, Spark has loaded it.
if TYPE_CHECKING:
    import pandas as pd

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and bits
# A key with more fingerprints is cut into blocks of half as many.
RUN = 4096
_STEP = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (uint64) have each of the 64 bits."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of a whole text, 0 for a text without words."""
    words = (text or "").encode().lower().split()
    n = len(words) - shingle_words + 1
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed) if words else 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _STEP):
        size = min(_STEP, n - at)
        shingles = map(b" ".join, zip(*(words[at + i : at + i + size] for i in range(shingle_words))))
        counts += bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, size))
    return _majority(counts, n)


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles with these hashes (uint64), each counted as often as it is there."""
    parts = (hashes[at : at + _STEP] for at in range(0, len(hashes), _STEP))
    return _majority(sum(map(bit_counts, parts)), len(hashes))


def fingerprints(
    docs: DataFrame, text: str, name: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED
) -> DataFrame:
    """``docs`` with the fingerprint of its text column, a signed long, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_py(), shingle_words, seed) for t in batch.column(text)),
                np.uint64,
                batch.num_rows,
            )
            rest = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(found.view(np.int64))], names=[*keep, name]
            )

    keep = [c for c in docs.columns if c != text]
    kinds = docs.select(*keep).schema.add(name, "long")
    return docs.mapInArrow(run, kinds)


def key_rows(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of some fingerprints (uint64), and the places of their fingerprints."""
    words = [(prints >> np.uint64(s)).astype(np.int64) & ((1 << b) - 1) for s, b in SEGMENTS]
    own = [decode(w.astype(np.uint32)).astype(np.int64) for w in words]
    near = [near_indices(w, b) for w, (_, b) in zip(words, SEGMENTS, strict=True)]
    keys, places = [], []

    def add(kind: int, values: np.ndarray, use: np.ndarray) -> None:
        row, _ = np.nonzero(use)
        keys.append(values[use] | kind << 40)
        places.append(row)

    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (near_i, first_i), (near_j, first_j) = near[i], near[j]
        add(kind, own[i][:, None] << 12 | near_j, first_j)
        add(kind, near_i.astype(np.int64) << 12 | own[j][:, None], first_i & (near_i != own[i][:, None]))
    for i in range(3):
        near_j, first_j = near[(i + 1) % 3]
        add(3 + i, words[i][:, None] << 12 | near_j, first_j)
    return np.concatenate(keys), np.concatenate(places)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("print").to_numpy()
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096]
            keys, places = key_rows(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(part[places])], names=["key", "print"]
            )


def _stars(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    """Links as each fingerprint's link to the smallest one that these links reach."""
    nodes = root = np.zeros(0, np.int64)
    if left:
        nodes, root = roots(np.concatenate(left), np.concatenate(right))
    use = nodes != root
    return pa.RecordBatch.from_arrays([pa.array(nodes[use]), pa.array(root[use])], names=["a", "b"])


def _close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= max_bits) & (a != b)


def _links_of_runs(max_bits: int):
    """Links within runs of equal keys, in rows sorted by key; no run is longer than RUN."""

    def of(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        left, right, at, d = [], [], np.arange(len(keys)), 0
        while True:
            d += 1
            at = at[at + d < len(keys)]
            at = at[keys[at] == keys[at + d]]
            if not len(at):
                return _stars(left, right)
            use = at[_close(prints[at], prints[at + d], max_bits)]
            if len(use):
                left.append(prints[use])
                right.append(prints[use + d])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = prints = np.zeros(0, dtype=np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            prints = np.concatenate([prints, batch.column("print").to_numpy()])
            end = np.searchsorted(keys, keys[-1]) if len(keys) else 0
            yield of(keys[:end], prints[:end])
            keys, prints = keys[end:], prints[end:]
        yield of(keys, prints)

    return run


def _links_of_blocks(max_bits: int):
    def run(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        prints = np.unique(frame["print"].to_numpy())
        left, right = [], []
        for i, one in enumerate(prints):
            more = prints[i + 1 :]
            use = more[_close(np.full(len(more), one), more, max_bits)]
            left.append(np.full(len(use), one))
            right.append(use)
        return _stars(left, right).to_pandas()

    return run


def linked_prints(prints: DataFrame, max_bits: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """(node, root) for the fingerprints among ``prints`` (print; each once) that link to others."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys find pairs of at most 4 differing bits")
    keys = prints.select("print").mapInArrow(_keys, "key long, print long")
    large = stored(keys.groupBy("key").count().where(F.col("count") > run), "simhash-large-keys")
    usual = keys
    if any_large := not large.isEmpty():
        usual = keys.join(large, "key", "left_anti")
    links = (
        usual.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_links_of_runs(max_bits), "a long, b long")
    )
    if any_large:
        blocks = F.ceil(F.col("count") * 2 / run).cast("long")
        mine, other = F.pmod(F.xxhash64("print"), F.col("blocks")), F.col("other")
        links = links.unionAll(
            keys.join(large.withColumn("blocks", blocks), "key")
            .select(
                "key",
                "print",
                mine.alias("mine"),
                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
            )
            .groupBy("key", F.least("mine", other).alias("x"), F.greatest("mine", other).alias("y"))
            .applyInPandas(_links_of_blocks(max_bits), "a long, b long")
        )
    return connected(links)


def simhash_groups(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: row (its number by ``numbered``), doc_id, print (the fingerprint
    as a signed long), component_id (the smallest doc_id reachable through links, itself included;
    a null id only if there is no other) and kept (one row of each component: that of the smallest
    id, null last, then the first row).

    A null text has no words; texts without words have fingerprint 0, which links like any other.
    Rows that repeat an id are rows of their own. Other columns of ``docs`` are not read.
    """
    docs = settled(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), "simhash-rows")
    found = stored(
        fingerprints(numbered(docs, "row"), "text", "print", shingle_words, seed), "simhash-prints"
    )
    # Copies meet in the map tasks already; what is left has one row per fingerprint and task.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    prints = stored(found.groupBy("print").agg(best.alias("best")), "simhash-distinct")
    root = linked_prints(prints, max_bits)
    linked = prints.join(root, F.col("print") == F.col("node"))
    of_root = linked.groupBy("root").agg(F.min("best").alias("best"))
    moved = linked.select("print", "root").join(of_root, "root").select("print", "best")
    # Fingerprints without links keep their own smallest document.
    all_best = stored(
        prints.join(root, F.col("print") == F.col("node"), "left_anti").unionAll(moved),
        "simhash-components",
    )
    return found.join(all_best, "print").select(
        "row",
        "doc_id",
        "print",
        F.col("best.doc_id").alias("component_id"),
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of ``docs``, with all its columns."""
    docs, row = settled(docs, "simhash-input"), fresh(docs, "row_number")
    kept = simhash_groups(docs, **options).where("kept").select(F.col("row").alias(row))
    return numbered(docs, row).join(kept, row, "left_semi").drop(row)
