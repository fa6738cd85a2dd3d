"""Near-dedup by the Jaccard similarity of word shingles.

Texts link if the sets of their five-word shingles have a similarity of at least 0.8. Words are cut
and lower-cased as for ``simhash``; a text of fewer words is one shingle. Sets are held as the sorted
XXH64 hashes of their shingles.

Candidates come from SimHash and from MinHash. SimHash is that of ``simhash``, on these shingles:
each text is a candidate with the first one of those that its fingerprint reaches through links of
few bits, found by the keys of the Golay code. That is the cheaper way to most near copies, but
pairs at 0.8 differ in more bits than its keys bridge. MinHash finds these: 128 minima in 32 bands
of 4. A pair of similarity s shares a band with probability 1 - (1 - s^4)^32, so a pair at 0.8 is
missed once in 21 million, one above it less often. Every link, of either origin, is verified on the
whole sets. Three steps together test all pairs of a band key but those that are known to be in one
component already or to have too little in common:

* each text with the first one of its fingerprint and of each of its keys. What links here makes
  components, and a group of copies is mostly settled;
* in keys with several components left, the texts outside of the key's largest component with one of
  its members, another one for each key. A text that some of the component are similar to meets
  several of them by its keys;
* in keys that still have several components, the texts outside of the largest one with all others.
  Both sides are cut into blocks, and each two blocks compared in a task of their own, which gives no
  more links than connect the components it has.

Before the second step go the texts of which over a fifth of the shingles are in no other text that
is left: similar texts have four fifths of either's shingles in common.
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

from pitchspark.llm.common import fresh, numbered, settled, small_batches, stored
from pitchspark.llm.components import connected, roots
from pitchspark.llm.simhash import linked_prints, print_of

if TYPE_CHECKING:
    import pandas as pd

SHINGLE_WORDS = 5
# Similarity at least 4 / 5.
SIMILAR = (4, 5)
SEED = 42
BANDS, BAND_ROWS = 32, 4
# Texts in a block of a key, on average.
BLOCK = 512
_STEP = 512

_RANDOM = np.random.default_rng(SEED)
_FACTORS, _TERMS, _MIX = (
    _RANDOM.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) for _ in range(3)
)
_FACTORS |= np.uint64(1)


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted different hashes (uint64) of a text's shingles; one for a text without words."""
    words = (text or "").encode().lower().split()
    n = len(words) - shingle_words + 1
    if n < 2:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, n))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key (int64) for each band of a set."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), _STEP):
        part = np.multiply.outer(found[at : at + _STEP], _FACTORS)
        part += _TERMS
        np.minimum(low, part.min(axis=0), out=low)
    # Bands of the same minima differ by their random factors.
    mixed = (low ^ (low >> np.uint64(29))) * (_MIX | np.uint64(1)) + _MIX
    return mixed.reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def similar(common, left, right):
    """Whether sets of these sizes and so many common members have the similarity, in whole numbers;
    arrays or columns."""
    part, whole = SIMILAR
    return common * (part + whole) >= part * (left + right)


def _signatures(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints, keys = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), shingle_words)
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
                prints.append(print_of(found))
                keys.append(band_keys(found))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            ends = pa.array(np.arange(len(names) + 1, dtype=np.int32) * BANDS)
            prints = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(names, pa.binary()), prints,
                 pa.ListArray.from_arrays(ends, flat)],
                names=["row", "doc_id", "name", "print", "keys"],
            )

    return run


def _sets(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(t.as_py(), shingle_words).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(found, pa.list_(pa.int64()))], names=["row", "found"]
                )

    return run


def _tested_blocks(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """What links a block's strays and members of other components: each component's root with the
    smallest one that it reaches here, never the pairs of texts."""
    import pandas as pd  # 46 MB of a worker that the other steps don't need

    stray = frame["stray"].to_numpy()
    root, found = (frame[c].to_numpy() for c in ("root", "found"))
    of, left, right = np.flatnonzero(~stray), [], []
    if len(of):
        sizes = np.array([len(found[i]) for i in of])
        flat = np.concatenate(found[of])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(of)), sizes)[order]
        for i in np.flatnonzero(stray):
            first, last = (np.searchsorted(flat, found[i], side) for side in ("left", "right"))
            at = np.repeat(first, last - first) + np.arange((last - first).sum())
            at -= np.repeat(np.cumsum(last - first) - (last - first), last - first)
            common = np.bincount(owner[at], minlength=len(of))
            met = np.unique(root[of[similar(common, len(found[i]), sizes)]])
            right.append(met[met != root[i]])
            left.append(np.full(len(right[-1]), root[i]))
    a = b = np.zeros(0, dtype=np.int64)
    if left:
        a, b = roots(np.concatenate(left), np.concatenate(right))
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def close_prints(rows: DataFrame) -> DataFrame:
    """(a, b): the rows (row, print; a long) with the first one of those whose fingerprints theirs
    reach, by links of at most ``simhash.MAX_BITS`` bits; they needn't be similar."""
    prints = stored(rows.select("print").distinct(), "jaccard-prints")
    root = stored(linked_prints(prints), "jaccard-print-roots")
    named = rows.join(root, rows["print"] == root["node"], "left").select(
        "row", F.coalesce("root", "print").alias("root")
    )
    first = named.groupBy("root").agg(F.min("row").alias("a"), F.count("*").alias("n")).where("n > 1")
    return named.join(first, "root").where("row != a").select("a", F.col("row").alias("b"))


def _lonely(sets: DataFrame) -> DataFrame:
    """(row): the rows of ``sets`` (row, found) that are similar to no other one, as over a fifth of
    their members are in no other one."""
    part, whole = SIMILAR
    each = sets.select("row", F.size("found").alias("size"), F.explode("found").alias("member"))
    # Members of many rows are merged in the map tasks.
    rows = each.groupBy("member").agg(
        F.min("row").alias("row"), F.max("row").alias("last"), F.min("size").alias("size")
    )
    alone = rows.where("row = last").groupBy("row", "size").agg(F.count("*").alias("n"))
    return alone.where(F.col("n") * whole > F.col("size") * (whole - part)).select("row")


def _links(docs: DataFrame, keys: DataFrame, shingle_words: int, block: int) -> DataFrame:
    """(a, b) between the rows of ``keys`` (row, print, keys), enough of all links for their
    components."""
    each = keys.select("row", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Without the first text of each key, which is tested with all others.
    others = stored(
        each.join(shared.select("key", "first"), "key").where("row != first"), "jaccard-keys"
    )
    of_keys = others.select(F.col("first").alias("a"), F.col("row").alias("b"))
    pairs = stored(
        close_prints(keys.select("row", "print")).unionAll(of_keys).distinct(), "jaccard-pairs"
    )
    used = pairs.select(F.col("a").alias("row")).unionAll(pairs.select("b")).distinct()
    texts = docs.join(used, "row", "left_semi").select("row", "text")
    sets = stored(texts.mapInArrow(_sets(shingle_words), "row long, found array<long>"), "jaccard-sets")
    left = sets.select(F.col("row").alias("a"), F.col("found").alias("left"))
    right = sets.select(F.col("row").alias("b"), F.col("found").alias("right"))
    # Here, not in Python: batches of sets in pairs would take hundreds of megabytes outside the heap.
    common = F.size(F.array_intersect("left", "right"))

    def tested(pairs: DataFrame) -> DataFrame:
        both = pairs.join(left, "a").join(right, "b")
        return both.where(similar(common, F.size("left"), F.size("right"))).select("a", "b")

    def rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
        root = stored(connected(links), "jaccard-roots")
        return rows.select("key", "row").join(root, rows["row"] == root["node"], "left").select(
            "key", "row", F.coalesce("root", "row").alias("root")
        )

    def still_open(rows: DataFrame) -> DataFrame:
        """The keys of several components, with their largest one and one of its rows."""
        # Another row in each key, though many keys have the same rows.
        any_row = F.min(F.struct(F.xxhash64("key", "row"), "row")).getField("row")
        parts = rows.groupBy("key", "root").agg(F.count("*").alias("n"), any_row.alias("one"))
        largest = F.max(F.struct("n", "root", "one")).alias("main")
        return stored(
            parts.groupBy("key")
            .agg(largest, F.sum("n").alias("n"), F.count("*").alias("parts"))
            .where("parts > 1")
            .select(
                "key",
                F.col("main.root").alias("main"),
                F.col("main.one").alias("one"),
                F.ceil((F.col("n") - F.col("main.n")) / block).cast("long").alias("stray_blocks"),
                F.ceil(F.col("n") / block).cast("long").alias("blocks"),
            ),
            "jaccard-open",
        )

    links = stored(tested(pairs), "jaccard-links")
    now = rooted(others, links)
    now = stored(now.join(still_open(now).select("key"), "key"), "jaccard-now")
    lonely = _lonely(sets.join(now.select("row").distinct(), "row", "left_semi"))
    now = stored(now.join(lonely, "row", "left_anti"), "jaccard-now")
    strays = now.join(still_open(now), "key").where("root != main")
    by_one = strays.select(F.col("one").alias("a"), F.col("row").alias("b")).distinct()
    links = stored(links.unionAll(tested(by_one)), "jaccard-links")
    now = stored(rooted(now, links), "jaccard-now")
    open_ = still_open(now)
    if open_.isEmpty():
        return links
    now = now.join(open_, "key")

    def dealt(rows: DataFrame, mine: str, other: str, stray: bool) -> DataFrame:
        return rows.select(
            "key", "row", "root", F.lit(stray).alias("stray"),
            F.pmod(F.xxhash64("row"), F.col(mine)).alias(mine),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other),
        ).select("key", "row", "root", "stray", "stray_blocks", "blocks")

    strays = dealt(now.where("root != main"), "stray_blocks", "blocks", True)
    dealt_out = strays.unionAll(dealt(now, "blocks", "stray_blocks", False))
    return links.unionAll(
        dealt_out.join(sets, "row")
        .groupBy("key", "stray_blocks", "blocks")
        .applyInPandas(_tested_blocks, "a long, b long")
    )


def jaccard_groups(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: row (its number by ``numbered``), doc_id, component_id (the
    smallest doc_id reachable through links, itself included; a null id only if there is no other)
    and kept (one row of each component: that of the smallest id, null last, then the first row).

    Texts without words, null ones too, are equal. Rows that repeat an id are rows of their own.
    Other columns of ``docs`` are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = settled(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), "jaccard-rows")
    docs = numbered(docs, "row")
    with small_batches(docs.sparkSession):
        found = stored(
            docs.mapInArrow(
                _signatures(shingle_words),
                f"row long, doc_id {id_type}, name binary, print long, keys array<long>",
            ),
            "jaccard-signatures",
        )
        # Equal sets meet in the map tasks already; the row of each that is the best stands for it.
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "print", "keys"))
        distinct = stored(found.groupBy("name").agg(best.alias("best")), "jaccard-distinct")
        of_each = distinct.select("best.row", "best.print", "best.keys")
        links = _links(docs, of_each, shingle_words, block)
        root = stored(connected(links), "jaccard-roots")
    best = distinct.select("name", F.struct("best.none", "best.doc_id", "best.row").alias("best"))
    linked = best.join(root, F.col("best.row") == F.col("node"))
    of_root = linked.groupBy("root").agg(F.min("best").alias("best"))
    moved = linked.select("name", "root").join(of_root, "root").select("name", "best")
    all_best = stored(
        best.join(root, F.col("best.row") == F.col("node"), "left_anti").unionAll(moved),
        "jaccard-components",
    )
    return found.select("row", "doc_id", "name").join(all_best, "name").select(
        "row",
        "doc_id",
        F.col("best.doc_id").alias("component_id"),
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of ``docs``, with all its columns."""
    docs, row = settled(docs, "jaccard-input"), fresh(docs, "row_number")
    kept = jaccard_groups(docs, **options).where("kept").select(F.col("row").alias(row))
    return numbered(docs, row).join(kept, row, "left_semi").drop(row)
