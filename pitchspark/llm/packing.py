"""Best-fit packing of documents into sequences, with certified repacking.

Documents become pieces of at most ``capacity`` tokens; pieces of exactly that size are sequences
of their own. The others are dealt out to groups of bounded size by a hash of their number, and
best-fit decreasing packs each group; with a gap, some orders changed by chance are tried too. Dual feasible functions give a lower bound on the number of
sequences that any packing of the group needs; a group that reaches its bound is certified and
done. The documents in the open sequences of the other groups are exchanged: dealt out anew to half
as many groups, and packed again. A new packing is taken only if it needs fewer sequences than the
one before. This ends when all are certified, when one group is left, or after ``rounds``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import small_batches, stored
from pitchspark.llm.tokens import encoder

CAPACITY = 1024
# Pieces in a group, on average, and exchanges at most.
GROUP_PIECES = 65_536
ROUNDS = 6
# How far the sizes of pieces are changed, by chance, for each further order that a group with a gap
# is packed in.
SPREADS = (0.2, 0.25, 0.3, 0.35) * 10

PIECE = "piece int, start long, length long, ids_crc32 long, number long"


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, keep_ids: bool
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, number (unique) and, if asked for, ids."""
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {PIECE}" + ", ids array<int>" * keep_ids
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(tokenizer).encode, TaskContext.get().partitionId() << 40
        end = np.asarray([] if end_id is None else [end_id], dtype=np.int32)

        def batch_of(rows: list, ids: list, doc_ids: pa.Array) -> pa.RecordBatch:
            places, *rest = zip(*rows, strict=True)
            columns = [doc_ids.take(pa.array(places)), pa.array(rest[0], pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in rest[1:]]
            columns += [pa.array(ids, pa.list_(pa.int32()))] * keep_ids
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            doc_ids, rows, held = batch.column("doc_id"), [], []
            for place, found in enumerate(encode(batch.column("text").to_pylist())):
                ids = np.concatenate([found, end])
                at, cut = 0, len(ids) % capacity or min(capacity, len(ids))
                piece = 0
                while at < len(ids):
                    part = ids[at:cut]
                    crc = zlib.crc32(np.ascontiguousarray(part, dtype="<u4"))
                    rows.append((place, piece, at, len(part), crc, number))
                    if keep_ids:
                        held.append(part)
                    number += 1
                    piece, at, cut = piece + 1, cut, cut + capacity
                if len(rows) >= 4096:
                    yield batch_of(rows, held, doc_ids)
                    rows, held = [], []
            if rows:
                yield batch_of(rows, held, doc_ids)

    return docs.mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, by two families of dual feasible functions.

    The first drops items below a limit and lets items above capacity minus it fill a sequence.
    The second rounds (k + 1) x / capacity down to k-ths, but for whole values, which stay.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(object)
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    amount = np.concatenate([[0], np.cumsum(counts * sizes)])  # of items below a size
    number = np.concatenate([[0], np.cumsum(counts)])
    for limit in range(1, capacity // 2 + 1):
        large = capacity - limit
        total = amount[large + 1] - amount[limit] + capacity * (number[-1] - number[large + 1])
        best = max(best, -(-int(total) // capacity))
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        rounded = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        total = int((counts * rounded).sum())  # in units of 1 / (k * capacity)
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit(
    lengths: np.ndarray, capacity: int, order: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item, largest first (or in the given order), each into the fullest
    sequence it fits."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0  # bit r: some sequence has r tokens left
    if order is None:
        order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            left = (fits & -fits).bit_length() - 1 + size
            found = open_with[left].pop()
            if not open_with[left]:
                mask ^= 1 << left
        else:
            found, left, used = used, capacity, used + 1
        bins[i], offsets[i] = found, capacity - left
        left -= size
        if left:
            open_with[left].append(found)
            mask |= 1 << left
    return bins, offsets


def best_of(lengths: np.ndarray, capacity: int, bound: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each item and the number of sequences, by best fit in decreasing order;
    while that needs more than ``bound``, by orders that a little chance changes, the best of all."""
    best = best_fit(lengths, capacity)
    used = int(best[0].max()) + 1 if len(lengths) else 0
    rng = np.random.default_rng(len(lengths))
    for spread in SPREADS:
        if used <= bound:
            break
        about = lengths * (1 + rng.uniform(0, spread, len(lengths)))
        bins, offsets = best_fit(lengths, capacity, np.argsort(-about, kind="stable"))
        if bins.max() + 1 < used:
            best, used = (bins, offsets), int(bins.max()) + 1
    return *best, used


PLACED = "number long, length long, grp long, bin long, place long, fill long, gap long"


def _pack_group(capacity: int):
    """Pack a group anew; if its rows were packed before, keep that unless this needs less."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("number", ignore_index=True)
        lengths = frame["length"].to_numpy()
        bound = lower_bound(lengths, capacity)
        bins, offsets, used = best_of(lengths, capacity, bound)
        old = frame[["grp", "bin"]].drop_duplicates()
        if old["grp"].ge(0).all() and len(old) <= used:
            # No better: the sequences stay as they were, and the gap is that of this exchange.
            out = frame.copy()
            out["gap"] = len(old) - bound
        else:
            fill = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
            out = frame.assign(
                grp=key[0], bin=bins, place=offsets, fill=fill[bins], gap=used - bound
            )
        return out[["number", "length", "grp", "bin", "place", "fill", "gap"]]

    return run


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 2,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
    group_pieces: int = GROUP_PIECES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if
    asked for, ids.

    A null text is empty; a document without any token (only if ``end_id`` is None) has no piece.
    A document longer than ``capacity`` is cut so that only its first piece may be shorter. Rows
    that repeat an id are packed as rows of their own. Other columns are not read. No row gives no
    row. A group's rows are bounded: it is dealt out by number, not by any value of the documents.
    """
    if group_pieces < 1 or capacity < 1:
        raise ValueError("group_pieces and capacity must be positive")
    with small_batches(docs.sparkSession):
        cut = stored(pieces(docs, tokenizer, end_id, capacity, keep_ids), "packing-pieces")
    none = F.lit(-1).cast("long")
    loose = cut.where(F.col("length") < capacity).select(
        "number", "length", none.alias("grp"), none.alias("bin"), none.alias("place"),
        none.alias("fill"), none.alias("gap"),
    )
    groups = max(1, -(-loose.count() // group_pieces))
    base, settled = 0, []
    for turn in range(rounds + 1):
        dealt = F.pmod(F.xxhash64(F.col("number"), F.lit(turn)), F.lit(groups))
        if turn:
            # A sequence travels as a whole.
            dealt = F.pmod(F.xxhash64("grp", "bin", F.lit(turn)), F.lit(groups))
        now = stored(
            loose.groupBy((dealt + base).alias("to")).applyInPandas(_pack_group(capacity), PLACED),
            f"packing-{turn}",
        )
        base += groups
        open_ = F.col("gap") > 0
        gaps = now.where(open_).agg(F.count("*")).first()[0]
        if not gaps or groups == 1 or turn == rounds:
            settled.append(now)
            break
        # Full sequences are as good as they can be; only the others are exchanged.
        settled.append(now.where(~open_ | (F.col("fill") == capacity)))
        loose = now.where(open_ & (F.col("fill") < capacity))
        groups = max(1, min(groups // 2, -(-gaps // group_pieces)))
    placed = settled[0]
    for more in settled[1:]:
        placed = placed.unionAll(more)
    sequence = (F.col("grp") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id")
    columns = [c for c in cut.columns if c != "number"]
    whole = cut.where(F.col("length") == capacity).select(
        *columns, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    shared = cut.where(F.col("length") < capacity).join(
        placed.select("number", sequence, F.col("place").alias("offset")), "number"
    )
    columns = [*[c for c in columns if c != "ids"], "sequence_id", "offset", *["ids"] * keep_ids]
    return whole.select(*columns).unionAll(shared.select(*columns))
