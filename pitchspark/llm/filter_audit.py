"""How filters in a row interact, in every order, by wide packed counters.

A document's mask has a bit for each filter that it fails. What a chain of filters does with it
depends on the mask alone, so each mask is mapped to one big integer: a field for every step of
every order, and in each field four counters of 64 bits (kept after the step, removed by it, failing
it but removed before, failing it alone). The sum of the integers of a part's documents holds the
results of all orders at once. A counter never carries into the next one: it counts rows of the
part, of which there are fewer than 2^63.

Documents of the same mask are counted in the map tasks, so that one multiplication stands for
their additions, and at most a few hundred rows of a part reach its task, however hot it is.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import WORD, stored

# Bytes of a counter, and counters of a step.
COUNTER_BYTES = 8
KEPT, REMOVED, REDUNDANT, UNIQUE = range(4)
# More filters have too many orders for one integer and too many rows for each part.
MOST_FILTERS = 6


def text_failures(text: Column) -> dict[str, Column]:
    """Failure of each of the filters A to D; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    letters = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * letters.cast("long") > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and rows (how many documents are alike in these).

    Bits 0 to 3 of the mask are the failures of ``text_failures``, bit 4 is set if a smaller doc_id
    has the very same text (compared by SHA-256 and length), whatever filters remove. A null id is
    neither smaller nor larger than others, so such a document never fails that filter, and rows
    that repeat an id don't fail it because of each other. A null source is the part ''. A document
    is good or toxic if any label of its id says so; other columns are not read.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    failures = text_failures(docs["text"])
    bits = sum(
        (F.when(failure, F.lit(1 << i)).otherwise(0) for i, failure in enumerate(failures.values())),
        F.lit(0),
    )
    own = stored(
        docs.select(
            docs["doc_id"].alias("doc_id"),
            F.coalesce(docs["source"], F.lit("")).alias("part"),
            bits.alias("bits"),
            F.concat(F.unhex(F.sha2(text, 256)), F.encode(F.length(text).cast("string"), "utf-8")).alias("print"),
        ),
        "filter-masks",
    )
    # Ids and prints together are as good as unique, so no join meets a hot group of copies.
    first = own.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("doc_id"))
    marks = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("doc_id")).agg(
        F.coalesce(F.max(labels["quality"] == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(labels["toxic"] == 1), F.lit(False)).alias("toxic"),
    )
    repeats = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return (
        own.groupBy("doc_id", "print", "part", "bits")
        .agg(F.count("*").alias("rows"))
        .join(first.withColumn("first", F.lit(True)), ["doc_id", "print"], "left")
        .join(marks, "doc_id", "left")
        .groupBy(
            "part",
            (F.col("bits") + F.when(repeats, 16).otherwise(0)).alias("mask"),
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
        .agg(F.sum("rows").alias("rows"))
    )


def packed_outcomes(filters: int) -> list[int]:
    """For each mask the integer with its outcomes in every step of every order."""
    orders = list(permutations(range(filters)))
    packed = []
    for mask in range(1 << filters):
        fields = np.zeros((len(orders), filters, 4), dtype=f"<u{COUNTER_BYTES}")
        for o, order in enumerate(orders):
            removed = False
            for step, f in enumerate(order):
                fails = bool(mask >> f & 1)
                fields[o, step, REMOVED] = fails and not removed
                fields[o, step, REDUNDANT] = fails and removed
                fields[o, step, UNIQUE] = mask == 1 << f
                removed |= fails
                fields[o, step, KEPT] = not removed
        packed.append(int.from_bytes(fields.tobytes(), "little"))
    return packed


def unpacked(total: int, filters: int) -> np.ndarray:
    """The counters of a sum: orders, steps, 4."""
    orders = len(list(permutations(range(filters))))
    size = orders * filters * 4 * COUNTER_BYTES
    values = np.frombuffer(total.to_bytes(size, "little"), dtype=f"<u{COUNTER_BYTES}")
    return values.reshape(orders, filters, 4).astype(np.int64)


def audit(masks: DataFrame, letters: str, lost: dict[str, str]) -> DataFrame:
    """One row per part, order of the filters and step.

    ``masks`` has part, mask (bit i: fails the filter letters[i]), rows (documents that the row
    stands for) and boolean columns, of which ``lost`` names some as {result: column}. The result
    has part, filter_order, step (from 1), kept, removed, redundant, unique_fails, a long column
    for each of ``lost`` (documents removed here that the column marks; null marks none) and
    shapley (removed by the step's filter, summed over all orders). No row gives no row.
    """
    n = len(letters)
    if not 1 <= n <= MOST_FILTERS or len(set(letters)) != n:
        raise ValueError(f"between 1 and {MOST_FILTERS} different filters, not {letters!r}")
    counts = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in counts)
    marks = [F.coalesce(masks[c], F.lit(False)).alias(f"_{i}") for i, c in enumerate(lost.values())]
    alike = (
        masks.select("part", "mask", "rows", *marks)
        .groupBy("part", "mask", *[f"_{i}" for i in range(len(lost))])
        .agg(F.sum("rows").alias("rows"))
    )
    orders = list(permutations(range(n)))
    which = np.array(orders)
    made: list[list[int]] = []

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(packed_outcomes(n))
        total, of_marks = 0, [0] * len(lost)
        for mask, rows, *flags in frame[["mask", "rows", *[f"_{i}" for i in range(len(lost))]]].values.tolist():
            one = made[0][mask] * rows
            total += one
            for i, flag in enumerate(flags):
                of_marks[i] += one * flag
        fields = unpacked(total, n)
        by_filter = np.zeros(n, dtype=np.int64)
        np.add.at(by_filter, which.ravel(), fields[:, :, REMOVED].ravel())
        columns = [fields[:, :, c].ravel() for c in (KEPT, REMOVED, REDUNDANT, UNIQUE)]
        columns += [unpacked(x, n)[:, :, REMOVED].ravel() for x in of_marks]
        out = {
            "part": key[0],
            "filter_order": np.repeat(["".join(letters[f] for f in order) for order in orders], n),
            "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)),
        }
        return pd.DataFrame(out | dict(zip(counts, [*columns, by_filter[which.ravel()]], strict=True)))

    return alike.groupBy("part").applyInPandas(run, schema)
