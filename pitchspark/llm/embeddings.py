"""Near-dedup of embeddings: spherical k-means cells, blocked cosines, one representative per group.

Equal vectors are merged first and carry their number. Spherical k-means, fitted on a bounded
sample, gives each vector the cell of its nearest centre. Vectors of different cells can be close,
so a vector also visits each later cell that may hold one: with centres a (its own) and b, a vector
y of cell b has (b - a)y >= 0, and an x within the angle t of y then has
(a - b)x <= tan(t) |part of (a - b) across x|. Nothing is lost by this, and tight groups of vectors
visit few cells. Cells are cut into blocks, and each two blocks are compared in a task of their
own, by products of double-precision matrices a few hundred rows high. Of each two blocks only the
number of links of each vector leaves the task, with its link to the smallest one reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import stored
from pitchspark.llm.components import connected, roots

THRESHOLD = 0.95
# Vectors in a block, vectors that the centres are fitted on, and centres at most.
BLOCK = 4096
SAMPLE = 20_000
MAX_CELLS = 2048
# Cells of few vectors.
LEAST_CELLS = 8
_ROWS = 512


def centres(sample: np.ndarray, cells: int, steps: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means; a cell that loses all its vectors keeps its centre."""
    chosen = np.random.default_rng(seed).choice(len(sample), cells, replace=False)
    found = sample[chosen]
    for _ in range(steps):
        home = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.where(size > 0, size, 1), found)
    return found


def _units(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length 1. Scaling by the largest component first keeps the
    squares within a double's range."""
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = matrix.reshape(len(vectors), -1)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _visits(found: np.ndarray, size: int, threshold: float):
    """Rows (number, times, cell, home, vector) for each vector's own cell and those it visits."""
    # Squared distances of unit centres, from their products: cells x cells.
    apart = np.maximum(0, 2 - 2 * found @ found.T)
    tangent = np.sqrt(max(0.0, 1 - threshold**2)) / threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy()
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                unit = _units(batch.column("vector").take(pa.array(rows)))
                if length == size and len(found):
                    cosines = unit @ found.T
                    home = np.argmax(cosines, axis=1)
                    less = cosines[np.arange(len(rows)), home][:, None] - cosines
                    across = np.sqrt(np.maximum(0, apart[home] - less**2))
                    go = (less <= tangent * across + 1e-6) & (np.arange(len(found)) > home[:, None])
                    go[np.arange(len(rows)), home] = True
                    who, cell = np.nonzero(go)
                else:
                    # Another length than the centres': one cell of its own.
                    who, cell = np.arange(len(rows)), np.full(len(rows), -length)
                    home = cell
                place = pa.array(rows[who])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("number").take(place),
                        batch.column("times").take(place),
                        pa.array(cell.astype(np.int64)),
                        pa.array(home[who] == cell),
                        pa.array([u.tobytes() for u in unit[who]], pa.binary()),
                    ],
                    names=["number", "times", "cell", "home", "unit"],
                )

    return run


def _compare(threshold: float):
    def run(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("number", ignore_index=True)
        unit = np.frombuffer(b"".join(frame["unit"]), "<f8").reshape(len(frame), -1)
        number, times = frame["number"].to_numpy(), frame["times"].to_numpy()
        left, right = frame["left"].to_numpy(), frame["right"].to_numpy()
        links = np.zeros(len(frame), dtype=np.int64)
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        other, froms, tos = unit[b], [], []
        for at in range(0, len(a), _ROWS):
            rows = a[at : at + _ROWS]
            x, y = np.nonzero(unit[rows] @ other.T >= threshold)
            x, y = rows[x], b[y]
            # Within one block each pair is met twice.
            use = (x < y) if np.array_equal(a, b) else (x != y)
            x, y = x[use], y[use]
            np.add.at(links, x, times[y])
            np.add.at(links, y, times[x])
            froms.append(number[x])
            tos.append(number[y])
        froms, tos = np.concatenate([*froms, number[:0]]), np.concatenate([*tos, number[:0]])
        nodes, root = roots(froms, tos)
        found = pd.DataFrame({"number": number, "links": links})[links > 0]
        return found.merge(pd.DataFrame({"number": nodes, "root": root}), on="number")

    return run


def embedding_groups(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    sample: int = SAMPLE,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept.

    n_links counts the other vectors with a cosine of ``threshold`` or more in double precision,
    component_id is the smallest vec_id reachable through links (null only if there is no other),
    and kept says whether that is the row's own id. Vectors that are null, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Rows that repeat
    an id are vectors of their own. Other columns are not read. No row gives no row.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = vectors.select(
        vectors["vec_id"].alias("vec_id"),
        vectors["embedding"].cast("array<double>").alias("vector"),
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(
        F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    merged = rows.where(usable).groupBy("vector").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("times")
    )
    merged = stored(
        merged.withColumn("number", F.monotonically_increasing_id()), "embeddings-distinct"
    )
    n = merged.count()
    cells = max(1, min(max_cells, max(n // block, min(LEAST_CELLS, n // 4))))
    size, found = 0, np.zeros((0, 0))
    if cells > 1:
        part = F.pmod(F.xxhash64("number"), F.lit(n)) < sample
        drawn = merged.where(part).select("vector").limit(2 * sample).toPandas()["vector"]
        lengths = drawn.map(len)
        size = int(lengths.mode()[0])
        drawn = np.stack(drawn[lengths == size].tolist())
        drawn = drawn / np.abs(drawn).max(axis=1, keepdims=True)
        drawn = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
        found = centres(drawn, min(cells, len(drawn)))
    visits = stored(
        merged.select("number", "times", "vector").mapInArrow(
            _visits(found, size, threshold),
            "number long, times long, cell long, home boolean, unit binary",
        ),
        "embeddings-visits",
    )
    # A row per cell: how many blocks its own vectors and its visitors make.
    blocks = visits.groupBy("cell").agg(
        F.ceil(F.count_if("home") / block).alias("own"),
        F.ceil(F.count_if(~F.col("home")) / block).alias("more"),
    )
    blocks = F.broadcast(stored(blocks, "embeddings-blocks"))  # at most max_cells and one per length
    dealt = visits.join(blocks, "cell")
    spread = lambda n: F.pmod(F.xxhash64("number"), n)
    up_to = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    # Own block i meets own blocks j >= i, and the visitors' blocks, which are numbered from own on.
    own = dealt.where("home").withColumn("mine", spread(F.col("own")))
    own = own.withColumn("other", F.explode(up_to(F.col("own") + F.col("more")))).select(
        "cell",
        F.least("mine", "other").alias("x"),
        F.greatest("mine", "other").alias("y"),
        (F.col("mine") <= F.col("other")).alias("left"),
        (F.col("mine") >= F.col("other")).alias("right"),
        "number", "times", "unit",
    )
    visitors = dealt.where("not home").withColumn("mine", F.col("own") + spread(F.col("more")))
    visitors = visitors.withColumn("x", F.explode(up_to(F.col("own")))).select(
        "cell", "x", F.col("mine").alias("y"), F.lit(False).alias("left"), F.lit(True).alias("right"),
        "number", "times", "unit",
    )
    compared = stored(
        own.unionAll(visitors)
        .groupBy("cell", "x", "y")
        .applyInPandas(_compare(threshold), "number long, links long, root long"),
        "embeddings-links",
    )
    links = compared.groupBy("number").agg(F.sum("links").alias("links"))
    root = connected(compared.select(F.col("number").alias("a"), F.col("root").alias("b")))
    of_root = (
        merged.join(root, merged["number"] == root["node"])
        .groupBy("root")
        .agg(F.min("first_id").alias("component"))
    )
    component = root.join(of_root, "root").select(F.col("node").alias("number"), "component")
    known = stored(
        merged.join(links, "number", "left")
        .join(component, "number", "left")
        .select(
            F.col("vector").alias("_vector"),
            (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("component", "first_id").alias("component_id"),
        ),
        "embeddings-known",
    )
    # A vector of many rows: Spark splits its part of the join. A vector that isn't usable meets none.
    key = F.when(usable, F.col("vector"))
    out = rows.join(known, key == F.col("_vector"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def drop_near_vectors(vectors: DataFrame, **options) -> DataFrame:
    """The rows of ``vectors`` whose id is kept, with all their columns."""
    kept = embedding_groups(vectors, **options).where("kept").select(F.col("vec_id").alias("_kept"))
    return vectors.join(kept.distinct(), vectors["vec_id"].eqNullSafe(F.col("_kept")), "left_semi")
