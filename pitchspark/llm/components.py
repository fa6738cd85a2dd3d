"""Connected components of links between integers, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import removed, stored


def roots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different nodes of some links, and for each the smallest node reachable through them."""
    nodes, places = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = places[: len(left)], places[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for side in (a, b):
            np.minimum.at(after, side, low)
            np.minimum.at(after, root[side], low)
        while True:
            jump = after[after]
            if np.array_equal(jump, after):
                break
            after = jump
        if np.array_equal(after, root):
            return nodes, nodes[root]
        root = after


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``links`` (a, b; any integers).

    A round has two steps. Large star: each node hangs its larger neighbours on its smallest
    neighbour or itself. Small star: each hangs its smaller neighbours and itself on the smallest.
    The links become stars around the roots within about log² rounds; each round's links are
    written to the shared folder and the ones before deleted.
    """
    spark = links.sparkSession

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m"))

    def trace(pairs: DataFrame) -> tuple:
        return tuple(
            pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )

    # a is the larger one from here on.
    now = stored(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = trace(now)
    while before[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(smallest(both), "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        low = smallest(large)
        small = (
            large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).unionAll(low.select("a", F.col("m").alias("b")))
        after = stored(small.distinct(), "links")
        removed(spark, now)
        now, last = after, before
        before = trace(now)
        if before == last:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
