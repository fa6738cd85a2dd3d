"""Mix sources to target weights by repeating documents.

Sizes are summed per source, targets shared out among the sources, and each document is emitted
floor(rate) times, plus once more if a number drawn from a hash of its id is below the fraction
of the rate. The draw depends on nothing but id and seed, so reruns and lost tasks agree. Of a few
seeds each source takes the one whose draws come nearest to its target: with few or very unequal
documents a single one may miss it by far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchspark.llm.common import WORD, fresh, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"
# Seeds that a source chooses from.
SEEDS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """From (source, source_size): also target, the words to take of each source.

    Sources in the order of their code points, null last, weigh ``weights`` in turn, and share
    ``share`` times all words; a target stops at ``most`` times its source's size and the rest is
    shared again by weight until none is above. Sources stop in the order of stop by weight, so the
    level that the others end at is that of the first source in this order that isn't stopped.
    There is one row per source here, whatever the number of documents. The share of a source
    without words is 0.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.select(
        "source", "source_size", F.element_at(weight, (place % len(weights) + 1).cast("int")).alias("w")
    ).select("*", (F.col("source_size") * F.lit(float(most))).alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = ranked.select(
        "*", F.when(level * F.col("w") <= F.col("cap"), level).alias("level")
    )
    return levels.select(
        "source",
        "source_size",
        F.least("cap", F.col("w") * F.coalesce(F.max("level").over(everything), F.lit(float("inf"))))
        .alias("target"),
    )


def copies(doc_id: Column, rate: Column, seed: Column) -> Column:
    """How often a document is emitted: 32 bits of an MD5 of seed and id decide on the last copy."""
    text = F.concat(seed, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def goals(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    seeds: int = SEEDS,
) -> DataFrame:
    """From (doc_id, source, size) of all documents: source, source_size, target, rate and seed."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stored(targets(sizes, weights, share, most), "mixing-targets")
    renamed = goal.withColumnRenamed("source", "_source")
    rated = sized.join(renamed, sized["source"].eqNullSafe(renamed["_source"]))
    tried = [F.lit(f"{seed}{i}") for i in range(seeds)]
    # A sum per source and seed leaves each task.
    taken = rated.groupBy("source", "target").agg(
        *[F.sum(F.col("size") * copies(F.col("doc_id"), _rate(), s)).alias(f"_{i}")
          for i, s in enumerate(tried)]
    )
    off = [F.struct(F.abs(F.col(f"_{i}") - F.col("target")), F.lit(i), s) for i, s in enumerate(tried)]
    best = F.array_min(F.array(*off))["col3"] if seeds > 1 else tried[0]
    chosen = taken.select(F.col("source").alias("_source"), best.alias("seed"))
    return stored(
        goal.join(chosen, goal["source"].eqNullSafe(chosen["_source"])).select(
            "source", "source_size", "target", _rate().alias("rate"), "seed"
        ),
        "mixing-goals",
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` with the columns size, source_size, target and copies after its own
    (renamed with a leading _ where it has such a column); ``options`` are those of ``goals``.

    A null text has size 0; a null source is a source. Rows that repeat an id are drawn alike.
    A source's rate is target / size, 0 if it has no words. No row gives no row.
    """
    size, source_size, target, times = (
        fresh(docs, c) for c in ("size", "source_size", "target", "copies")
    )
    small = docs.select(
        docs["doc_id"].alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        word_count(docs["text"]).alias("size"),
    )
    # One row per source, written: small enough to be broadcast if Spark measures it so.
    goal = goals(stored(small, "mixing-sizes"), **options).select(
        *[F.col(c).alias(f"_goal_{c}") for c in ("source", "source_size", "target", "rate", "seed")]
    )
    joined = docs.join(goal, docs["source"].cast("string").eqNullSafe(F.col("_goal_source")))
    return joined.select(
        *[docs[c] for c in docs.columns],
        word_count(docs["text"]).alias(size),
        F.col("_goal_source_size").alias(source_size),
        F.col("_goal_target").alias(target),
        copies(docs["doc_id"], F.col("_goal_rate"), F.col("_goal_seed")).alias(times),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as its source's rate says."""
    out = mixed(docs, **options)
    last = F.col(out.columns[-1])
    turn = fresh(out, "turn")
    times = F.array_repeat(F.lit(0), last.cast("int"))
    return out.withColumn(turn, F.explode(times)).select(*docs.columns)
