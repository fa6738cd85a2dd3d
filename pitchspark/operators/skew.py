"""Plans for keys that hold far more rows than a match can produce.

Window functions gather a whole key in one task. That is the cheapest plan for real matches (an
agent has some tens of thousands of rows in a period, a frame some two dozen), but a corrupt or
merged feed may put a third of all rows under one key. Operators therefore count rows per key
first, a narrow scan with map-side combine, and send only oversized keys through a second, exact
plan that splits them. With no such key the second plan is never built.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# More rows than this under one agent's period, or in one frame, take the split plan.
HOT_AGENT_ROWS = 2_000_000
HOT_FRAME_ROWS = 256
# Lookup sides of at most this many rows are broadcast.
BROADCAST_ROWS = 10_000
# Copies made of a lookup side that is too large to broadcast, and the rows of a key that need them.
SALTS = 64
HEAVY_ROWS = 200_000
# Rows per slice when one key's time series is split.
SLICE_ROWS = HOT_AGENT_ROWS
# Seconds per slice where distinct times are numbered.
SLICE_S = 3600.0


class HotKeys:
    """The keys with more than ``limit`` rows, and how to divide a table by them.

    ``size`` replaces the row count where a key's cost is not its number of rows.
    """

    def __init__(
        self, df: DataFrame, keys: list[str], limit: int | None, size: Column | None = None
    ):
        self.keys = keys
        self.any = False
        self.few = True
        if limit is None:
            return
        size = F.count("*") if size is None else size
        over = df.groupBy(*keys).agg(size.alias("_size")).where(F.col("_size") > limit).select(*keys)
        found = over.limit(BROADCAST_ROWS + 1).collect()
        self.any = bool(found)
        self.few = len(found) <= BROADCAST_ROWS
        if self.any:
            if self.few:
                over = F.broadcast(df.sparkSession.createDataFrame(found, over.schema))
            self.table = over.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], limit: int | None | HotKeys) -> HotKeys:
        """A check already made for the same rows is used again."""
        return limit if isinstance(limit, HotKeys) else cls(df, keys, limit)

    def _condition(self) -> Column:
        condition = F.lit(True)
        for k in self.keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
        return condition

    def cool(self, df: DataFrame) -> DataFrame:
        return df.join(self.table, self._condition(), "left_anti") if self.any else df

    def hot(self, df: DataFrame) -> DataFrame:
        return df.join(self.table, self._condition(), "left_semi")


def attach(
    df: DataFrame, side: DataFrame, keys: list[str], few: bool, spread: Column, how: str = "left",
    heavy: HotKeys | None = None,
) -> DataFrame:
    """Join a lookup with at most one row per key, null-safe, without gathering a key in one task.

    ``few`` says that the lookup was checked to have at most ``BROADCAST_ROWS`` rows. Otherwise
    each of its rows is copied ``SALTS`` times and ``spread`` decides which copy a row of ``df``
    meets. ``heavy`` are the keys, or some of their columns, checked to have more rows than one
    task should get; then only their rows are copied. Neither way the lookup is broadcast: Spark
    would judge it by its size before it is copied, and the driver would hold all copies.
    """
    if heavy is not None and not few:
        cool = _attached(heavy.cool(df), side, keys, how)
        if not heavy.any:
            return cool
        return cool.unionByName(attach(heavy.hot(df), heavy.hot(side), keys, False, spread, how))
    return _attached(df, side, keys, how, few, None if few else spread)


def _attached(
    df: DataFrame, side: DataFrame, keys: list[str], how: str, few: bool = False,
    spread: Column | None = None,
) -> DataFrame:
    renamed = side.select(
        *[F.col(k).alias(f"_side_{k}") for k in keys], *[c for c in side.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_side_{k}"))
    if few:
        joined = df.join(F.broadcast(renamed), condition, how)
    elif spread is None:
        joined = df.join(renamed.hint("merge"), condition, how)
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        joined = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(
            renamed.withColumn("_side_salt", salts).hint("merge"),
            condition & (F.col("_salt") == F.col("_side_salt")),
            how,
        )
    return joined.drop("_salt", "_side_salt", *[f"_side_{k}" for k in keys])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir. Where the session names
    none, local sessions get a temporary one; others fail, as each machine would have its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="pitchspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The table, worked out once and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def sliced(df: DataFrame, order: list[Column], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``_slice``, an ordered number; a slice has at most ``slice_rows`` rows.

    The rows are sorted into ranges of ``order``, whose bounds Spark takes from a sample, so they
    follow the data: no crowded time makes a range larger than others. There are as many ranges as
    a shuffle has partitions, whatever the number of slices; each is cut into slices by the places
    of its rows. The result is checkpointed, as all users of it must see the same bounds.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of the range in the upper bits, the place in it in the lower 33.
    place = F.col("_place")
    within = F.pmod(place.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(slice_rows))
    placed = ranged.withColumn("_place", F.monotonically_increasing_id())
    return checkpointed(placed.withColumn("_slice", place - within).drop("_place"))


def time_slice(time: Column, width_s: float = SLICE_S) -> Column:
    """Number of the fixed-width slice holding a time; null for a missing or infinite time."""
    return F.floor(time / F.lit(width_s)).try_cast("bigint")
