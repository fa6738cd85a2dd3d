"""Fixed-length history/future windows with stable agent slots."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchspark.constants import BALL, PLAYER
from pitchspark.functions.casts import half_even
from pitchspark.functions.labels import natural_key
from pitchspark.operators.skew import time_slice
from pitchspark.operators.timeseries import sort_struct

PERIOD_KEYS = ["match_id", "period"]
# The features and targets taken when none are named.
DEFAULT_FEATURES = ["x_m", "y_m", "vx_mps", "vy_mps", "speed_mps", "distance_to_ball_m"]
DEFAULT_TARGETS = ["x_m", "y_m"]
# Window starts per block of steps; a block also holds the steps its last windows reach into.
BLOCK_STEPS = 256


@dataclass(frozen=True)
class WindowConfig:
    """Lengths in seconds at a frame rate; all must be positive and give at least one step."""

    history_s: float = 5.0
    future_s: float = 5.0
    fps: float = 10.0
    max_agents: int = 23
    stride_steps: int = 1

    def __post_init__(self):
        for name in ("history_s", "future_s", "fps", "max_agents", "stride_steps"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        if self.history_steps < 1 or self.future_steps < 1:
            raise ValueError("history and future must each cover at least one step")

    @property
    def history_steps(self) -> int:
        return half_even(self.history_s * self.fps)

    @property
    def future_steps(self) -> int:
        return half_even(self.future_s * self.fps)

    @property
    def steps(self) -> int:
        return self.history_steps + self.future_steps


def _on(left: str, right: str, keys: list[str]) -> Column:
    return reduce(
        Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    )


def agent_slots(source: DataFrame, max_agents: int = 23) -> DataFrame:
    """One row per (match, period, slot): home, away and other players, then the first ball.

    Players are in natural order within their side and only the first slots are kept. An agent
    listed for two sides has two slots. The ranking is cut off before the shuffle, so a period
    with any number of agents sends only ``max_agents`` rows per task.
    """
    side = (
        F.when(F.col("agent_type") == BALL, 3)
        .when(F.col("team_id") == "home", 0)
        .when(F.col("team_id") == "away", 1)
        .otherwise(2)
    )
    agents = (
        source.where(F.col("agent_type").isin(PLAYER, BALL) & F.col("agent_id").isNotNull())
        .select(*PERIOD_KEYS, "agent_id", side.alias("side"))
        .distinct()
        .withColumn("is_ball", F.col("side") == 3)
    )
    ranked = Window.partitionBy(*PERIOD_KEYS, "is_ball").orderBy(
        "side", *natural_key(F.col("agent_id")), "agent_id"
    )
    first = agents.withColumn("rank", F.row_number().over(ranked)).where(
        F.col("rank") <= max_agents
    ).where(~F.col("is_ball") | (F.col("rank") == 1))
    whole = Window.partitionBy(*PERIOD_KEYS)
    balls = F.max(F.col("is_ball").cast("int")).over(whole)
    players = F.count_if(~F.col("is_ball")).over(whole)
    return (
        first.withColumns({"room": F.lit(max_agents) - balls, "players": players})
        .where(F.col("is_ball") | (F.col("rank") <= F.col("room")))
        .select(
            *PERIOD_KEYS,
            F.when(F.col("is_ball"), F.least("players", "room"))
            .otherwise(F.col("rank") - 1).cast("int").alias("slot"),
            "agent_id",
        )
    )


def time_index(source: DataFrame) -> DataFrame:
    """Distinct times of each (match, period), numbered from 0 in ``idx``, with their number ``n``.

    Numbering runs within slices of time; a summary of the slices gives each its offset, so a
    long period is spread over tasks.
    """
    times = (
        source.where(F.col("time_s").isNotNull()).select(*PERIOD_KEYS, "time_s").distinct()
        .withColumn("slice", time_slice(F.col("time_s")))
    )
    inside = Window.partitionBy(*PERIOD_KEYS, "slice").orderBy("time_s")
    numbered = times.withColumn("idx", F.row_number().over(inside).cast("bigint") - 1)
    onward = Window.partitionBy(*PERIOD_KEYS).orderBy("slice")
    offsets = times.groupBy(*PERIOD_KEYS, "slice").agg(F.count("*").alias("size")).withColumns({
        "before": F.coalesce(
            F.sum("size").over(onward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
        "n": F.sum("size").over(Window.partitionBy(*PERIOD_KEYS)),
    })
    return numbered.alias("t").join(
        offsets.alias("o"), _on("t", "o", [*PERIOD_KEYS, "slice"])
    ).select(
        *[F.col(f"t.{k}") for k in [*PERIOD_KEYS, "time_s"]],
        (F.col("idx") + F.col("before")).alias("idx"),
        "n",
    )


def _values(source: DataFrame, names: list[str]) -> Column:
    """The named columns as one array of doubles; a column the table lacks is null."""
    return F.array(*[
        F.col(c).cast("double") if c in source.columns else F.lit(None).cast("double")
        for c in names
    ])


def _frame_vectors(
    source: DataFrame, slots: DataFrame, features: list[str], targets: list[str], max_agents: int
) -> DataFrame:
    """Per (match, period, time): features, targets and mask by slot, absent agents empty.

    Of several rows for an agent at one time the last one counts.
    """
    rows = source.where(F.col("time_s").isNotNull()).select(
        *PERIOD_KEYS, "time_s", "agent_id",
        _values(source, features).alias("x"),
        _values(source, targets).alias("y"),
        F.col("x_m").isNotNull().alias("seen"),
        sort_struct(["frame_id", "x_m", "y_m", "source_file"]).alias("place"),
    )
    held = rows.alias("r").join(
        slots.alias("s"), _on("r", "s", [*PERIOD_KEYS, "agent_id"])
    ).select(*[F.col(f"r.{k}") for k in PERIOD_KEYS], "time_s", "slot", "x", "y", "seen", "place")
    latest = Window.partitionBy(*PERIOD_KEYS, "time_s", "slot").orderBy(F.desc("place"))
    cells = held.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") == 1)
    by_slot = cells.groupBy(*PERIOD_KEYS, "time_s").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("x", "y", "seen"))))
        .alias("held")
    )
    every = F.sequence(F.lit(0), F.lit(max_agents - 1))

    def spread(field: str, absent: Column) -> Column:
        return F.transform(
            every, lambda i: F.coalesce(F.try_element_at(F.col("held"), i)[field], absent)
        ).alias(field)

    def nothing(size: int) -> Column:
        return F.array_repeat(F.lit(None).cast("double"), size)

    return by_slot.select(
        *PERIOD_KEYS, "time_s",
        spread("x", nothing(len(features))),
        spread("y", nothing(len(targets))),
        spread("seen", F.lit(False)),
    )


def _blocks(frames: DataFrame, slots: DataFrame | None, cfg: WindowConfig) -> DataFrame:
    """One row per block of consecutive steps: the block's steps in order, and the agent list.

    A step belongs to the block of its index and to the earlier one whose last windows reach it,
    so a block has fewer than twice ``max(BLOCK_STEPS, steps)`` steps whatever the period length.
    The agent list joins in as one more row per block, which keeps the wide rows out of a join.
    """
    size = max(BLOCK_STEPS, cfg.steps)
    payload = [c for c in frames.columns if c not in [*PERIOD_KEYS, "idx", "n"]]
    usable = frames.where(F.col("n") >= cfg.steps)
    first_block = F.expr(f"greatest(idx - {cfg.steps - 1}, 0L) div {size}")
    last_block = F.least(F.expr(f"idx div {size}"), F.expr(f"(n - {cfg.steps}) div {size}"))
    stepped = usable.select(
        *PERIOD_KEYS, "n", F.struct("idx", *payload).alias("step"),
        F.explode(F.sequence(first_block, last_block)).alias("block"),
    )
    if slots is not None:
        listed = slots.groupBy(*PERIOD_KEYS).agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "agent_id"))).alias("ids")
        )
        ids = F.transform(
            F.sequence(F.lit(0), F.lit(cfg.max_agents - 1)),
            lambda i: F.coalesce(F.try_element_at(F.col("ids"), i), F.lit("")),
        )
        periods = usable.select(*PERIOD_KEYS, "n").distinct()
        lists = periods.alias("p").join(
            listed.alias("l"), _on("p", "l", PERIOD_KEYS), "left"
        ).select(
            *[F.col(f"p.{k}") for k in PERIOD_KEYS], "n", ids.alias("agent_ids"),
            F.explode(F.expr(f"sequence(0L, (n - {cfg.steps}) div {size})")).alias("block"),
        )
        stepped = stepped.unionByName(lists, allowMissingColumns=True)
    extra = [] if slots is None else [F.max("agent_ids").alias("agent_ids")]
    return stepped.groupBy(*PERIOD_KEYS, "block", "n").agg(
        F.sort_array(F.collect_list("step")).alias("steps"), *extra
    ).withColumn("first", F.col("block") * size).withColumn(
        "last", F.least(F.col("first") + (size - 1), F.col("n") - cfg.steps)
    )


def _starts(blocks: DataFrame, cfg: WindowConfig) -> DataFrame:
    """One row per window, with ``offset`` its first step within the block."""
    stride = cfg.stride_steps
    first = F.expr(f"(first + {stride - 1}) div {stride} * {stride}")
    return (
        blocks.withColumn("start", first)
        .withColumn("start", F.explode(F.when(
            F.col("start") <= F.col("last"),
            F.sequence("start", "last", F.lit(stride).cast("bigint")),
        )))
        .withColumn("offset", (F.col("start") - F.col("first")).cast("int"))
    )


def _meta(cfg: WindowConfig) -> list[Column]:
    def time_at(step: int) -> Column:
        return F.get("steps", F.col("offset") + step)["time_s"]

    return [
        *[F.col(k) for k in PERIOD_KEYS],
        time_at(0).alias("start_time_s"),
        time_at(cfg.history_steps - 1).alias("history_end_time_s"),
        time_at(cfg.history_steps).alias("future_start_time_s"),
        time_at(cfg.steps - 1).alias("end_time_s"),
        F.lit(cfg.history_steps).alias("history_steps"),
        F.lit(cfg.future_steps).alias("future_steps"),
        F.lit(float(cfg.fps)).alias("fps"),
    ]


def window_meta(source: DataFrame, cfg: WindowConfig) -> DataFrame:
    """The nine descriptive columns of every window, without its values."""
    return _starts(_blocks(time_index(source), None, cfg), cfg).select(*_meta(cfg))


def build_windows(
    tracking: DataFrame,
    features: DataFrame | None = None,
    cfg: WindowConfig | None = None,
    feature_names: list[str] | None = None,
    target_names: list[str] | None = None,
) -> DataFrame:
    """One row per window of consecutive distinct times within a (match, period).

    x_history and y_future are [step][slot][value] arrays, the masks [step][slot], and agent_ids
    lists the slots, padded with empty strings. With ``features`` that table is the source and
    ``tracking`` is not read. Value names are kept as column metadata.
    """
    cfg = cfg or WindowConfig()
    source = tracking if features is None else features
    feature_names = (
        feature_names
        or [c for c in DEFAULT_FEATURES if c in source.columns]
        or DEFAULT_TARGETS
    )
    target_names = target_names or DEFAULT_TARGETS
    slots = agent_slots(source, cfg.max_agents)
    vectors = _frame_vectors(source, slots, feature_names, target_names, cfg.max_agents)
    frames = time_index(source).alias("t").join(
        vectors.alias("v"), _on("t", "v", [*PERIOD_KEYS, "time_s"]), "left"
    )

    def filled(field: str, absent: Column) -> Column:
        """A time at which no slotted agent has a row is a step of empty slots."""
        return F.coalesce(F.col(field), F.array_repeat(absent, cfg.max_agents)).alias(field)

    def nothing(names: list[str]) -> Column:
        return F.array_repeat(F.lit(None).cast("double"), len(names))

    frames = frames.select(
        *[F.col(f"t.{k}") for k in [*PERIOD_KEYS, "time_s"]], "idx", "n",
        filled("x", nothing(feature_names)),
        filled("y", nothing(target_names)),
        filled("seen", F.lit(False)),
    )
    windows = _starts(_blocks(frames, slots, cfg), cfg)

    def taken(begin: int, length: int, field: str) -> Column:
        part = F.slice("steps", F.col("offset") + (begin + 1), length)
        return F.transform(part, lambda s: s[field])

    h, f = cfg.history_steps, cfg.future_steps
    return windows.select(
        *_meta(cfg),
        "agent_ids",
        taken(0, h, "x").alias("x_history", metadata={"names": list(feature_names)}),
        taken(h, f, "y").alias("y_future", metadata={"names": list(target_names)}),
        taken(0, h, "seen").alias("mask_history"),
        taken(h, f, "seen").alias("mask_future"),
    )


def window_cells(windows: DataFrame) -> DataFrame:
    """Long form of windows: one row per window, step and slot, history steps before future ones.

    ``values`` holds the features in history steps and the targets in future steps.
    """
    keys = [*PERIOD_KEYS, "start_time_s"]

    def long_form(values: str, mask: str, shift: Column) -> DataFrame:
        steps = windows.select(
            *keys, "agent_ids", shift.alias("shift"),
            F.posexplode(F.arrays_zip(F.col(values).alias("values"), F.col(mask).alias("mask"))),
        )
        cells = steps.select(
            *keys, (F.col("shift") + F.col("pos")).alias("step"),
            F.posexplode(F.arrays_zip(
                F.col("agent_ids").alias("agent_id"), F.col("col.values").alias("values"),
                F.col("col.mask").alias("mask"),
            )).alias("slot", "cell"),
        )
        return cells.select(*keys, "step", "slot", "cell.agent_id", "cell.values", "cell.mask")

    return long_form("x_history", "mask_history", F.lit(0)).unionByName(
        long_form("y_future", "mask_future", F.col("history_steps"))
    )
