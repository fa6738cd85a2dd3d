"""SkillCorner open data: one JSON object per frame, positions around the centre spot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchspark.constants import BALL, PLAYER, SKILLCORNER
from pitchspark.functions.casts import no_nan
from pitchspark.functions.coordinates import center_to_top_left
from pitchspark.schema import canonical_events, canonical_tracking
from pitchspark.sources.files import file_path, folder, listing, literal, parent_name, stem

# Objects are read as maps: whether a key is absent or null decides visibility and ball rows.
PATTERN = "*tracking*.jsonl"
FRAME_SCHEMA = (
    "frame string, timestamp string, period string, "
    "ball_data map<string,string>, player_data array<map<string,string>>"
)


def _clock_seconds(text: Column) -> Column:
    """``h:m:s.f`` as seconds."""
    parts = F.split(text, ":")
    return F.when(
        F.size(parts) == 3,
        F.get(parts, F.lit(0)).try_cast("double") * 3600.0
        + F.get(parts, F.lit(1)).try_cast("double") * 60.0
        + F.get(parts, F.lit(2)).try_cast("double"),
    )


def frames_to_tracking(
    frames: DataFrame, match_id: Column, source_file: Column, clock_times: bool = False
) -> DataFrame:
    """Canonical tracking: a ball row for each non-empty ball object, and a row per player.

    Timestamps that are not numbers become null, unless ``clock_times`` reads h:m:s text.
    """
    ball = F.when(
        F.size("ball_data") > 0, F.array(F.struct(F.lit(True).alias("ball"),
                                                  F.col("ball_data").alias("data")))
    )
    players = F.transform(
        F.coalesce("player_data", F.array().cast("array<map<string,string>>")),
        lambda p: F.struct(F.lit(False).alias("ball"), p.alias("data")),
    )
    none = F.array().cast("array<struct<ball:boolean,data:map<string,string>>>")
    time = F.col("timestamp").try_cast("double")
    if clock_times:
        time = F.coalesce(time, _clock_seconds(F.col("timestamp")))
    rows = frames.select(
        "frame", "period", time.alias("time_s"),
        match_id.alias("match_id"), source_file.alias("source_file"),
        F.explode(F.concat(F.coalesce(ball, none), players)).alias("entry"),
    )
    is_ball = F.col("entry.ball")

    def field(name: str) -> Column:
        return F.try_element_at("entry.data", F.lit(name))

    def for_player(c: Column, ball_value: Column | None = None) -> Column:
        return F.when(~is_ball, c).otherwise(F.lit(None) if ball_value is None else ball_value)

    x, y = center_to_top_left(
        no_nan(field("x").try_cast("double")), no_nan(field("y").try_cast("double"))
    )
    seen = F.when(
        F.map_contains_key("entry.data", "is_detected"), field("is_detected").try_cast("boolean")
    ).otherwise(True)
    side = F.coalesce(F.nullif(field("group"), F.lit("")), F.nullif(field("team"), F.lit("")))
    return canonical_tracking(rows.select(
        "match_id",
        F.lit(SKILLCORNER).alias("dataset"),
        "period",
        F.col("frame").alias("frame_id"),
        "time_s",
        for_player(field("player_id"), F.lit(BALL)).alias("agent_id"),
        F.when(is_ball, BALL).otherwise(PLAYER).alias("agent_type"),
        for_player(side, F.lit(BALL)).alias("team_id"),
        for_player(field("player_id")).alias("player_id"),
        for_player(field("number")).alias("jersey_number"),
        F.when(is_ball, BALL).otherwise("player").alias("role"),
        x.alias("x_m"),
        y.alias("y_m"),
        field("x").alias("raw_x"),
        field("y").alias("raw_y"),
        seen.alias("is_visible"),
        "source_file",
    ))


def _own_match(path: Column) -> Column:
    own_name = F.regexp_extract(stem(path), "^(.+?)_tracking", 1)
    return F.when(own_name != "", own_name).otherwise(parent_name(path))


def match_files(spark: SparkSession, raw_dir: str) -> DataFrame | None:
    """source_file and match_id of every file below ``raw_dir``; None if there is no such directory."""
    found = listing(spark, raw_dir, PATTERN)
    return found and found.select("source_file", _own_match(F.col("source_file")).alias("match_id"))


def read_tracking(
    spark: SparkSession,
    raw_dir: str,
    match_id: str | None = None,
    clock_times: bool = False,
    only: list[str] | None = None,
) -> DataFrame:
    """Tracking from ``*tracking*.jsonl`` files, each under the part of its name before
    ``_tracking``, or else its directory.

    ``match_id`` chooses the files of that name or directory; if there is one match only, of
    another name, it takes the given one. Without a match that fits, or with such files in several
    directories, it fails. ``only`` names the source files to read, all others are just listed.
    """
    found = listing(spark, raw_dir, PATTERN)
    if found is None or found.isEmpty():
        raise FileNotFoundError(f"no SkillCorner tracking JSONL files below {raw_dir}")
    path = F.col("_path")
    reader = spark.read.schema(FRAME_SCHEMA).option("mode", "FAILFAST")
    if only is None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN)
    frames = reader.json(str(raw_dir) if only is None else [literal(p) for p in only]).select(
        "*", file_path().alias("_path")
    )
    if match_id is None:
        return frames_to_tracking(frames, _own_match(path), path, clock_times)

    def fits(c: Column) -> Column:
        return (_own_match(c) == match_id) | (parent_name(c) == match_id)

    source = F.col("source_file")
    places = found.select(_own_match(source).alias("match"), folder(source).alias("folder"),
                          fits(source).alias("fits")).distinct()
    chosen, others = (places.where(c).limit(2).collect() for c in ("fits", "not fits"))
    if len(chosen) > 1 or not chosen and len(others) > 1:
        raise ValueError(
            f"{'several' if chosen else 'no'} SkillCorner matches below {raw_dir} fit the match id "
            f"{match_id}: there are {', '.join(r.folder + '/' + r.match for r in chosen or others)}"
        )
    if chosen:
        frames = frames.where(fits(path))
    return frames_to_tracking(frames, F.lit(match_id), path, clock_times)


def read_events(
    spark: SparkSession, raw_dir: str, match_id: str | None = None, only: list[str] | None = None
) -> DataFrame:
    """This provider's events are not read: no rows."""
    return canonical_events(spark.createDataFrame([], "match_id string"))
