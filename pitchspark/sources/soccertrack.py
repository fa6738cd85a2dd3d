"""SoccerTrack: annotations that already are in pitch metres.

Files come in two shapes. A tree has a header row for each level (teams, players, attributes), named
in its first cell, and a row per frame with the cells of all players. A flat file has one header
row and a row per frame and player, whose columns are mapped by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchspark.constants import BALL, PLAYER, SOCCERTRACK
from pitchspark.functions.labels import sanitize_label, trailing_number
from pitchspark.operators.skew import BROADCAST_ROWS, attach
from pitchspark.schema import canonical_tracking
from pitchspark.sources.files import file_path, listing, literal, stem
from pitchspark.sources.records import cells, fields, whole_records

# Annotation column to canonical column.
NAMES = {
    "image_id": "frame_id",
    "track_id": "agent_id",
    "team_side": "team_id",
    "x": "x_m",
    "y": "y_m",
}
# First cells of the header rows of a tree.
LEVELS = {"teams": "teamid", "players": "playerid", "attributes": "attributes"}
# Frames a second where a file has no times.
FPS = 25.0
FILES = "*.[cC][sS][vV]"
# What a line gives for each player, in either shape.
_ROW = ["period", "frame_id", "time_s", "agent_id", "agent_type", "team_id", "player_id",
        "jersey_number", "role", "x_m", "y_m", "z_m"]


def annotations_to_tracking(annotations: DataFrame, match_id: Column) -> DataFrame:
    """Rename the annotation columns; player, role, jersey and other columns pass through."""
    renamed = annotations.withColumnsRenamed({k: v for k, v in NAMES.items()})
    return canonical_tracking(
        renamed.withColumns({"match_id": match_id, "dataset": F.lit(SOCCERTRACK)})
    )


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _inherited(level: Column, pos: Column) -> Column:
    """The label at a position, or else the last one before it; the first cell names the level."""
    return F.element_at(F.filter(F.slice(level, F.lit(2), pos), lambda c: c != ""), -1)


def header_tree(lines: DataFrame) -> DataFrame:
    """One row per file: header_end (the last header line), entities (of a tree: team, player and the
    positions of x, y and z, in the order of columns; null for other files), and names (the cells of
    the file's first line, simplified).

    Each level is the first line that its name begins; an empty cell belongs to the last label
    before it. Only players with an x and a y count; the last column of a name does.
    """
    lines = lines.where(F.btrim("value") != "")
    first = _bare(F.substring_index("value", ",", 1))

    def line_of(name: str) -> Column:
        return F.min_by("value", F.when(first == name, F.col("line_pos")))

    is_level = first.isin(*LEVELS.values())
    by_file = lines.groupBy("source_file").agg(
        *[cells(line_of(name)).alias(level) for level, name in LEVELS.items()],
        *[F.count_if(first == name).alias(f"has_{level}") for level, name in LEVELS.items()],
        F.max(F.when(is_level, F.col("line_pos"))).alias("levels_end"),
        F.min("line_pos").alias("first_pos"),
        F.transform(cells(F.min_by("value", "line_pos")), _bare).alias("names"),
    )
    whole = (F.col("has_teams") > 0) & (F.col("has_players") > 0) & (F.col("has_attributes") > 0)
    columns = by_file.where(whole).select(
        "source_file", "teams", "players", F.posexplode("attributes").alias("pos", "attribute")
    ).where("pos > 0").select(
        "source_file", "pos", F.lower("attribute").alias("attribute"),
        _inherited(F.col("teams"), F.col("pos")).alias("team"),
        _inherited(F.col("players"), F.col("pos")).alias("player"),
    )
    players = columns.groupBy("source_file", "team", "player").agg(
        F.min("pos").alias("pos"),
        *[F.max(F.when(F.col("attribute") == a, F.col("pos"))).alias(a) for a in ("x", "y", "z")],
    ).where("x IS NOT NULL AND y IS NOT NULL")
    entities = players.groupBy("source_file").agg(
        F.sort_array(F.collect_list(F.struct("pos", "team", "player", "x", "y", "z"))).alias("entities")
    )
    is_tree = F.col("entities").isNotNull()
    return by_file.join(entities, "source_file", "left").select(
        "source_file",
        F.when(is_tree, F.col("levels_end")).otherwise(F.col("first_pos")).alias("header_end"),
        "entities",
        F.when(~is_tree, F.col("names")).alias("names"),
    )


def tracking_from_lines(lines: DataFrame, few_files: bool, fps: float = FPS) -> DataFrame:
    """Canonical tracking from raw CSV lines of any number of files, of either shape.

    ``lines`` has match_id, source_file, line_pos and value. A tree gives a row per player of its
    header and line that begins with a number, the frame; there is no position where the cells are
    empty. Team and player make the agent, and whatever either calls a ball is the ball. Files
    without periods have one; times are those of the file, or frames by ``fps``. Fails on a file of
    another shape.
    """
    headers = header_tree(lines)
    joined = attach(lines, headers, ["source_file"], few_files, F.col("value"))
    rows = joined.where(
        (F.btrim("value") != "") & F.coalesce(F.col("line_pos") > F.col("header_end"), F.lit(True))
    ).withColumn("cells", fields(F.col("value"))).where(
        F.col("entities").isNull() | F.get("cells", F.lit(0)).try_cast("double").isNotNull()
    )

    def cell(pos: Column) -> Column:
        text = F.btrim(F.get("cells", pos), F.lit(' "\r'))
        return F.when(~F.lower(text).isin("", "nan", "none", "null"), text)

    none = F.lit(None).cast("string")

    def row(**given: Column) -> Column:
        return F.struct(*[given.get(c, none).cast("string").alias(c) for c in _ROW])

    def is_ball(*labels: Column) -> Column:
        return F.coalesce(F.lower(F.concat_ws(" ", *labels)).contains(BALL), F.lit(False))

    def of_player(p: Column) -> Column:
        ball, label = is_ball(p["team"], p["player"]), F.concat_ws("_", p["team"], p["player"])
        agent = F.when(ball, BALL).otherwise(sanitize_label(label))
        return row(
            frame_id=cell(F.lit(0)), agent_id=agent, agent_type=F.when(ball, BALL).otherwise(PLAYER),
            team_id=F.when(ball, BALL).otherwise(p["team"]), player_id=F.when(~ball, agent),
            jersey_number=F.when(~ball, trailing_number(p["player"])),
            role=F.when(ball, BALL).otherwise("player"),
            x_m=cell(p["x"]), y_m=cell(p["y"]), z_m=cell(p["z"]),
        )

    def named(name: str) -> Column:
        place = F.array_position(F.reverse("names"), name.replace("_", ""))
        return cell(F.when(place > 0, F.size("names") - place))

    given = {c: named(c) for c in _ROW} | {
        to: F.coalesce(named(name), named(to)) for name, to in NAMES.items()
    }
    ball = is_ball(given["agent_id"], given["team_id"])
    given["agent_type"] = F.coalesce(given["agent_type"], F.when(ball, BALL).otherwise(PLAYER))
    has = [F.array_contains("names", n.replace("_", "")) for n in ("image_id", "track_id", "x", "y")]
    flat = F.coalesce(has[0] & has[1] & has[2] & has[3], F.lit(False))
    found = (
        F.when(F.col("entities").isNotNull(), F.transform("entities", of_player))
        .when(flat, F.array(row(**given)))
        .otherwise(F.raise_error(F.concat(F.lit("cannot read the annotation header of "), "source_file")))
    )
    out = rows.select("match_id", "source_file", F.explode(found).alias("row")).select(
        "match_id", F.lit(SOCCERTRACK).alias("dataset"), "source_file", "row.*"
    )
    time = F.coalesce(F.col("time_s").try_cast("double"), F.col("frame_id").try_cast("double") / fps)
    x, y = (F.col(c).try_cast("double") for c in ("x_m", "y_m"))
    return canonical_tracking(out.withColumns({
        "period": F.coalesce("period", F.lit("1")),
        "time_s": time,
        "is_visible": x.isNotNull() & y.isNotNull(),
    }))


def match_files(spark: SparkSession, raw_dir: str) -> DataFrame | None:
    """source_file and match_id of every file below ``raw_dir``; None if there is no such directory."""
    found = listing(spark, raw_dir, FILES)
    return found and found.select("source_file", stem(F.col("source_file")).alias("match_id"))


def read_tracking(
    spark: SparkSession,
    raw_dir: str,
    match_id: str | None = None,
    fps: float = FPS,
    only: list[str] | None = None,
) -> DataFrame:
    """Tracking of every CSV file below ``raw_dir``, each a match named by its file, or of one.

    Files of one name in several directories are one match. ``match_id`` chooses the match of that
    name; a single match of another name takes it, and what fits none of several fails. ``only``
    names the source files to read, all others are just listed.
    """
    files = match_files(spark, raw_dir)
    counts = files and files.agg(F.count("*"), F.count_distinct("match_id"), F.max(
        F.when(F.col("match_id") == match_id, 1) if match_id is not None else F.lit(0)
    )).first()
    if not counts or not counts[0]:
        raise FileNotFoundError(f"no SoccerTrack CSVs below {raw_dir}")
    if match_id is not None:
        if counts[2]:
            files = files.where(F.col("match_id") == match_id)
        elif counts[1] == 1:
            files = files.withColumn("match_id", F.lit(match_id))
        else:
            raise ValueError(f"none of {counts[1]} SoccerTrack matches below {raw_dir} is {match_id}")
    few = (counts[0] if only is None else len(only)) <= BROADCAST_ROWS
    if only is None:
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", FILES).text(str(raw_dir))
    else:
        files = files.where(F.col("source_file").isin(only))
        raw = spark.read.text([literal(p) for p in only])
    lines = raw.select(
        "value",
        file_path().alias("source_file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_pos"),
    )
    lines = attach(lines, files, ["source_file"], few, F.col("value"), how="inner")
    return tracking_from_lines(whole_records(lines, F.col("line_pos.block")), few, fps)
