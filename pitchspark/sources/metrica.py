"""Metrica sample data: wide tracking CSVs with one to three header rows, and event CSVs."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchspark.constants import BALL, METRICA, PLAYER
from pitchspark.functions.casts import coerce, no_nan
from pitchspark.functions.coordinates import to_meters_from_normalized
from pitchspark.functions.labels import bare_name, find_column, sanitize_label, trailing_number
from pitchspark.operators.skew import BROADCAST_ROWS, attach
from pitchspark.schema import TRACKING_SCHEMA, canonical_events, canonical_tracking
from pitchspark.sources.files import file_path, folder, listing, literal, stem
from pitchspark.sources.records import cells as csv_cells, fields, whole_records

# How coordinate columns are named once an entity and its axis are joined.
AXIS_NAME = r"^(.+?)[_\s.-]+([xyXY])$"
# Accepted names of the event columns.
EVENT_NAMES = {
    "period": ["Period"],
    "time_s": ["Start Time [s]", "Start Time", "Time [s]", "Time"],
    "frame_id": ["Start Frame", "Frame"],
    "team_id": ["Team"],
    "player_id": ["From", "Player"],
    "event_type": ["Type"],
    "event_subtype": ["Subtype", "Sub Type"],
    "outcome": ["Outcome"],
    "x_m": ["Start X", "Start_x", "x"],
    "y_m": ["Start Y", "Start_y", "y"],
    "end_x_m": ["End X", "End_x"],
    "end_y_m": ["End Y", "End_y"],
}
MAX_HEADER_ROWS = 3
# What file names say besides the match.
NAME_WORDS = "(?i)raw|tracking|events?|data|home|away|team"
TRACKING_FILES = "*[tT][rR][aA][cC][kK][iI][nN][gG]*.[cC][sS][vV]"
EVENT_FILES = "*[eE][vV][eE][nN][tT]*.[cC][sS][vV]"


def _named(label: Column) -> Column:
    return (label != "") & ~F.lower(label).startswith("unnamed")


def _is_axis(label: Column) -> Column:
    return F.lower(label).isin("x", "y")


def header_columns(lines: DataFrame) -> DataFrame:
    """Flattened column names: one row per (source_file, pos) with ``name``.

    ``lines`` has source_file, line_pos (orders the lines of a file) and value. Header rows are
    the leading lines without a number in their first three cells, down to the last one that names
    the period column or holds axis labels. With an axis row, an axis cell belongs to the last
    entity named before it, and a column of another kind ends that entity's reach. Without one, a
    label followed by an empty cell covers an x and a y column.
    """
    cells = csv_cells(F.col("value"))
    numeric = [F.get(cells, F.lit(i)).try_cast("double").isNotNull() for i in range(3)]
    no_number = ~F.greatest(*[F.coalesce(n, F.lit(False)).cast("int") for n in numeric]).cast(
        "boolean"
    )
    in_order = Window.partitionBy("source_file").orderBy("line_pos")
    leading = (
        lines.where(no_number & (F.btrim("value") != ""))
        .withColumn("rank", F.row_number().over(in_order))
        .where(F.col("rank") <= MAX_HEADER_ROWS)
        .select("source_file", F.struct("line_pos", cells.alias("cells")).alias("row"))
    )

    def marks(row: Column) -> Column:
        return F.exists(row["cells"], lambda c: F.lower(c).startswith("period") | _is_axis(c))

    rows = leading.groupBy("source_file").agg(
        F.sort_array(F.collect_list("row")).alias("rows")
    ).withColumn(
        "last", F.array_max(F.transform("rows", lambda r, i: F.when(marks(r), i)))
    ).where(F.col("last").isNotNull()).select(
        "source_file", F.slice("rows", F.lit(1), F.col("last") + 1).alias("rows")
    )
    rows = rows.select(
        "source_file",
        F.get("rows", F.size("rows") - 1)["line_pos"].alias("header_end"),
        F.exists("rows", lambda r: F.exists(r["cells"], _is_axis)).alias("has_axis"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.array_max(F.transform("rows", lambda r: F.size(r["cells"])))
                           - 1),
                lambda i: F.transform("rows", lambda r: F.coalesce(F.get(r["cells"], i),
                                                                   F.lit(""))),
            )
        ).alias("pos", "levels"),
    )
    along = Window.partitionBy("source_file").orderBy("pos")
    label = F.element_at("levels", -1)
    columns = rows.withColumns({
        "label": label,
        "any_level": F.coalesce(F.get(F.filter("levels", _named), F.lit(0)), F.lit("")),
        "axis": F.lower(F.get(F.filter(F.reverse("levels"), _is_axis), F.lit(0))),
        "upper": F.get(
            F.filter(F.slice("levels", F.lit(1), F.size("levels") - 1), _named), F.lit(0)
        ),
    }).withColumns({
        "reach": F.sum(F.col("axis").isNull().cast("int")).over(along),
        "label_before": F.lag("label").over(along),
        "label_after": F.lead("label").over(along),
    })
    within = Window.partitionBy("source_file", "reach").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    entity = F.last(
        F.when(F.col("axis").isNotNull() & ~_is_axis(F.col("upper")), F.col("upper")), True
    ).over(within)
    flattened = (
        F.when(F.col("axis").isNull(), F.col("any_level"))
        .when(entity.isNull(), F.col("axis"))
        .otherwise(F.concat_ws("_", entity, F.col("axis")))
    )

    def key(c: Column) -> Column:
        return _bare(c).isin("period", "frame", "time", "times")

    spread = (
        F.when((F.col("label") == "") & (F.col("label_before") != "") & ~key(F.col("label_before")),
               F.concat("label_before", F.lit("_y")))
        .when((F.col("label") != "") & (F.col("label_after") == "") & ~key(F.col("label")),
              F.concat("label", F.lit("_x")))
        .otherwise(F.col("label"))
    )
    return columns.select(
        "source_file", "pos", "header_end",
        F.when(F.col("has_axis"), flattened).otherwise(spread).alias("name"),
    )


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def header_map(lines: DataFrame) -> DataFrame:
    """One row per file: where its header ends, the key columns, and the x/y pairs.

    A pair is a prefix named with both axes; the last column of a name counts. Pairs are in the
    order of their columns, and null for a file without any.
    """
    named = header_columns(lines).withColumns({
        "bare": _bare(F.col("name")),
        "prefix": F.when(F.col("name").rlike(AXIS_NAME),
                         F.trim(F.regexp_extract("name", AXIS_NAME, 1))),
        "axis": F.lower(F.regexp_extract("name", AXIS_NAME, 2)),
    })

    def last(condition: Column) -> Column:
        return F.max(F.when(condition, F.col("pos")))

    keys = {k: last(F.col("bare") == k) for k in ("period", "frame", "time", "times")}
    by_prefix = named.groupBy("source_file", "prefix").agg(
        F.max("header_end").alias("header_end"),
        last(F.col("axis") == "x").alias("x_pos"),
        last(F.col("axis") == "y").alias("y_pos"),
        *[c.alias(k) for k, c in keys.items()],
    )
    whole = F.col("prefix").isNotNull() & F.col("x_pos").isNotNull() & F.col("y_pos").isNotNull()
    pairs = F.sort_array(F.collect_list(F.when(whole, F.struct("x_pos", "y_pos", "prefix"))))
    return by_prefix.groupBy("source_file").agg(
        F.max("header_end").alias("header_end"),
        F.max("period").alias("period_pos"),
        F.max("frame").alias("frame_pos"),
        F.coalesce(F.max("times"), F.max("time")).alias("time_pos"),
        F.when(F.size(pairs) > 0, pairs).alias("pairs"),
    )


def _is_ball(prefix: Column) -> Column:
    return F.lower(prefix).contains(BALL)


def _agent_columns(prefix: Column, team: Column) -> dict[str, Column]:
    player = F.concat_ws("_", team, sanitize_label(prefix))

    def pick(ball: Column, other: Column) -> Column:
        return F.when(_is_ball(prefix), ball).otherwise(other)

    none = F.lit(None)
    return {
        "agent_id": pick(F.lit(BALL), player),
        "agent_type": pick(F.lit(BALL), F.lit(PLAYER)),
        "team_id": pick(F.lit(BALL), team),
        "player_id": pick(none, player),
        "jersey_number": pick(none, trailing_number(prefix)),
        "role": pick(F.lit(BALL), F.lit("player")),
    }


def _positions(raw_x: Column, raw_y: Column) -> dict[str, Column]:
    x, y = to_meters_from_normalized(raw_x, raw_y)
    return {
        "x_m": x, "y_m": y, "raw_x": raw_x, "raw_y": raw_y,
        "is_visible": raw_x.isNotNull() & raw_y.isNotNull(),
    }


def _double(c: Column) -> Column:
    return no_nan(c.try_cast("double"))


def _once_in_line(pairs: Column) -> Column:
    """Pairs without those whose agent an earlier pair of the file names."""
    def agent(p: Column) -> Column:
        return F.when(_is_ball(p["prefix"]), BALL).otherwise(
            F.concat(F.lit("_"), sanitize_label(p["prefix"]))
        )

    agents = F.transform(pairs, agent)
    return F.filter(pairs, lambda p, i: F.array_position(agents, agent(p)) == i + 1)


def _first_lines(split: DataFrame) -> DataFrame:
    """Of the lines of one frame, the first of each file; the away one without its ball if the home
    one has a ball. A frame's lines are few, and are gathered before they become a row per agent:
    one shuffle by frame and one sort serve both windows."""
    kinds = {"period": "period", "frame": "frame_id", "time": "time_s"}
    keyed = split.withColumns({
        f"_{k}": F.expr(coerce(k, "string", TRACKING_SCHEMA[name].dataType.simpleString()))
        for k, name in kinds.items()
    })
    frame = ["match_id", *[f"_{k}" for k in kinds]]
    first = F.row_number().over(Window.partitionBy(*frame, "team").orderBy("line_pos"))
    has_ball = F.exists("pairs", lambda p: _is_ball(p["prefix"]))
    other = F.max((F.col("team") == "home") & has_ball).over(Window.partitionBy(*frame))
    kept = keyed.repartition(*frame).withColumn("_first", first).where("_first = 1").withColumn("_other", other)
    return kept.withColumn(
        "pairs",
        F.when((F.col("team") != "home") & F.col("_other"),
               F.filter("pairs", lambda p: ~_is_ball(p["prefix"]))).otherwise(F.col("pairs")),
    )


def tracking_from_lines(lines: DataFrame, few_files: bool, once: bool = False) -> DataFrame:
    """Canonical tracking from raw CSV lines of any number of files, one row per frame and entity.

    ``lines`` has match_id, team, source_file, line_pos and value. Fails on a file whose header
    names no period, frame, time or coordinate columns. ``few_files`` allows broadcasting the
    headers. With ``once``, each agent has one row per match, period, frame and time: that of the
    file's first line, and of the home file for a ball that both files have.
    """
    headers = header_map(lines)
    if once:
        headers = headers.withColumn("pairs", _once_in_line(F.col("pairs")))
    joined = attach(lines, headers, ["source_file"], few_files, F.col("value"))
    usable = F.array(*[
        F.col(c).isNotNull() for c in ("period_pos", "frame_pos", "time_pos", "pairs")
    ])
    pairs = F.when(~F.array_contains(usable, False), F.col("pairs")).otherwise(
        F.raise_error(F.concat(F.lit("cannot read the tracking header of "), "source_file"))
    )
    # Lines of a file without a header must survive, to be reported.
    is_data = F.coalesce(F.col("line_pos") > F.col("header_end"), F.lit(True))
    split = joined.where((F.btrim("value") != "") & is_data).select(
        "match_id", "team", "source_file", "line_pos", "period_pos", "frame_pos", "time_pos",
        pairs.alias("pairs"), fields(F.col("value")).alias("cells"),
    )

    def cell(pos: Column) -> Column:
        return F.btrim(F.get("cells", pos), F.lit(' "'))

    # Each entity takes its two cells before the shuffle and the explode, which then move no whole
    # lines.
    split = split.select(
        "match_id", "team", "source_file", "line_pos",
        *[cell(F.col(f"{k}_pos")).alias(k) for k in ("period", "frame", "time")],
        F.transform("pairs", lambda p: F.struct(
            p["prefix"].alias("prefix"), cell(p["x_pos"]).alias("x"), cell(p["y_pos"]).alias("y")
        )).alias("pairs"),
    )
    if once:
        split = _first_lines(split)
    cells = split.select(
        "match_id", "team", "source_file", "period", "frame", "time", F.explode("pairs").alias("pair")
    )
    raw_x, raw_y = _double(F.col("pair.x")), _double(F.col("pair.y"))
    columns = {
        "match_id": F.col("match_id"),
        "dataset": F.lit(METRICA),
        "period": F.col("period"),
        "frame_id": F.col("frame"),
        "time_s": F.col("time"),
        "source_file": F.col("source_file"),
        **_agent_columns(F.col("pair.prefix"), F.col("team")),
        **_positions(raw_x, raw_y),
    }
    return canonical_tracking(cells.select(*[c.alias(name) for name, c in columns.items()]))


def tracking_from_wide(
    wide: DataFrame, team: str, match_id: str, source_file: str | None = None
) -> DataFrame:
    """Canonical tracking from a table that already has one named column per entity and axis."""
    wide = wide.toDF(*[c.strip() for c in wide.columns])
    names = wide.columns
    period, frame, time = (
        find_column(names, c) for c in (["Period"], ["Frame"], ["Time [s]", "Time", "Time_s"])
    )
    if not (period and frame and time):
        raise ValueError("tracking needs period, frame and time columns")
    positions: dict[str, dict[str, str]] = {}
    for name in names:
        found = re.match(AXIS_NAME, name)
        if found:
            positions.setdefault(found[1].strip(), {})[found[2].lower()] = name
    quoted = {n: "`" + n.replace("`", "``") + "`" for n in names}
    entities = [
        F.struct(
            F.lit(prefix).alias("prefix"),
            _double(F.col(quoted[at["x"]])).alias("x"),
            _double(F.col(quoted[at["y"]])).alias("y"),
        )
        for prefix, at in positions.items() if len(at) == 2
    ]
    if not entities:
        return canonical_tracking(wide.sparkSession.createDataFrame([], "match_id string"))
    long = wide.select(
        *[F.col(quoted[n]).alias(alias)
          for n, alias in [(period, "period"), (frame, "frame_id"), (time, "time_s")]],
        F.explode(F.array(*entities)).alias("entity"),
    )
    columns = {
        "match_id": F.lit(match_id),
        "dataset": F.lit(METRICA),
        "source_file": F.lit(source_file).cast("string"),
        **_agent_columns(F.col("entity.prefix"), F.lit(team)),
        **_positions(F.col("entity.x"), F.col("entity.y")),
    }
    return canonical_tracking(long.select(
        "period", "frame_id", "time_s", *[c.alias(name) for name, c in columns.items()]
    ))


def events_to_canonical(events: DataFrame, match_id: Column) -> DataFrame:
    """Canonical events; columns are found by tolerant names and the whole row is kept as JSON."""
    raw = [c for c in events.columns if not c.startswith("_")]
    at = {k: find_column([c.strip() for c in raw], names) for k, names in EVENT_NAMES.items()}
    by_name = {c.strip(): "`" + c.replace("`", "``") + "`" for c in raw}

    def value(key: str) -> Column:
        return F.col(by_name[at[key]]) if at[key] else F.lit(None)

    columns = {k: value(k) for k in EVENT_NAMES}
    columns["team_id"] = F.lower(columns["team_id"].cast("string"))
    for key in ("x_m", "end_x_m"):
        columns[key], _ = to_meters_from_normalized(_double(columns[key]), F.lit(0.0))
    for key in ("y_m", "end_y_m"):
        _, columns[key] = to_meters_from_normalized(F.lit(0.0), _double(columns[key]))
    whole = F.struct(*[F.col(by_name[c.strip()]).alias(c.strip()) for c in raw])
    return canonical_events(events.select(
        match_id.alias("match_id"),
        F.lit(METRICA).alias("dataset"),
        *[c.alias(name) for name, c in columns.items()],
        F.to_json(whole, {"ignoreNullFields": "false"}).alias("raw_event"),
    ))


def _quoted(text: Column) -> Column:
    array = F.to_json(F.array(text))
    return F.substr(array, F.lit(2), F.length(array) - 2)


def _json_value(cell: Column) -> Column:
    """A cell as JSON: null if empty, a number if it reads as one, else text."""
    text = F.btrim(cell, F.lit(" \r"))
    return (
        F.when(F.coalesce(text, F.lit("")).isin("", "NaN", "nan"), "null")
        .when(text.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), text)
        .otherwise(_quoted(text))
    )


def events_from_lines(lines: DataFrame, few_files: bool) -> DataFrame:
    """Canonical events from raw CSV lines of any number of files, each with its own header.

    ``lines`` has match_id, source_file, line_pos and value. A file's first line that isn't empty
    names its columns, found by tolerant names; the whole row is kept as JSON, in which a cell is
    a number or text by its own content.
    """
    lines = lines.where(F.btrim("value") != "")
    headers = lines.groupBy("source_file").agg(
        F.min("line_pos").alias("header_pos"), csv_cells(F.min_by("value", "line_pos")).alias("names")
    )
    bare = F.transform("names", _bare)
    last = F.size("names")

    def position(candidates: list[str]) -> Column:
        # The last column of a name counts.
        return F.coalesce(*[
            F.when(F.array_contains(bare, bare_name(c)),
                   last - F.array_position(F.reverse(bare), bare_name(c)))
            for c in candidates
        ])

    headers = headers.withColumns({f"{k}_pos": position(c) for k, c in EVENT_NAMES.items()})
    joined = attach(lines, headers, ["source_file"], few_files, F.col("value"))
    rows = joined.where(F.col("line_pos") > F.col("header_pos")).withColumn(
        "cells", fields(F.col("value"))
    )

    def value(key: str) -> Column:
        text = F.btrim(F.get("cells", F.col(f"{key}_pos")), F.lit(" \r"))
        return F.when(~text.isin("", "NaN", "nan"), text)

    columns = {k: value(k) for k in EVENT_NAMES}
    columns["team_id"] = F.lower(columns["team_id"])
    for key in ("x_m", "end_x_m"):
        columns[key], _ = to_meters_from_normalized(_double(columns[key]), F.lit(0.0))
    for key in ("y_m", "end_y_m"):
        _, columns[key] = to_meters_from_normalized(F.lit(0.0), _double(columns[key]))
    named = F.transform("names", lambda name, i: F.concat(
        _quoted(name), F.lit(":"), _json_value(F.get("cells", i))
    ))
    return canonical_events(rows.select(
        "match_id",
        F.lit(METRICA).alias("dataset"),
        *[c.alias(name) for name, c in columns.items()],
        F.concat(F.lit("{"), F.array_join(named, ","), F.lit("}")).alias("raw_event"),
    ))


def discover(
    spark: SparkSession, raw_dir: str, match_id: str | None = None
) -> tuple[DataFrame, dict[str, int]] | None:
    """source_file, role (home, away or events) and match_id of every file of a match below
    ``raw_dir``, and how many files and matches there are; None if there are no files.

    A match is a directory, or, where a directory's file names have different parts besides the
    role, each such part. It is named by the part, or else by the directory; equal names of
    different directories are told apart by their paths below ``raw_dir``. ``match_id`` chooses the
    match of that name or directory; a single match of another name takes it. Two files of one role
    in one match fail, and so does a ``match_id`` that fits no match or several.
    """
    found = listing(spark, raw_dir, "*.[cC][sS][vV]")
    if found is None:
        return None
    path, name = F.col("source_file"), F.lower(F.regexp_extract("source_file", "[^/]+$", 0))
    role = (
        F.when(name.contains("tracking") & name.contains("home"), "home")
        .when(name.contains("tracking") & name.contains("away"), "away")
        .when(name.contains("event"), "events")
    )
    part = F.btrim(
        F.regexp_replace(F.regexp_replace(stem(path), NAME_WORDS, ""), r"[_\s.-]+", "_"), F.lit("_")
    )
    files = found.select(
        "source_file", role.alias("role"), folder(path).alias("folder"), part.alias("part")
    ).where(F.col("role").isNotNull())
    counts = files.groupBy("folder", "part").agg(
        *[F.count_if(F.col("role") == r).alias(r) for r in ("home", "away", "events")]
    )
    directory = F.regexp_extract("folder", "[^/]*$", 0)
    below = F.substring_index("folder", str(raw_dir).strip("/") + "/", -1)
    several = F.count("*").over(Window.partitionBy("folder")) > 1
    own = F.when(several & (F.col("part") != ""), F.col("part")).otherwise(directory)
    longer = F.when(several & (F.col("part") != ""), F.concat_ws("/", below, "part")).otherwise(below)
    matches = counts.withColumns({"own": own, "longer": longer, "directory": directory})
    clash = F.count("*").over(Window.partitionBy("own")) > 1
    matches = matches.withColumn("match", F.when(clash, F.col("longer")).otherwise(F.col("own")))
    if match_id is not None:
        if matches.limit(2).count() > 1:
            matches = matches.where(F.array_contains(F.array("match", "own", "directory"), match_id))
    twice = F.greatest("home", "away", "events") > 1
    summary = matches.agg(
        F.count("*").alias("matches"),
        F.sum(F.col("home") + F.col("away") + F.col("events")).alias("files"),
        *[F.count_if(F.col(r) == 0).alias(f"no_{r}") for r in ("home", "away", "events")],
        F.min(F.when(twice, F.concat_ws("/", "folder", "part"))).alias("twice"),
        F.concat_ws(", ", F.min("longer"), F.max("longer")).alias("some"),
    ).first().asDict()
    if match_id is not None and summary["matches"] != 1:
        those = f": {summary['some']}" if summary["matches"] else ""
        raise ValueError(
            f"{summary['matches']} Metrica matches below {raw_dir} fit the match id {match_id}{those}"
        )
    if not summary["matches"]:
        return None
    if summary["twice"]:
        raise ValueError(f"a Metrica match has two files of one role: {summary['twice']}")
    label = F.col("match") if match_id is None else F.lit(match_id)
    named = matches.select("folder", "part", label.alias("match_id"))
    return files.join(named, ["folder", "part"]).select("source_file", "role", "match_id"), summary


def match_files(spark: SparkSession, raw_dir: str) -> DataFrame | None:
    """source_file and match_id of every file below ``raw_dir``; None if there are none."""
    found = discover(spark, raw_dir)
    return found and found[0].select("source_file", "match_id")


def _lines(
    spark: SparkSession, raw_dir: str, pattern: str, files: DataFrame, count: int, only: list[str] | None
) -> tuple[DataFrame, bool]:
    """The records of some files with match_id, team, source_file and line_pos, and whether the files
    are few; records that hold line breaks in quoted cells are put together."""
    reader, paths = spark.read, str(raw_dir)
    if only is None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    else:
        files, paths = files.where(F.col("source_file").isin(only)), [literal(p) for p in only]
        count = len(only)
    few = count <= BROADCAST_ROWS
    lines = reader.text(paths).select(
        "value",
        file_path().alias("source_file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_pos"),
    )
    lines = attach(lines, files.withColumnRenamed("role", "team"), ["source_file"], few, F.col("value"),
                   how="inner")
    return whole_records(lines, F.col("line_pos.block")), few


def read_tracking(
    spark: SparkSession, raw_dir: str, match_id: str | None = None, only: list[str] | None = None
) -> DataFrame:
    """Tracking of every match below ``raw_dir``, or of one, read in one job; see ``discover``.
    ``only`` names the source files to read, all others are just listed."""
    found = discover(spark, raw_dir, match_id)
    if found is None or found[1]["no_home"] == found[1]["no_away"] == found[1]["matches"]:
        raise FileNotFoundError(f"no Metrica tracking CSVs below {raw_dir}")
    files, summary = found
    for role in ("home", "away"):
        if summary[f"no_{role}"]:
            warnings.warn(
                f"{summary[f'no_{role}']} of {summary['matches']} Metrica matches below {raw_dir} "
                f"have no {role} tracking file", stacklevel=2,
            )
    files = files.where("role <> 'events'")
    lines, few = _lines(spark, raw_dir, TRACKING_FILES, files, summary["files"], only)
    return tracking_from_lines(lines, few_files=few, once=True)


def read_events(
    spark: SparkSession, raw_dir: str, match_id: str | None = None, only: list[str] | None = None
) -> DataFrame:
    """Events of every match below ``raw_dir``, or of one; no rows when there are no event files."""
    found = discover(spark, raw_dir, match_id)
    if found is None or found[1]["no_events"]:
        warnings.warn(f"Metrica matches below {raw_dir} have no event file", stacklevel=2)
    if found is None:
        return canonical_events(spark.createDataFrame([], "match_id string"))
    files, summary = found
    files = files.where("role = 'events'")
    return events_from_lines(*_lines(spark, raw_dir, EVENT_FILES, files, summary["files"], only))
