"""One query per operator over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixture import events_table, tracking_table
from pitchspark import schema
from pitchspark.constants import FRAME_KEYS
from pitchspark.functions import coordinates
from pitchspark.operators import clips, frames, kinematics, pitch, quality, resample, rollout
from pitchspark.operators import windows as win
from pitchspark.operators.skew import shared_folder
from pitchspark.plans.features import compute_features
from pitchspark.sources import metrica, records, skillcorner, soccertrack, statsbomb, tables
from pitchspark.streaming import live

ROW = ["match_id", "period", "frame_id", "time_s", "agent_id"]
WINDOWS = win.WindowConfig(history_s=0.5, future_s=0.5, fps=10.0, max_agents=23)
WINDOW_FEATURES = ["x_m", "y_m", "raw_x"]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zero."""
    return df.selectExpr(*[
        f"CASE WHEN round({name}, 6) = 0 THEN 0D ELSE round({name}, 6) END AS {name}"
        if dtype == "double" else name
        for name, dtype in df.dtypes
    ])


def canonical_tracking(spark, sf):
    raw = tracking_table(spark, sf).withColumns({
        "x_m": F.coalesce(F.col("x_m").cast("string"), F.lit("n/a")),
        "y_m": F.coalesce("y_m", F.lit(float("nan"))),
        "frame_id": F.concat(F.col("frame_id"), F.when(F.col("jersey_number") == 5, ".5")
                             .otherwise("")),
        "jersey_number": F.col("jersey_number").cast("double"),
        "extra": F.upper("agent_id"),
    }).drop("z_m", "role")
    return schema.canonical_tracking(raw)


def canonical_events(spark, sf):
    # Whole seconds only: the fractions are cut on both sides.
    raw = events_table(spark, sf).select(
        F.concat(F.lit("u"), F.col("user_id") % 5).alias("match_id"),
        F.lit("synthetic").alias("dataset"),
        F.lit("1").alias("period"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("string")
        .alias("time_s"),
        "event_type",
        F.when(F.col("event_type") == "error", "none")
        .otherwise((F.col("value") % 110.0).cast("string")).alias("x_m"),
        ((F.col("value") * 3.0) % 70.0).alias("y_m"),
        F.col("props").alias("raw_event"),
    )
    return schema.canonical_events(raw)


def _with_odd_types(spark, sf):
    odd = (F.col("team_id") == "away") & (F.col("jersey_number") == 4)
    return tracking_table(spark, sf).withColumn(
        "agent_type", F.when(odd, F.concat(F.lit("x_"), "match_id")).otherwise(F.col("agent_type"))
    )


def schema_invalid_types(spark, sf):
    return schema.validate_tracking_schema(_with_odd_types(spark, sf)).invalid_agent_types


def schema_validation(spark, sf):
    checked = schema.validate_tracking_schema(_with_odd_types(spark, sf).drop("z_m", "role"))
    return checked.summary.select(
        "ok", F.array_join("missing_columns", ",").alias("missing_columns"), "invalid_agent_types"
    )


def normalized_to_meters(spark, sf):
    x, y = coordinates.to_meters_from_normalized(F.col("raw_x"), F.col("raw_y"))
    return tracking_table(spark, sf).select(*ROW, x.alias("x_m"), y.alias("y_m"))


def center_to_topleft(spark, sf):
    t = tracking_table(spark, sf).withColumn("y_m", F.when(F.col("x_m") < 90, F.col("y_m")))
    x, y = coordinates.center_to_top_left(F.col("x_m"), F.col("y_m"))
    return t.select(*ROW, x.alias("x_m"), y.alias("y_m"))


def grid120_to_meters(spark, sf):
    place = F.when(F.col("x_m") > 100, F.array("x_m")).when(
        F.col("x_m").isNotNull(), F.array("x_m", "y_m", "raw_x")
    )
    x, y = coordinates.grid_to_meters(place)
    return tracking_table(spark, sf).select(*ROW, x.alias("x_m"), y.alias("y_m"))


def clip_to_pitch(spark, sf):
    return pitch.clip_to_pitch(tracking_table(spark, sf)).select(*ROW, "x_m", "y_m")


def flip_pitch(spark, sf):
    moving = kinematics.add_kinematics(tracking_table(spark, sf))
    return pitch.flip_left_to_right(moving).select(*ROW, "x_m", "y_m", "vx_mps", "vy_mps")


def out_of_bounds_rows(spark, sf):
    return pitch.out_of_bounds_rows(tracking_table(spark, sf))


def bounds_summary(spark, sf):
    return pitch.validate_pitch_bounds(tracking_table(spark, sf)).select("ok", "out_of_bounds_rows")


def velocity(spark, sf):
    return kinematics.add_kinematics(tracking_table(spark, sf)).select(*ROW, "vx_mps", "vy_mps")


def velocity_split(spark, sf):
    """As velocity, with every series in slices of some rows."""
    return kinematics.add_kinematics(tracking_table(spark, sf), 0, 400).select(
        *ROW, "vx_mps", "vy_mps"
    )


def acceleration(spark, sf):
    return kinematics.add_kinematics(tracking_table(spark, sf)).select(*ROW, "ax_mps2", "ay_mps2")


def speed(spark, sf):
    return kinematics.add_kinematics(tracking_table(spark, sf)).select(
        *ROW, "speed_mps", "accel_mps2"
    )


def distance_to_ball(spark, sf):
    return frames.add_distance_to_ball(tracking_table(spark, sf)).select(
        *ROW, "distance_to_ball_m"
    )


def team_shape(spark, sf):
    return frames.team_shape(tracking_table(spark, sf))


def team_shape_attached(spark, sf):
    return frames.add_frame_features(tracking_table(spark, sf), frames.TEAM_SHAPE).select(
        *ROW, *frames.TEAM_SHAPE
    )


def nearest_players(spark, sf):
    return frames.add_frame_features(tracking_table(spark, sf), frames.NEAREST).select(
        *ROW, *frames.NEAREST
    )


def nearest_players_split(spark, sf):
    """As nearest_players, with every frame on the plan for large ones."""
    return frames.add_frame_features(tracking_table(spark, sf), frames.NEAREST, 0).select(
        *ROW, *frames.NEAREST
    )


def all_features(spark, sf):
    return compute_features(tracking_table(spark, sf))


def average_speed_and_ball_distance(spark, sf):
    return compute_features(tracking_table(spark, sf)).groupBy("match_id", "agent_id").agg(
        F.count("*").alias("rows"),
        F.avg("speed_mps").alias("mean_speed_mps"),
        F.avg("distance_to_ball_m").alias("mean_distance_to_ball_m"),
    )


def frame_monotonicity(spark, sf):
    late = (F.col("jersey_number") == 9) & (F.col("frame_id") % 10 == 0)
    swapped = tracking_table(spark, sf).withColumn(
        "frame_id", F.col("frame_id") - F.when(late, 3).otherwise(0)
    )
    return quality.frame_monotonicity(swapped)


def impossible_speeds(spark, sf):
    return quality.check_quality(tracking_table(spark, sf)).impossible_speeds


def missingness(spark, sf):
    return quality.missingness_by_agent(tracking_table(spark, sf))


def quality_summary(spark, sf):
    return quality.check_quality(tracking_table(spark, sf)).summary


def time_extents(spark, sf):
    return resample.time_extents(tracking_table(spark, sf))


def _resampled(spark, sf):
    return resample.resample_tracking(tracking_table(spark, sf), target_fps=10.0, max_gap_s=0.2)


def resample_grid(spark, sf):
    return _resampled(spark, sf).select(*ROW)


def resample_interpolated(spark, sf):
    return _resampled(spark, sf).select(
        *ROW, "x_m", "y_m", "z_m", "raw_x", "x_m_was_missing", "raw_y_was_missing"
    )


def resample_split(spark, sf):
    """As resample_interpolated, with every series in slices of some samples."""
    return resample.resample_tracking(tracking_table(spark, sf), 10.0, 0.2, 0, 400).select(
        *ROW, "x_m", "y_m", "z_m", "raw_x", "x_m_was_missing", "raw_y_was_missing"
    )


def resample_heights(spark, sf):
    """Heights, which the table lacks, from its y."""
    t = tracking_table(spark, sf).withColumn("z_m", F.col("y_m"))
    return resample.resample_tracking(t, target_fps=10.0, max_gap_s=0.2).select(
        *ROW, "z_m", "z_m_was_missing"
    )


def resample_filled(spark, sf):
    return _resampled(spark, sf).select(
        *ROW, "team_id", "jersey_number", "role", "is_visible", "source_file"
    )


def agent_slots(spark, sf):
    return win.agent_slots(tracking_table(spark, sf), 18)


def time_index(spark, sf):
    return win.time_index(tracking_table(spark, sf))


def window_meta(spark, sf):
    return win.window_meta(tracking_table(spark, sf), WINDOWS)


def _windows(spark, sf):
    return win.build_windows(
        tracking_table(spark, sf), cfg=WINDOWS, feature_names=WINDOW_FEATURES
    )


def window_cells(spark, sf):
    return win.window_cells(_windows(spark, sf)).select(
        "match_id", "period", "start_time_s", "step", "slot", "agent_id",
        F.get("values", F.lit(0)).alias("value_0"), F.get("values", F.lit(1)).alias("value_1"),
        F.get("values", F.lit(2)).alias("value_2"), "mask",
    )


def window_tensors(spark, sf):
    def total(tensor, value):
        return F.aggregate(
            F.flatten(tensor), F.lit(0.0),
            lambda acc, v: acc + F.coalesce(F.get(v, F.lit(value)), F.lit(0.0)),
        )

    def seen(mask):
        return F.size(F.filter(F.flatten(mask), lambda m: m))

    return _windows(spark, sf).select(
        "match_id", "period", "start_time_s", "end_time_s",
        F.size("x_history").alias("history_steps"),
        F.size(F.get("x_history", F.lit(0))).alias("slots"),
        F.size(F.filter("agent_ids", lambda a: a != "")).alias("agents"),
        seen("mask_history").alias("seen_history"),
        seen("mask_future").alias("seen_future"),
        total("x_history", 0).alias("sum_history_x"),
        total("y_future", 1).alias("sum_future_y"),
    )


def constant_velocity_rollout(spark, sf):
    moving = kinematics.add_kinematics(tracking_table(spark, sf))
    return rollout.constant_velocity_rollout(moving, 5, 0.1).select(
        *ROW, "step", "pred_x_m", "pred_y_m"
    )


def clip_rows(spark, sf):
    return clips.clip_rows(tracking_table(spark, sf), 2.0, 4.5).select(*ROW, "x_m", "y_m")


def clip_rows_clustered(spark, sf):
    """As clip_rows, from a table on storage that is clustered by time and place."""
    path = f"{shared_folder(spark)}/clustered-{uuid.uuid4().hex}"
    tables.write_table(tracking_table(spark, sf), path, clustered=True)
    return clips.clip_rows(tables.read_tracking(spark, path), 2.0, 4.5).select(*ROW, "x_m", "y_m")


def clip_frames(spark, sf):
    return clips.clip_frames(clips.clip_rows(tracking_table(spark, sf), 2.0, 4.5))


def agent_trails(spark, sf):
    return clips.agent_trails(clips.clip_rows(tracking_table(spark, sf), 0.0, 30.0), 0.5)


def agent_trail_slices(spark, sf):
    """The points of agent_trails, from arrays of two points at most."""
    slices = clips.agent_trail_slices(clips.clip_rows(tracking_table(spark, sf), 0.0, 30.0), 0.5, most=2)
    return slices.select(
        "match_id", "period", "frame_id", "time_s", "agent_id", F.inline("trail")
    ).select("match_id", "period", "frame_id", "time_s", "agent_id", "team_id", "point_frame_id",
             "point_time_s", "x_m", "y_m")


# The entities of a file: label in the header and agent of the table.
METRICA_FILES = {
    "home": [(f"Player {i}", f"home_{i}") for i in range(1, 12)]
    + [(f"Sub, {i}", f"sub_{i}") for i in range(12)] + [("Ball", "ball")],
    "away": [(f"Player {i}", f"away_{i}") for i in range(1, 12)]
    + [(f"Sub, {i}", f"sub_{i}") for i in range(12, 23)] + [("Ball", "away ball")],
}


def _metrica_lines(spark, sf):
    """All tracking rows as raw CSV lines: a labelled two-row header for the home files, and a
    three-row header without axis labels for the away files, whose ball differs. Some labels are
    quoted. Some home frames have an empty line too, before or after the other one."""
    t = tracking_table(spark, sf)
    at = F.concat_ws(",", F.coalesce(F.col("raw_x").cast("string"), F.lit("")),
                     F.coalesce(F.col("raw_y").cast("string"), F.lit("NaN")))
    by_frame = t.groupBy(*FRAME_KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("agent_id", at))).alias("at")
    )

    def line(team, position, text):
        return F.struct(F.lit(team).alias("team"), position.cast("bigint").alias("line_pos"),
                        text.alias("value"))

    place = F.col("frame_id") * 3 + 10
    keys = ["period", "frame_id", F.col("frame_id") / 10.0]
    lines, headers = [], []
    for team, entities in METRICA_FILES.items():
        cells = [
            F.lit("0.25,0.75") if agent == "away ball"
            else F.coalesce(F.try_element_at("at", F.lit(agent)), F.lit(","))
            for _, agent in entities
        ]
        lines.append(line(team, place, F.concat_ws(",", *keys, *cells)))
        quoted = [f'"{label}"' if "," in label else label for label, _ in entities]
        labels = "Period,Frame,Time [s]," + ",,".join(quoted) + ","
        if team == "home":
            texts = [labels, ",,," + ",".join(["x,y"] * len(entities))]
        else:
            numbers = [label.split(" ")[-1] for label, _ in entities[:-1]]
            texts = [",,," + "Away,," * len(numbers) + ",", ",,," + ",,".join(numbers) + ",,,", labels]
        headers += [line(team, F.lit(i), F.lit(text)) for i, text in enumerate(texts)]
    empty = F.concat_ws(",", *keys, F.lit("," * (2 * len(METRICA_FILES["home"]) - 1)))
    before, after = F.col("frame_id") % 13 == 0, F.col("frame_id") % 7 == 0
    lines.append(F.when(before | after, line("home", F.when(before, place - 1).otherwise(place + 1),
                                             empty)))
    data = by_frame.select("match_id", F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull()))
                           .alias("line"))
    named = t.select("match_id").distinct().select(
        "match_id", F.explode(F.array(*headers)).alias("line")
    )
    return data.unionByName(named).select("match_id", "line.*").withColumn(
        "source_file", F.concat_ws("_", "match_id", "team")
    )


METRICA_SHOWN = [*ROW, "agent_type", "team_id", "player_id", "jersey_number", "role",
                 "x_m", "y_m", "raw_x", "is_visible", "source_file"]


def metrica_header_map(spark, sf):
    return metrica.header_columns(_metrica_lines(spark, sf)).select("source_file", "pos", "name")


def metrica_wide_to_long(spark, sf):
    return metrica.tracking_from_lines(_metrica_lines(spark, sf), few_files=False).select(
        *METRICA_SHOWN
    )


def metrica_dedupe(spark, sf):
    return metrica.tracking_from_lines(_metrica_lines(spark, sf), few_files=False, once=True).select(
        *METRICA_SHOWN
    )


def metrica_wide_table(spark, sf):
    """A table with a column per agent and axis, from the frames of all agents."""
    t = tracking_table(spark, sf)
    agents = ["ball", *[f"home_{i}" for i in range(1, 12)], *[f"away_{i}" for i in range(1, 12)],
              *[f"sub_{i}" for i in range(23)]]
    wide = t.groupBy("match_id", F.col("period").alias("Period"), F.col("frame_id").alias("Frame")).agg(
        F.min("time_s").alias(" Time [s]"),
        *[F.max(F.when(F.col("agent_id") == a, F.col(f"raw_{c}"))).alias(f"{a} {c.upper()}")
          for a in agents for c in ("x", "y")],
    )
    return metrica.tracking_from_wide(wide.drop("match_id"), "home", "m", "wide").select(
        *METRICA_SHOWN
    )


def metrica_events_files(spark, sf):
    """All tracking rows as event lines of files with one of two headers."""
    t = tracking_table(spark, sf)

    def text(c, none=""):
        return F.coalesce(F.col(c).cast("string"), F.lit(none))

    long = F.col("match_id").substr(-1, 1) < "5"
    quoted = F.concat(F.lit('"'), text("role"), F.lit(', so ""called"""'))
    value = F.when(long, F.concat_ws(
        ",", text("team_id"), text("agent_type"), "period", "frame_id", "agent_id",
        F.round("raw_x", 3).cast("string"), quoted,
    )).otherwise(F.concat_ws(
        ",", F.round("raw_x", 3).cast("string"), F.lit("7"), text("agent_type", "NaN"), "frame_id",
        F.lit("1e1"), "period",
    ))
    # A missing x is an empty cell, which concat_ws would leave out.
    value = F.when(F.col("raw_x").isNull() & long, F.concat_ws(
        ",", text("team_id"), text("agent_type"), "period", "frame_id", "agent_id", F.lit(""), quoted,
    )).when(F.col("raw_x").isNull(), F.concat_ws(
        ",", F.lit(""), F.lit("7"), text("agent_type", "NaN"), "frame_id", F.lit("1e1"), "period",
    )).otherwise(value)
    lines = t.select("match_id", "match_id", (F.monotonically_increasing_id() + 1).alias("line_pos"),
                     value.alias("value")).toDF("match_id", "source_file", "line_pos", "value")
    headers = t.select("match_id").distinct().select(
        "match_id", F.col("match_id").alias("source_file"), F.lit(0).cast("bigint").alias("line_pos"),
        F.when(long, "Team,Type,Period,Start Frame,From,Start X,Note").otherwise(
            'start_x,"Subtype",Type,Frame,"End, X",Period').alias("value"),
    )
    return metrica.events_from_lines(lines.unionByName(headers), few_files=False).drop("dataset")


def _broken_lines(rows, text):
    """The lines of the CSV records ``text`` of some rows with source_file and number, in order."""
    return rows.select(
        "source_file", F.col("number").alias("number"), F.posexplode(F.split(text, "\n", -1)).alias("i", "value")
    ).select("source_file", (F.col("number") * 8 + F.col("i")).alias("line_pos"), "value")


def csv_records(spark, sf):
    """All events as CSV records, three kinds of five with line breaks in quoted cells; the lines of a
    file are cut into blocks that end anywhere."""
    kind = F.col("event_id") % 5
    cell = (
        F.when(kind == 0, F.concat(F.lit('"'), "event_type", F.lit('\nsecond, ""quoted"" part\n\n"",last"')))
        .when(kind == 1, F.concat(F.lit('"one line, '), "event_type", F.lit('"')))
        .when(kind == 2, F.concat(F.lit('5" tall '), "event_type"))
        .when(kind == 3, F.concat(F.lit(' "\n", "'), "event_type", F.lit('""\n"')))
        .otherwise(F.col("event_type"))
    )
    rows = events_table(spark, sf).withColumns({
        "source_file": F.concat(F.lit("u"), F.col("user_id") % 50), "number": F.col("event_id"),
    })
    lines = _broken_lines(rows, F.concat_ws(",", "event_id", cell, "user_id"))
    return records.whole_records(lines.repartition(7), F.floor(F.col("line_pos") / 4001)).select(
        "source_file", "line_pos", F.hex(F.encode("value", "utf-8")).alias("value_hex")
    )


def metrica_events_lines(spark, sf):
    """All tracking rows as event records whose notes hold line breaks, quotes and commas."""
    events = events_table(spark, sf).select(
        F.concat(F.lit("m"), F.expr("event_id div 2300")).alias("source_file"), F.col("event_id").alias("number"),
        "event_type", (F.col("event_id") % 90).alias("minute"),
    )
    note = F.concat(F.lit('"He said:\n""'), "event_type", F.lit('"", then\n, left"'))
    lines = _broken_lines(events, F.concat_ws(",", F.lit("Home"), "event_type", F.lit("1"), "minute", "number", note))
    headers = events.select("source_file").distinct().select(
        "source_file", F.explode(F.array(*[
            F.struct(F.lit(i - 2).cast("bigint").alias("line_pos"), F.lit(text).alias("value"))
            for i, text in enumerate(('Team,Type,Period,Start Frame,From,"Note', 'of the scout"'))
        ])).alias("line"),
    ).select("source_file", "line.*")
    whole = records.whole_records(lines.unionByName(headers), F.floor(F.col("line_pos") / 3001))
    whole = whole.withColumn("match_id", F.col("source_file"))
    return metrica.events_from_lines(whole, few_files=False).select(
        "match_id", "period", "frame_id", "team_id", "player_id", "event_type", "raw_event"
    )


def metrica_events(spark, sf):
    t = tracking_table(spark, sf)
    raw = t.select(
        F.upper("team_id").alias("Team"), F.col("agent_type").alias("Type"),
        F.col("role").alias("Sub Type"), F.col("period").alias(" Period"),
        F.col("frame_id").alias("Start Frame"), F.col("time_s").alias("Start Time [s]"),
        F.col("player_id").alias("From"), F.col("raw_x").alias("Start X"),
        F.col("raw_y").alias("Start Y"), F.col("raw_y").alias("End X"),
        F.col("raw_x").cast("string").alias("End_y"),
        F.col("match_id").alias("_match"),
    )
    return metrica.events_to_canonical(raw, F.col("_match")).withColumn(
        "raw_event", F.get_json_object("raw_event", "$.From")
    )


def skillcorner_frames(spark, sf):
    t = tracking_table(spark, sf)
    entry = F.struct(
        F.col("agent_id").alias("player_id"), F.col("team_id").alias("group"),
        F.lit("other").alias("team"), F.col("jersey_number").alias("number"),
        F.col("x_m").alias("x"), F.col("y_m").alias("y"),
        F.when(F.col("jersey_number") > 3, F.col("is_visible")).alias("is_detected"),
    )
    ball = F.max(F.when(F.col("agent_type") == "ball", F.struct(
        F.col("x_m").alias("x"), F.col("y_m").alias("y"), F.lit(True).alias("seen")
    )))
    lines = t.groupBy(*FRAME_KEYS).agg(
        ball.alias("ball_data"),
        F.collect_list(F.when(F.col("agent_type") != "ball", entry)).alias("player_data"),
    ).select(
        "match_id",
        F.to_json(F.struct(
            F.col("frame_id").alias("frame"), (F.col("frame_id") / 10.0).alias("timestamp"),
            "period", "ball_data", "player_data",
        )).alias("line"),
    )
    parsed = lines.select(
        "match_id", F.from_json("line", skillcorner.FRAME_SCHEMA).alias("frame")
    ).select("match_id", "frame.*")
    return skillcorner.frames_to_tracking(parsed, F.col("match_id"), F.lit("lines"))


def statsbomb_events(spark, sf):
    t = tracking_table(spark, sf)
    named = F.struct(F.col("agent_id").alias("name"), F.col("frame_id").alias("id"))
    event = F.struct(
        "period", F.expr("cast(floor(time_s / 60) as int)").alias("minute"),
        F.expr("cast(time_s % 60 as int)").alias("second"),
        F.when(F.col("x_m").isNotNull(), F.array("x_m", "y_m")).alias("location"),
        F.struct(F.col("team_id").alias("name")).alias("team"),
        named.alias("player"), named.alias("type"),
        F.when(F.col("jersey_number") > 5,
               F.struct(F.array("y_m", "x_m").alias("end_location"))).alias("pass"),
        F.struct(F.array(F.lit(60.0), F.lit(40.0)).alias("end_location")).alias("carry"),
    )
    documents = t.groupBy("match_id").agg(F.to_json(F.collect_list(event)).alias("value"))
    return statsbomb.documents_to_events(documents, F.col("match_id")).drop(
        "raw_event", "frame_id", "event_subtype", "outcome"
    )


def soccertrack_mapping(spark, sf):
    raw = tracking_table(spark, sf).select(
        F.col("match_id").alias("_match"), "period", "time_s", "agent_type", "role",
        "jersey_number", "player_id", F.col("frame_id").alias("image_id"),
        F.col("agent_id").alias("track_id"), F.col("team_id").alias("team_side"),
        F.col("x_m").alias("x"), F.col("y_m").alias("y"),
    )
    return soccertrack.annotations_to_tracking(raw, F.col("_match")).select(
        *ROW, "dataset", "agent_type", "role", "team_id", "jersey_number", "player_id",
        "x_m", "y_m",
    )


def soccertrack_files(spark, sf):
    """All tracking rows as annotation lines: a tree of teams, players and attributes for the matches
    of even number, whose labels are stated once for all columns they cover, and flat files for the
    others. A tree has a line per frame, a flat file one per row."""
    t = tracking_table(spark, sf)
    even = F.substring("match_id", 2, 9).cast("long") % 2 == 0
    players = [("home", i) for i in range(1, 12)] + [("away", i) for i in range(1, 12)] + [
        ("sub", i) for i in range(23)] + [("ball", 0)]
    agents = [team if team == "ball" else f"{team}_{i}" for team, i in players]

    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    at = F.map_from_entries(F.collect_list(F.struct(
        "agent_id", F.concat_ws(",", F.lit("0.5"), text("y_m"), text("x_m"))
    )))
    cells = [F.coalesce(F.try_element_at("at", F.lit(a)), F.lit(",,")) for a in agents]
    place = F.col("frame_id") + 100
    trees = t.where(even).groupBy("match_id", "frame_id").agg(at.alias("at")).select(
        "match_id", place.alias("line_pos"), F.concat_ws(",", "frame_id", *cells).alias("value")
    )
    named, last = [], None
    for team, _ in players:
        named.append(f"{team if team != last else ''},,")
        last = team
    tree_header = [
        "TeamID," + ",".join(named), "PlayerID," + ",".join(f"{i},," for _, i in players),
        "Attributes," + ",".join(["conf,y,X"] * len(players)), "frame" + ",,," * len(players),
    ]
    flat = t.where(~even).select(
        "match_id", (F.monotonically_increasing_id() + 100).alias("line_pos"),
        F.concat_ws(",", text("y_m"), F.lit('"a, b"'), "agent_id", text("team_id"), text("x_m"), "frame_id", "period")
        .alias("value"),
    )
    headers = t.select("match_id").distinct().select(
        "match_id",
        F.posexplode(
            F.when(even, F.array(*map(F.lit, tree_header)))
            .otherwise(F.array(F.lit('y,note,track_id,"team side",x,Image_ID,Period')))
        ).alias("line_pos", "value"),
    )
    lines = trees.unionByName(flat).unionByName(headers).withColumn("source_file", F.col("match_id"))
    return soccertrack.tracking_from_lines(lines, few_files=False, fps=10.0).select(
        *ROW, "agent_type", "team_id", "player_id", "jersey_number", "role", "x_m", "y_m", "z_m", "is_visible"
    )


def _streamed(spark, sf, operator):
    """All tracking rows, played at the same time and streamed a file of frames after the other, and
    the result that the stream wrote. The clocks of the matches run evenly. A row an hour later moves
    the watermark past the end."""
    rows = tracking_table(spark, sf).withColumns({
        "time_s": F.col("frame_id") / F.when(F.substring("match_id", 2, 9).cast("long") % 2 == 0, 4.0).otherwise(10.0),
        "at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_id") / 4.0),
    })
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for first in range(0, 100, 20):
        part = rows.where(F.col("frame_id").between(first, first + 19))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    end = rows.limit(1).withColumns({
        "match_id": F.lit("end"), "agent_type": F.lit("player"), "at": F.timestamp_seconds(F.lit(1_700_003_600)),
    })
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = operator(stream, "at")
    live.run_available(out, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def stream_kinematics(spark, sf):
    return _streamed(spark, sf, live.stream_kinematics)


def stream_team_shape(spark, sf):
    return _streamed(spark, sf, live.stream_team_shape)


def stream_ball_distance(spark, sf):
    return _streamed(spark, sf, live.stream_ball_distance).select(*ROW, "distance_to_ball_m")


QUERIES = [
    canonical_tracking, canonical_events, schema_invalid_types, schema_validation,
    normalized_to_meters, center_to_topleft, grid120_to_meters,
    clip_to_pitch, flip_pitch, out_of_bounds_rows, bounds_summary,
    velocity, velocity_split, acceleration, speed, distance_to_ball, team_shape,
    team_shape_attached, nearest_players, nearest_players_split, all_features, average_speed_and_ball_distance,
    frame_monotonicity, impossible_speeds, missingness, quality_summary,
    time_extents, resample_grid, resample_interpolated, resample_split, resample_heights,
    resample_filled,
    agent_slots, time_index, window_meta, window_cells, window_tensors,
    constant_velocity_rollout, clip_rows, clip_rows_clustered, clip_frames, agent_trails, agent_trail_slices,
    metrica_header_map, metrica_wide_to_long, metrica_dedupe, metrica_wide_table, metrica_events,
    metrica_events_files, csv_records, metrica_events_lines,
    skillcorner_frames, statsbomb_events, soccertrack_mapping, soccertrack_files,
    stream_kinematics, stream_team_shape, stream_ball_distance,
]


def _tidied(query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tidy(query(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _tidied(q) for q in QUERIES}
