"""StatsBomb open data: one JSON array of events per match, positions on a 120 x 80 grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchspark.constants import STATSBOMB
from pitchspark.functions.coordinates import grid_to_meters
from pitchspark.schema import canonical_events
from pitchspark.operators.skew import BROADCAST_ROWS, attach
from pitchspark.sources.files import file_path, folder, listing, literal, parent_name, stem


def documents_to_events(documents: DataFrame, match_id: Column) -> DataFrame:
    """Canonical events from ``value``, the text of a JSON array of events.

    The end location is that of the first nested object that has one. Times are match-clock
    seconds, and the team is given by name.
    """
    texts = documents.select(
        match_id.alias("match_id"), F.explode(F.from_json("value", "array<string>")).alias("text")
    )
    # A map keeps the order of the keys; variant values know objects from text that looks like one.
    events = texts.withColumn("event", F.from_json("text", "map<string,variant>"))

    def field(name: str, dtype: str, path: str = "$") -> Column:
        return F.try_variant_get(F.try_element_at("event", F.lit(name)), path, dtype)

    def has_end(value: Column) -> Column:
        return F.try_variant_get(value, "$.end_location", "variant").isNotNull()

    end = F.get(F.filter(F.map_values("event"), has_end), F.lit(0))
    x, y = grid_to_meters(field("location", "array<double>"))
    end_x, end_y = grid_to_meters(F.try_variant_get(end, "$.end_location", "array<double>"))

    def number(name: str) -> Column:
        return F.coalesce(field(name, "double"), F.lit(0.0))

    return canonical_events(events.select(
        "match_id",
        F.lit(STATSBOMB).alias("dataset"),
        field("period", "int").alias("period"),
        (number("minute") * 60.0 + number("second")).alias("time_s"),
        field("team", "string", "$.name").alias("team_id"),
        field("player", "string", "$.id").alias("player_id"),
        field("type", "string", "$.name").alias("event_type"),
        x.alias("x_m"),
        y.alias("y_m"),
        end_x.alias("end_x_m"),
        end_y.alias("end_y_m"),
        F.col("text").alias("raw_event"),
    ))


def match_files(spark: SparkSession, raw_dir: str) -> DataFrame | None:
    """source_file and match_id (the file's name) of the event files below ``raw_dir``: those of
    ``data/events``, or else of any ``events`` directory; None if there are none."""
    found = listing(spark, raw_dir, "*.json")
    if found is None:
        return None
    path = F.col("source_file")
    files = found.where(parent_name(path) == "events").select(
        "source_file", stem(path).alias("match_id"), folder(path).endswith("/data/events").alias("top")
    )
    # The nearest data/events, whatever lies deeper.
    least = files.where("top").agg(F.min(F.length(folder(path)))).first()[0]
    if least is not None:
        return files.where(F.col("top") & (F.length(folder(path)) == least)).drop("top")
    return None if files.isEmpty() else files.drop("top")


def read_events(
    spark: SparkSession, raw_dir: str, match_id: str | None = None, only: list[str] | None = None
) -> DataFrame:
    """Events of every match below ``raw_dir``, or of one; see ``match_files``.

    ``match_id`` chooses the match of that name, whose files alone are then read; a single match of
    another name takes it, and what fits none of several fails. ``only`` names the source files to
    read, all others are just listed. No rows where there are no files.
    """
    files = match_files(spark, raw_dir)
    if files is None:
        return canonical_events(spark.createDataFrame([], "match_id string"))
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    count, fits = files.agg(F.count("*"), F.count_if(F.col("match_id") == match_id)).first()
    if match_id is not None:
        if fits:
            files, count = files.where(F.col("match_id") == match_id), fits
            reader = reader.option("pathGlobFilter", f"{literal(match_id)}.json")
        elif count == 1:
            files = files.withColumn("match_id", F.lit(match_id))
        else:
            raise ValueError(f"none of {count} StatsBomb matches below {raw_dir} is {match_id}")
    if only is None:
        documents = reader.text(str(raw_dir), wholetext=True)
        # Files of other directories are left out when the scan is planned.
        documents = documents.where(F.col("_metadata.file_path").contains("/events/"))
    else:
        files, count = files.where(F.col("source_file").isin(only)), len(only)
        documents = spark.read.text([literal(p) for p in only], wholetext=True)
    documents = documents.select("value", file_path().alias("source_file"))
    chosen = attach(documents, files, ["source_file"], count <= BROADCAST_ROWS, F.col("value"), how="inner")
    return documents_to_events(chosen, F.col("match_id"))


def read_tracking(
    spark: SparkSession, raw_dir: str, match_id: str | None = None, only: list[str] | None = None
) -> DataFrame:
    raise NotImplementedError("StatsBomb open data has events only, no continuous tracking")
