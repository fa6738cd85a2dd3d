"""Providers by dataset name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pitchspark.constants import METRICA, SKILLCORNER, SOCCERTRACK, STATSBOMB
from pitchspark.schema import canonical_events
from pitchspark.sources import metrica, skillcorner, soccertrack, statsbomb

Reader = Callable[..., DataFrame]


def _no_events(
    spark: SparkSession, raw_dir: str, match_id: str | None = None, only: list[str] | None = None
) -> DataFrame:
    return canonical_events(spark.createDataFrame([], "match_id string"))


@dataclass(frozen=True)
class Provider:
    """Readers take (spark, raw_dir, match_id) and ``only``, the files to read. ``match_files`` takes
    (spark, raw_dir) and tells which file belongs to which match. Events default to none."""

    read_tracking: Reader
    match_files: Callable[[SparkSession, str], DataFrame | None]
    read_events: Reader = _no_events


PROVIDERS = {
    METRICA: Provider(metrica.read_tracking, metrica.match_files, metrica.read_events),
    SKILLCORNER: Provider(
        skillcorner.read_tracking, skillcorner.match_files, skillcorner.read_events
    ),
    STATSBOMB: Provider(statsbomb.read_tracking, statsbomb.match_files, statsbomb.read_events),
    SOCCERTRACK: Provider(soccertrack.read_tracking, soccertrack.match_files),
}
