"""File-to-file jobs: ingest, features, quality and window export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchspark.operators.quality import check_quality, summarised
from pitchspark.operators.windows import WindowConfig, build_windows
from pitchspark.plans.features import compute_features
from pitchspark.sources import tables
from pitchspark.sources.registry import PROVIDERS

META_COLUMNS = [
    "match_id", "period", "start_time_s", "history_end_time_s", "future_start_time_s",
    "end_time_s", "history_steps", "future_steps", "fps",
]


def ingest(
    spark: SparkSession, dataset: str, raw_dir: str, out_dir: str, match_id: str | None = None
) -> dict[str, str]:
    """Write canonical tracking, and events if there are any, below ``out_dir``.

    A provider without tracking gets its events written alone.
    """
    provider = PROVIDERS[dataset]
    paths = {}
    try:
        tracking = provider.read_tracking(spark, raw_dir, match_id)
    except NotImplementedError:
        tracking = None
    if tracking is not None:
        paths["tracking"] = tables.write_table(tracking, f"{out_dir}/tracking.parquet")
    events = provider.read_events(spark, raw_dir, match_id)
    if not events.isEmpty():
        paths["events"] = tables.write_table(events, f"{out_dir}/events.parquet")
    if not paths:
        raise NotImplementedError(f"{dataset} has neither tracking nor events below {raw_dir}")
    return paths


def features(spark: SparkSession, tracking_path: str, out_path: str) -> str:
    return tables.write_table(
        compute_features(tables.read_tracking(spark, tracking_path)), out_path
    )


def quality(spark: SparkSession, tracking_path: str, out_dir: str | None = None) -> DataFrame:
    """The summary of the quality report; with ``out_dir``, the parts are written there first, and
    the summary is made of them."""
    report = check_quality(tables.read_tracking(spark, tracking_path))
    if out_dir is None:
        return report.summary

    def written(df: DataFrame, part: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out_dir}/{part}.parquet")
        return spark.read.schema(df.schema).parquet(f"{out_dir}/{part}.parquet")

    parts = {
        part: written(getattr(report, part), part)
        for part in ("frame_monotonicity", "coordinate_bounds", "out_of_bounds",
                     "impossible_speeds", "missingness_by_agent")
    }
    return written(
        summarised(parts["frame_monotonicity"], parts["impossible_speeds"], parts["coordinate_bounds"]),
        "summary",
    )


def export_windows(
    spark: SparkSession,
    tracking_path: str,
    out_dir: str,
    features_path: str | None = None,
    cfg: WindowConfig | None = None,
    match_id: str | None = None,
) -> dict[str, str]:
    """Write windows and their description, by match: the matches of the tracking table, or the one
    of ``match_id``, are replaced, and the files of all others stay as they are. The description is
    read back from the windows just written. ``tables.read_windows`` reads either."""
    def chosen(df: DataFrame) -> DataFrame:
        return df if match_id is None else df.where(F.col("match_id") == match_id)

    source = chosen(tables.read_tracking(spark, tracking_path))
    feature_table = chosen(tables.read_features(spark, features_path)) if features_path else None
    paths = {
        "windows": f"{out_dir}/windows.parquet", "window_meta": f"{out_dir}/window_meta.parquet"
    }
    windows = build_windows(source, feature_table, cfg)
    tables.replace_matches(windows, paths["windows"])
    written = chosen(tables.read_windows(spark, paths["windows"], windows.schema))
    if match_id is None:
        written = written.join(source.select("match_id").distinct(), "match_id", "left_semi")
    tables.replace_matches(written.select(*META_COLUMNS), paths["window_meta"])
    return paths
