"""Tracking and event tables derived from the driver's ``events`` table.

Every event becomes one tracking row. The projection has repeated times, evenly and unevenly
spaced matches, missing coordinates, absent agents, a null team, a referee, unknown agents and
points off the pitch. ``TRACKING_SQL`` states the same projection for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def tracking_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_table(spark, sf_dir).selectExpr(
        "event_id", "event_type", "value", "props",
        "cast(event_id % 23 as int) as ix",
        "event_id div 23 div 100 as m",
        "event_id div 23 % 100 as fr",
        "event_id % 41 = 7 as stranger",
        "case when event_type <> 'error' then value % 110.0D end as x",
        "case when event_type <> 'error' then (value * 3.0D) % 70.0D end as y",
    )
    e = e.selectExpr(
        "*",
        """case when stranger then concat('sub_', ix) when ix = 0 then 'ball'
                when ix <= 11 then concat('home_', ix) else concat('away_', ix - 11) end as agent""",
        """case when stranger then 'unknown' when ix = 0 then 'ball'
                when ix = 22 then 'referee' else 'player' end as kind""",
    )
    return e.selectExpr(
        "concat('m', m) as match_id",
        "'synthetic' as dataset",
        "cast(1 + fr div 50 as int) as period",
        "fr as frame_id",
        """cast(case when event_id % 97 = 5 and fr % 50 > 0 then fr - 1 else fr end as double)
           / case when m % 2 = 0 then 4.0D else 10.0D end as time_s""",
        "agent as agent_id",
        "kind as agent_type",
        """case when stranger then null when ix = 0 then 'ball' when ix <= 11 then 'home'
                when ix = 21 then null else 'away' end as team_id""",
        "case when kind = 'player' then agent end as player_id",
        """case when kind = 'player' then case when ix <= 11 then ix else ix - 11 end end
           as jersey_number""",
        "kind as role",
        "x as x_m",
        "y as y_m",
        "cast(null as double) as z_m",
        "x / 105.0D as raw_x",
        "y / 68.0D as raw_y",
        "x is not null as is_visible",
        "'events' as source_file",
    )


TRACKING_SQL = """
raw AS (
  SELECT event_id, event_type, value, props,
         CAST(event_id % 23 AS INTEGER) AS ix,
         event_id // 23 // 100 AS m,
         event_id // 23 % 100 AS fr,
         event_id % 41 = 7 AS stranger,
         CASE WHEN event_type <> 'error' THEN value % CAST(110 AS DOUBLE) END AS x,
         CASE WHEN event_type <> 'error'
              THEN (value * CAST(3 AS DOUBLE)) % CAST(70 AS DOUBLE) END AS y
  FROM events
),
named AS (
  SELECT *,
         CASE WHEN stranger THEN 'sub_' || ix WHEN ix = 0 THEN 'ball'
              WHEN ix <= 11 THEN 'home_' || ix ELSE 'away_' || (ix - 11) END AS agent,
         CASE WHEN stranger THEN 'unknown' WHEN ix = 0 THEN 'ball'
              WHEN ix = 22 THEN 'referee' ELSE 'player' END AS kind
  FROM raw
),
tracking AS (
  SELECT 'm' || m AS match_id,
         'synthetic' AS dataset,
         CAST(1 + fr // 50 AS INTEGER) AS period,
         fr AS frame_id,
         CAST(CASE WHEN event_id % 97 = 5 AND fr % 50 > 0 THEN fr - 1 ELSE fr END AS DOUBLE)
           / CASE WHEN m % 2 = 0 THEN CAST(4 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS time_s,
         agent AS agent_id,
         kind AS agent_type,
         CASE WHEN stranger THEN NULL WHEN ix = 0 THEN 'ball' WHEN ix <= 11 THEN 'home'
              WHEN ix = 21 THEN NULL ELSE 'away' END AS team_id,
         CASE WHEN kind = 'player' THEN agent END AS player_id,
         CASE WHEN kind = 'player' THEN CASE WHEN ix <= 11 THEN ix ELSE ix - 11 END END
           AS jersey_number,
         kind AS role,
         x AS x_m,
         y AS y_m,
         CAST(NULL AS DOUBLE) AS z_m,
         x / CAST(105 AS DOUBLE) AS raw_x,
         y / CAST(68 AS DOUBLE) AS raw_y,
         x IS NOT NULL AS is_visible,
         'events' AS source_file
  FROM named
)
"""
