"""The same results in SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from checks.fixture import TRACKING_SQL

ROW = "match_id, period, frame_id, time_s, agent_id"
G = "match_id, period, agent_id"
F = "match_id, period, frame_id"


def r6(expr: str, name: str | None = None) -> str:
    """Six places, without negative zero."""
    return (
        f"CASE WHEN round({expr}, 6) = 0 THEN CAST(0 AS DOUBLE) ELSE round({expr}, 6) END "
        f"AS {name or expr}"
    )


def d(value: float) -> str:
    return f"CAST({value} AS DOUBLE)"


def rows(*doubles: str, table: str, extra: str = "", where: str = "") -> str:
    """SELECT of the row keys, rounded doubles and extras."""
    shown = [f"match_id, period, frame_id, {r6('time_s')}, agent_id"]
    shown += [r6(c) for c in doubles]
    if extra:
        shown.append(extra)
    return f"SELECT {', '.join(shown)} FROM {table} {where}"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


T = TRACKING_SQL

TRACKING_ROUNDED = f"""match_id, dataset, period, frame_id, {r6('time_s')}, agent_id, agent_type,
  team_id, player_id, jersey_number, role, {r6('x_m')}, {r6('y_m')}, {r6('z_m')}, {r6('raw_x')},
  {r6('raw_y')}, is_visible, source_file"""


def _slope(v: str) -> str:
    """Derivative of v from the columns v0, v, v2 (row before, here, after) and the series flags."""
    return f"""CASE
      WHEN n < 2 OR low_t = high_t THEN CAST(0 AS DOUBLE)
      WHEN low_dt <= 0 THEN
        CASE WHEN t2 IS NULL THEN CASE WHEN time_s - t0 > 0 THEN ({v} - {v}_0) / (time_s - t0) END
             WHEN t2 - time_s > 0 THEN ({v}_2 - {v}) / (t2 - time_s) END
      WHEN t0 IS NULL THEN ({v}_2 - {v}) / (t2 - time_s)
      WHEN t2 IS NULL THEN ({v} - {v}_0) / (time_s - t0)
      WHEN low_dt = high_dt THEN ({v}_2 - {v}_0) / (2 * (t2 - time_s))
      ELSE -(t2 - time_s) / ((time_s - t0) * ((time_s - t0) + (t2 - time_s))) * {v}_0
           + ((t2 - time_s) - (time_s - t0)) / ((time_s - t0) * (t2 - time_s)) * {v}
           + (time_s - t0) / ((t2 - time_s) * ((time_s - t0) + (t2 - time_s))) * {v}_2
    END"""


KINEMATICS = f"""
stepped AS (
  SELECT *, lag(time_s) OVER w AS t0, lead(time_s) OVER w AS t2,
         lag(x_m) OVER w AS x_m_0, lead(x_m) OVER w AS x_m_2,
         lag(y_m) OVER w AS y_m_0, lead(y_m) OVER w AS y_m_2
  FROM tracking
  WINDOW w AS (PARTITION BY {G} ORDER BY time_s, frame_id, x_m, y_m)
),
flagged AS (
  SELECT *, count(*) OVER g AS n, min(time_s) OVER g AS low_t, max(time_s) OVER g AS high_t,
         min(t2 - time_s) OVER g AS low_dt, max(t2 - time_s) OVER g AS high_dt
  FROM stepped
  WINDOW g AS (PARTITION BY {G})
),
moving AS (
  SELECT *, {_slope('x_m')} AS vx_mps, {_slope('y_m')} AS vy_mps FROM flagged
),
moving2 AS (
  SELECT *, lag(vx_mps) OVER w AS vx_mps_0, lead(vx_mps) OVER w AS vx_mps_2,
         lag(vy_mps) OVER w AS vy_mps_0, lead(vy_mps) OVER w AS vy_mps_2
  FROM moving
  WINDOW w AS (PARTITION BY {G} ORDER BY time_s, frame_id, x_m, y_m)
),
accelerating AS (
  SELECT *, {_slope('vx_mps')} AS ax_mps2, {_slope('vy_mps')} AS ay_mps2 FROM moving2
),
kin AS (
  SELECT *, sqrt(vx_mps * vx_mps + vy_mps * vy_mps) AS speed_mps,
         sqrt(ax_mps2 * ax_mps2 + ay_mps2 * ay_mps2) AS accel_mps2
  FROM accelerating
)
"""

BALL = f"""
ball AS (
  SELECT {F}, x_m AS bx, y_m AS by_ FROM (
    SELECT *, row_number() OVER (PARTITION BY {F} ORDER BY agent_id, time_s) AS k
    FROM tracking WHERE agent_type = 'ball') WHERE k = 1
)
"""

SHAPE = f"""
shape AS (
  SELECT {F}, team_id, avg(x_m) AS team_centroid_x_m, avg(y_m) AS team_centroid_y_m,
         max(y_m) - min(y_m) AS team_width_m, max(x_m) - min(x_m) AS team_length_m
  FROM tracking WHERE agent_type = 'player' GROUP BY {F}, team_id
)
"""

NEAREST = """
nearest AS (
  SELECT a.match_id, a.period, a.frame_id, a.agent_id,
         min(sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)))
           FILTER (a.team_id IS NOT DISTINCT FROM b.team_id) AS nearest_teammate_distance_m,
         min(sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)))
           FILTER (a.team_id IS DISTINCT FROM b.team_id) AS nearest_opponent_distance_m
  FROM tracking a JOIN tracking b
    ON a.match_id = b.match_id AND a.period = b.period AND a.frame_id = b.frame_id
   AND a.agent_id <> b.agent_id
  WHERE a.agent_type = 'player' AND b.agent_type = 'player'
  GROUP BY ALL
)
"""

SHAPE_COLUMNS = ["team_centroid_x_m", "team_centroid_y_m", "team_width_m", "team_length_m"]
NEAREST_COLUMNS = ["nearest_teammate_distance_m", "nearest_opponent_distance_m"]

FEATURES = f"""
feat AS (
  SELECT k.*, sqrt((k.x_m - bx) * (k.x_m - bx) + (k.y_m - by_) * (k.y_m - by_))
           AS distance_to_ball_m,
         {', '.join(NEAREST_COLUMNS)}, {', '.join(SHAPE_COLUMNS)}
  FROM kin k
  LEFT JOIN ball b USING (match_id, period, frame_id)
  LEFT JOIN shape s ON s.match_id = k.match_id AND s.period = k.period
       AND s.frame_id = k.frame_id AND s.team_id IS NOT DISTINCT FROM k.team_id
  LEFT JOIN nearest n ON n.match_id = k.match_id AND n.period = k.period
       AND n.frame_id = k.frame_id AND n.agent_id = k.agent_id
)
"""
FEATURE_COLUMNS = [
    "vx_mps", "vy_mps", "speed_mps", "ax_mps2", "ay_mps2", "accel_mps2", "distance_to_ball_m",
    *NEAREST_COLUMNS, *SHAPE_COLUMNS,
]

FAST = """
fast AS (
  SELECT match_id, frame_id, agent_id, speed_mps,
         CASE WHEN agent_type = 'ball' THEN CAST(40 AS DOUBLE) ELSE CAST(12 AS DOUBLE) END
           AS threshold_mps
  FROM kin
  WHERE speed_mps > CASE WHEN agent_type = 'ball' THEN CAST(40 AS DOUBLE)
                         ELSE CAST(12 AS DOUBLE) END
)
"""
OFF = """x_m IS NOT NULL AND y_m IS NOT NULL
  AND NOT (x_m >= 0 AND x_m <= 105 AND y_m >= 0 AND y_m <= 68)"""


def _falls(table: str) -> str:
    return f"""
falls AS (
  SELECT {G}, 'frame_id decreases' AS issue FROM (
    SELECT {G}, frame_id - lag(frame_id) OVER (PARTITION BY {G} ORDER BY time_s, frame_id) AS step
    FROM {table}) WHERE step < 0 GROUP BY {G}
)
"""


# Resampling at 10 fps with gaps of up to 0.2 s, so two rows, interpolated.
DT = d(0.1)
EMPTY_TO_LAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
HERE_TO_END = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def _interpolated(c: str) -> str:
    return f"""CASE WHEN {c} IS NOT NULL THEN {c}
      WHEN p_{c} IS NOT NULL AND n_{c} IS NOT NULL AND pos - p_{c} <= 2
      THEN (n_{c}_v - p_{c}_v) / (n_{c} - p_{c}) * (pos - p_{c}) + p_{c}_v END AS {c}_new"""


def _around(c: str) -> str:
    value = f"last_value({c} IGNORE NULLS) OVER past"
    place = f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER past"
    return (
        f"{place} AS p_{c}, {value} AS p_{c}_v, "
        + f"{place} AS n_{c}, {value} AS n_{c}_v".replace("last_value", "first_value")
        .replace("OVER past", "OVER rest")
    )


def _carried(c: str) -> str:
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER past, "
        f"first_value({c} IGNORE NULLS) OVER rest) AS {c}_new"
    )


COORDINATES = ["x_m", "y_m", "raw_x", "raw_y"]
CARRIED = ["team_id", "jersey_number", "role", "is_visible", "source_file"]
RESAMPLED = f"""
extent AS (
  SELECT {G}, min(time_s) AS s, max(time_s) AS e FROM tracking GROUP BY {G}
),
grid AS (
  SELECT {G}, k,
         round_even((s + k * ((s + {DT}) - s)) * {d(1e10)}, 0) / {d(1e10)} AS grid_t
  FROM (SELECT *, unnest(range(CAST(ceil((e + {DT} / 2 - s) / {DT}) AS BIGINT))) AS k FROM extent)
),
merged AS (
  SELECT g.match_id, g.period, g.agent_id, g.grid_t, {', '.join(COORDINATES + CARRIED)},
         row_number() OVER (PARTITION BY g.match_id, g.period, g.agent_id
                            ORDER BY g.k, t.frame_id, x_m, y_m) AS pos
  FROM grid g LEFT JOIN tracking t
    ON t.match_id = g.match_id AND t.period = g.period AND t.agent_id = g.agent_id
   AND t.time_s = g.grid_t
),
looked AS (
  SELECT *, {', '.join(_around(c) for c in COORDINATES)},
         {', '.join(_carried(c) for c in CARRIED)}
  FROM merged
  WINDOW past AS (PARTITION BY {G} ORDER BY pos {EMPTY_TO_LAST}),
         rest AS (PARTITION BY {G} ORDER BY pos {HERE_TO_END})
),
resampled AS (
  SELECT match_id, period, agent_id, grid_t AS time_s,
         CAST(round_even(grid_t * 10, 0) AS BIGINT) AS frame_id,
         {', '.join(f'{c} IS NULL AS {c}_was_missing' for c in COORDINATES)},
         {', '.join(_interpolated(c) for c in COORDINATES)},
         {', '.join(f'{c}_new' for c in CARRIED)}
  FROM looked
)
"""


def _slots(size: int) -> str:
    return f"""
sides AS (
  SELECT DISTINCT match_id, period, agent_id,
         CASE WHEN agent_type = 'ball' THEN 3 WHEN team_id = 'home' THEN 0
              WHEN team_id = 'away' THEN 1 ELSE 2 END AS side
  FROM tracking WHERE agent_type IN ('player', 'ball')
),
ordered AS (
  SELECT *, row_number() OVER (
           PARTITION BY match_id, period, side = 3
           ORDER BY side, regexp_replace(agent_id, '\\d+$', ''),
                    coalesce(TRY_CAST(regexp_extract(agent_id, '\\d+$') AS INTEGER), -1), agent_id
         ) - 1 AS place,
         max(CAST(side = 3 AS INTEGER)) OVER (PARTITION BY match_id, period) AS has_ball,
         count(*) FILTER (side <> 3) OVER (PARTITION BY match_id, period) AS players
  FROM sides
),
slots AS (
  SELECT match_id, period,
         CAST(CASE WHEN side = 3 THEN least(players, {size} - 1) ELSE place END AS INTEGER) AS slot,
         agent_id
  FROM ordered
  WHERE CASE WHEN side = 3 THEN place = 0 ELSE place < {size} - has_ball END
)
"""


TIMES = """
times AS (
  SELECT match_id, period, time_s,
         row_number() OVER (PARTITION BY match_id, period ORDER BY time_s) - 1 AS idx,
         count(*) OVER (PARTITION BY match_id, period) AS n
  FROM (SELECT DISTINCT match_id, period, time_s FROM tracking)
)
"""

# Windows of five and five steps, 23 slots.
WINDOWS = """
starts AS (
  SELECT a.match_id, a.period, a.idx, a.time_s AS start_time_s, h.time_s AS history_end_time_s,
         f.time_s AS future_start_time_s, e.time_s AS end_time_s
  FROM times a
  JOIN times h ON h.match_id = a.match_id AND h.period = a.period AND h.idx = a.idx + 4
  JOIN times f ON f.match_id = a.match_id AND f.period = a.period AND f.idx = a.idx + 5
  JOIN times e ON e.match_id = a.match_id AND e.period = a.period AND e.idx = a.idx + 9
)
"""
CELLS = """
latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id, period, time_s, agent_id
                                 ORDER BY frame_id DESC, x_m DESC, y_m DESC) AS k
    FROM tracking) WHERE k = 1
),
places AS (SELECT unnest(range(23)) AS slot),
steps AS (SELECT unnest(range(10)) AS step),
cells AS (
  SELECT s.match_id, s.period, s.start_time_s, s.end_time_s,
         CAST(steps.step AS INTEGER) AS step, CAST(places.slot AS INTEGER) AS slot,
         coalesce(slots.agent_id, '') AS agent_id,
         l.x_m AS value_0, l.y_m AS value_1,
         CASE WHEN steps.step < 5 THEN l.raw_x END AS value_2,
         l.x_m IS NOT NULL AS mask
  FROM starts s CROSS JOIN steps CROSS JOIN places
  JOIN times t ON t.match_id = s.match_id AND t.period = s.period AND t.idx = s.idx + steps.step
  LEFT JOIN slots ON slots.match_id = s.match_id AND slots.period = s.period
       AND slots.slot = places.slot
  LEFT JOIN latest l ON l.match_id = s.match_id AND l.period = s.period
       AND l.time_s = t.time_s AND l.agent_id = slots.agent_id
)
"""


def _clip(start: float, end: float) -> str:
    return f"clip AS (SELECT * FROM tracking WHERE time_s >= {d(start)} AND time_s <= {d(end)})"


TRAILS = """
pairs AS (
  SELECT f.match_id, f.period, f.frame_id, f.time_s, p.agent_id, p.team_id,
         p.frame_id AS point_frame_id, p.time_s AS point_time_s, p.x_m, p.y_m,
         count(*) OVER (PARTITION BY f.match_id, f.period, f.frame_id, f.time_s, p.agent_id) AS n
  FROM (SELECT DISTINCT match_id, period, frame_id, time_s FROM clip) f
  JOIN clip p ON p.match_id = f.match_id AND p.time_s >= f.time_s - CAST(0.5 AS DOUBLE)
       AND p.time_s <= f.time_s
  WHERE p.agent_id <> 'ball'
)
"""

METRICA = """
played AS (SELECT DISTINCT match_id, period, frame_id FROM tracking),
entities AS (
  SELECT 'home' AS team, 'player_' || i AS label, 'home_' || i AS agent FROM range(1, 12) r(i)
  UNION ALL SELECT 'away', 'player_' || i, 'away_' || i FROM range(1, 12) r(i)
  UNION ALL SELECT CASE WHEN i < 12 THEN 'home' ELSE 'away' END, 'sub_' || i, 'sub_' || i
            FROM range(23) r(i)
  UNION ALL VALUES ('home', 'ball', 'ball'), ('away', 'ball', 'no agent')
),
-- Home files have a second, empty line for some frames, before or after the other one.
lines AS (
  SELECT *, false AS empty, 1 AS place FROM played CROSS JOIN entities
  UNION ALL
  SELECT *, true, CASE WHEN frame_id % 13 = 0 THEN 0 ELSE 2 END FROM played CROSS JOIN entities
  WHERE team = 'home' AND (frame_id % 13 = 0 OR frame_id % 7 = 0)
),
metrica AS (
  SELECT p.match_id, p.period, p.frame_id, p.frame_id / CAST(10 AS DOUBLE) AS time_s,
         CASE WHEN label = 'ball' THEN 'ball' ELSE team || '_' || label END AS agent_id,
         CASE WHEN label = 'ball' THEN 'ball' ELSE 'player' END AS agent_type,
         CASE WHEN label = 'ball' THEN 'ball' ELSE team END AS team_id,
         CASE WHEN label <> 'ball' THEN team || '_' || label END AS player_id,
         TRY_CAST(split_part(label, '_', 2) AS INTEGER) AS jersey_number,
         CASE WHEN label = 'ball' THEN 'ball' ELSE 'player' END AS role,
         CASE WHEN empty THEN NULL WHEN agent = 'no agent' THEN CAST(0.25 AS DOUBLE)
              ELSE t.raw_x END AS raw_x,
         CASE WHEN empty THEN NULL WHEN agent = 'no agent' THEN CAST(0.75 AS DOUBLE)
              ELSE t.raw_y END AS raw_y,
         p.match_id || '_' || team AS source_file, team,
         min(place) OVER (PARTITION BY p.match_id, p.period, p.frame_id, team, label) = place
           AS kept
  FROM lines p
  LEFT JOIN tracking t ON t.match_id = p.match_id AND t.period = p.period
       AND t.frame_id = p.frame_id AND t.agent_id = p.agent
)
"""


def _metrica(where: str) -> str:
    return _with(T, METRICA) + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id, agent_type, team_id, player_id,
       jersey_number, role, {r6('raw_x * 105', 'x_m')}, {r6('raw_y * 68', 'y_m')}, {r6('raw_x')},
       raw_x IS NOT NULL AND raw_y IS NOT NULL AS is_visible, source_file
FROM metrica {where}"""


WIDE = """
wide AS (
  SELECT match_id, period, frame_id, min(time_s) AS time_s FROM tracking
  GROUP BY match_id, period, frame_id
),
wide_agents AS (
  SELECT 'ball' AS agent UNION ALL SELECT 'home_' || i FROM range(1, 12) r(i)
  UNION ALL SELECT 'away_' || i FROM range(1, 12) r(i) UNION ALL SELECT 'sub_' || i FROM range(23) r(i)
),
wide_rows AS (
  SELECT 'm' AS match_id, w.period, w.frame_id, w.time_s, agent, t.raw_x, t.raw_y
  FROM wide w CROSS JOIN wide_agents LEFT JOIN tracking t
    ON t.match_id = w.match_id AND t.period = w.period AND t.frame_id = w.frame_id
   AND t.agent_id = agent
)
"""

EVENT_FILES = """
event_rows AS (
  SELECT *, round(raw_x, 3) AS x3, match_id[-1] < '5' AS long FROM tracking
),
event_json AS (
  SELECT *, CASE WHEN x3 IS NULL THEN 'null' ELSE CAST(x3 AS VARCHAR) END AS jx FROM event_rows
)
"""


def _slope(value: str, before: str, after: str) -> str:
    """Derivative between two neighbours; with equal steps the value between them isn't read."""
    return f"""CASE WHEN t0 IS NULL AND t2 IS NULL THEN CAST(0 AS DOUBLE)
    WHEN t0 IS NULL THEN ({after} - {value}) / (t2 - t)
    WHEN t2 IS NULL THEN ({value} - {before}) / (t - t0)
    WHEN t - t0 = t2 - t THEN ({after} - {before}) / (CAST(2 AS DOUBLE) * (t2 - t))
    ELSE {after} * (t - t0) / ((t2 - t) * (t2 - t0)) + {value} * ((t2 - t) - (t - t0)) / ((t - t0) * (t2 - t))
       - {before} * (t2 - t) / ((t - t0) * (t2 - t0)) END"""


# Rows of the evenly running clocks, with derivatives that follow from a row's neighbours alone.
LIVE = f"""
clocked AS (
  SELECT * REPLACE (frame_id / CASE WHEN CAST(match_id[2:] AS BIGINT) % 2 = 0
    THEN CAST(4 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS time_s) FROM tracking
), placed AS (
  SELECT *, time_s AS t, lag(time_s) OVER w AS t0, lead(time_s) OVER w AS t2, lag(x_m) OVER w AS x0,
    lead(x_m) OVER w AS x2, lag(y_m) OVER w AS y0, lead(y_m) OVER w AS y2
  FROM clocked WINDOW w AS (PARTITION BY match_id, period, agent_id ORDER BY time_s)
), fast AS (
  SELECT *, {_slope('x_m', 'x0', 'x2')} AS vx_mps, {_slope('y_m', 'y0', 'y2')} AS vy_mps FROM placed
), beside AS (
  SELECT *, lag(vx_mps) OVER w AS vx0, lead(vx_mps) OVER w AS vx2, lag(vy_mps) OVER w AS vy0,
    lead(vy_mps) OVER w AS vy2
  FROM fast WINDOW w AS (PARTITION BY match_id, period, agent_id ORDER BY time_s)
), live AS (
  SELECT *, {_slope('vx_mps', 'vx0', 'vx2')} AS ax_mps2, {_slope('vy_mps', 'vy0', 'vy2')} AS ay_mps2 FROM beside
)
"""


def all_oracles() -> dict[str, str]:
    t = _with(T)
    kin = _with(T, KINEMATICS)
    return {
        "canonical_tracking": t + f"""
SELECT match_id, dataset, period,
       CASE WHEN jersey_number IS DISTINCT FROM 5 THEN frame_id END AS frame_id,
       {r6('time_s')}, agent_id, agent_type, team_id, player_id, jersey_number,
       CAST(NULL AS VARCHAR) AS role, {r6('x_m')}, {r6('y_m')}, {r6('z_m')}, {r6('raw_x')},
       {r6('raw_y')}, is_visible, source_file, upper(agent_id) AS extra FROM tracking""",
        "canonical_events": f"""
SELECT 'u' || (user_id % 5) AS match_id, 'synthetic' AS dataset, CAST(1 AS INTEGER) AS period,
       CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS time_s,
       CAST(NULL AS BIGINT) AS frame_id, CAST(NULL AS VARCHAR) AS team_id,
       CAST(NULL AS VARCHAR) AS player_id, event_type, CAST(NULL AS VARCHAR) AS event_subtype,
       {r6("CASE WHEN event_type <> 'error' THEN value % CAST(110 AS DOUBLE) END", 'x_m')},
       {r6('(value * CAST(3 AS DOUBLE)) % CAST(70 AS DOUBLE)', 'y_m')},
       CAST(NULL AS DOUBLE) AS end_x_m, CAST(NULL AS DOUBLE) AS end_y_m,
       CAST(NULL AS VARCHAR) AS outcome, props AS raw_event FROM events""",
        "schema_invalid_types": t + """
SELECT DISTINCT 'x_' || match_id AS agent_type FROM tracking
WHERE team_id = 'away' AND jersey_number = 4""",
        "schema_validation": t + """
SELECT false AS ok, 'role,z_m' AS missing_columns, count(DISTINCT match_id) AS invalid_agent_types
FROM tracking WHERE team_id = 'away' AND jersey_number = 4""",
        "normalized_to_meters": t + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id,
       {r6('raw_x * 105', 'x_m')}, {r6('raw_y * 68', 'y_m')} FROM tracking""",
        "center_to_topleft": t + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id,
       {r6(f'CASE WHEN x_m < 90 AND y_m IS NOT NULL THEN x_m + {d(52.5)} END', 'x_m')},
       {r6('CASE WHEN x_m < 90 THEN 34 - y_m END', 'y_m')} FROM tracking""",
        "grid120_to_meters": t + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id,
       {r6('CASE WHEN x_m <= 100 THEN x_m / 120 * 105 END', 'x_m')},
       {r6('CASE WHEN x_m <= 100 THEN y_m / 80 * 68 END', 'y_m')} FROM tracking""",
        "clip_to_pitch": t + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id,
       {r6('CASE WHEN x_m > 105 THEN 105 WHEN x_m < 0 THEN 0 ELSE x_m END', 'x_m')},
       {r6('CASE WHEN y_m > 68 THEN 68 WHEN y_m < 0 THEN 0 ELSE y_m END', 'y_m')}
FROM tracking""",
        "flip_pitch": kin + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id, {r6('105 - x_m', 'x_m')},
       {r6('68 - y_m', 'y_m')}, {r6('-vx_mps', 'vx_mps')}, {r6('-vy_mps', 'vy_mps')} FROM kin""",
        "out_of_bounds_rows": t + rows("x_m", "y_m", table="tracking", where=f"WHERE {OFF}"),
        "bounds_summary": t + f"""
SELECT count(*) FILTER ({OFF}) = 0 AS ok, count(*) FILTER ({OFF}) AS out_of_bounds_rows
FROM tracking""",
        "velocity": kin + rows("vx_mps", "vy_mps", table="kin"),
        "velocity_split": kin + rows("vx_mps", "vy_mps", table="kin"),
        "acceleration": kin + rows("ax_mps2", "ay_mps2", table="kin"),
        "speed": kin + rows("speed_mps", "accel_mps2", table="kin"),
        "distance_to_ball": _with(T, BALL) + rows("distance_to_ball_m", table="""(
  SELECT t.*, sqrt((x_m - bx) * (x_m - bx) + (y_m - by_) * (y_m - by_)) AS distance_to_ball_m
  FROM tracking t LEFT JOIN ball USING (match_id, period, frame_id))"""),
        "team_shape": _with(T, SHAPE) + f"""
SELECT match_id, period, frame_id, team_id, {', '.join(r6(c) for c in SHAPE_COLUMNS)}
FROM shape""",
        "team_shape_attached": _with(T, SHAPE) + rows(*SHAPE_COLUMNS, table="""(
  SELECT t.*, s.* EXCLUDE (match_id, period, frame_id, team_id) FROM tracking t LEFT JOIN shape s
    ON s.match_id = t.match_id AND s.period = t.period AND s.frame_id = t.frame_id
   AND s.team_id IS NOT DISTINCT FROM t.team_id)"""),
        "nearest_players": _with(T, NEAREST) + rows(*NEAREST_COLUMNS, table="""(
  SELECT t.*, n.* EXCLUDE (match_id, period, frame_id, agent_id) FROM tracking t
  LEFT JOIN nearest n USING (match_id, period, frame_id, agent_id))"""),
        "nearest_players_split": _with(T, NEAREST) + rows(*NEAREST_COLUMNS, table="""(
  SELECT t.*, n.* EXCLUDE (match_id, period, frame_id, agent_id) FROM tracking t
  LEFT JOIN nearest n USING (match_id, period, frame_id, agent_id))"""),
        "all_features": _with(T, KINEMATICS, BALL, SHAPE, NEAREST, FEATURES) + f"""
SELECT {TRACKING_ROUNDED}, {', '.join(r6(c) for c in FEATURE_COLUMNS)} FROM feat""",
        "average_speed_and_ball_distance":
            _with(T, KINEMATICS, BALL, SHAPE, NEAREST, FEATURES) + f"""
SELECT match_id, agent_id, count(*) AS rows, {r6('avg(speed_mps)', 'mean_speed_mps')},
       {r6('avg(distance_to_ball_m)', 'mean_distance_to_ball_m')}
FROM feat GROUP BY match_id, agent_id""",
        "frame_monotonicity": _with(T, """
swapped AS (
  SELECT * REPLACE (frame_id - CASE WHEN jersey_number = 9 AND frame_id % 10 = 0 THEN 3 ELSE 0 END
                    AS frame_id) FROM tracking
)""", _falls("swapped")) + "SELECT * FROM falls",
        "impossible_speeds": _with(T, KINEMATICS, FAST) + f"""
SELECT match_id, frame_id, agent_id, {r6('speed_mps')}, threshold_mps FROM fast""",
        "missingness": t + """
SELECT agent_id, count(*) AS rows, count(*) FILTER (x_m IS NULL) AS missing_x_m,
       count(*) FILTER (y_m IS NULL) AS missing_y_m FROM tracking GROUP BY agent_id""",
        "quality_summary": _with(T, KINEMATICS, FAST, _falls("tracking")) + f"""
SELECT frame_issues = 0 AND speed_issues = 0 AND out_of_bounds_rows = 0 AS ok, * FROM (
  SELECT (SELECT count(*) FROM falls) AS frame_issues, (SELECT count(*) FROM fast) AS speed_issues,
         (SELECT count(*) FROM tracking WHERE {OFF}) AS out_of_bounds_rows)""",
        "time_extents": t + f"""
SELECT {G}, {r6('min(time_s)', 'start_s')}, {r6('max(time_s)', 'end_s')} FROM tracking
GROUP BY {G}""",
        "resample_grid": _with(T, RESAMPLED) + rows(table="resampled"),
        "resample_interpolated": _with(T, RESAMPLED) + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id, {r6('x_m_new', 'x_m')},
       {r6('y_m_new', 'y_m')}, CAST(NULL AS DOUBLE) AS z_m, {r6('raw_x_new', 'raw_x')},
       x_m_was_missing, raw_y_was_missing FROM resampled""",
        "resample_split": _with(T, RESAMPLED) + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id, {r6('x_m_new', 'x_m')},
       {r6('y_m_new', 'y_m')}, CAST(NULL AS DOUBLE) AS z_m, {r6('raw_x_new', 'raw_x')},
       x_m_was_missing, raw_y_was_missing FROM resampled""",
        "resample_heights": _with(T, RESAMPLED) + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id, {r6('y_m_new', 'z_m')},
       raw_y_was_missing AS z_m_was_missing FROM resampled""",
        "resample_filled": _with(T, RESAMPLED) + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id,
       {', '.join(f'{c}_new AS {c}' for c in CARRIED)} FROM resampled""",
        "agent_slots": _with(T, _slots(18)) + "SELECT * FROM slots",
        "time_index": _with(T, TIMES) + f"""
SELECT match_id, period, {r6('time_s')}, idx, n FROM times""",
        "window_meta": _with(T, TIMES, WINDOWS) + f"""
SELECT match_id, period, {r6('start_time_s')}, {r6('history_end_time_s')},
       {r6('future_start_time_s')}, {r6('end_time_s')}, CAST(5 AS INTEGER) AS history_steps,
       CAST(5 AS INTEGER) AS future_steps, CAST(10 AS DOUBLE) AS fps FROM starts""",
        "window_cells": _with(T, TIMES, WINDOWS, _slots(23), CELLS) + f"""
SELECT match_id, period, {r6('start_time_s')}, step, slot, agent_id, {r6('value_0')},
       {r6('value_1')}, {r6('value_2')}, mask FROM cells""",
        "window_tensors": _with(T, TIMES, WINDOWS, _slots(23), CELLS) + f"""
SELECT match_id, period, {r6('start_time_s')}, {r6('end_time_s')},
       CAST(5 AS INTEGER) AS history_steps, CAST(23 AS INTEGER) AS slots,
       CAST(count(*) FILTER (agent_id <> '' AND step = 0) AS INTEGER) AS agents,
       CAST(count(*) FILTER (mask AND step < 5) AS INTEGER) AS seen_history,
       CAST(count(*) FILTER (mask AND step >= 5) AS INTEGER) AS seen_future,
       {r6('coalesce(sum(value_0) FILTER (step < 5), 0)', 'sum_history_x')},
       {r6('coalesce(sum(value_1) FILTER (step >= 5), 0)', 'sum_future_y')}
FROM cells GROUP BY match_id, period, start_time_s, end_time_s""",
        "constant_velocity_rollout": _with(T, KINEMATICS, f"""
ahead AS (
  SELECT *, x_m + (step * {d(0.1)}) * vx_mps AS px, y_m + (step * {d(0.1)}) * vy_mps AS py
  FROM kin CROSS JOIN (SELECT unnest(range(1, 6)) AS step)
)""") + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id, CAST(step AS INTEGER) AS step,
       {r6('CASE WHEN px < 0 THEN 0 WHEN px > 105 THEN 105 ELSE px END', 'pred_x_m')},
       {r6('CASE WHEN py < 0 THEN 0 WHEN py > 68 THEN 68 ELSE py END', 'pred_y_m')} FROM ahead""",
        "clip_rows": _with(T, _clip(2.0, 6.5)) + rows("x_m", "y_m", table="clip"),
        "clip_rows_clustered": _with(T, _clip(2.0, 6.5)) + rows("x_m", "y_m", table="clip"),
        "clip_frames": _with(T, _clip(2.0, 6.5)) + f"""
SELECT DISTINCT match_id, period, frame_id, {r6('time_s')} FROM clip""",
        "agent_trails": _with(T, _clip(0.0, 30.0), TRAILS) + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id, team_id, point_frame_id,
       {r6('point_time_s')}, {r6('x_m')}, {r6('y_m')} FROM pairs WHERE n > 1""",
        "agent_trail_slices": _with(T, _clip(0.0, 30.0), TRAILS) + f"""
SELECT match_id, period, frame_id, {r6('time_s')}, agent_id, team_id, point_frame_id,
       {r6('point_time_s')}, {r6('x_m')}, {r6('y_m')} FROM pairs WHERE n > 1""",
        "metrica_header_map": _with(T, """
headers AS (
  SELECT unnest(range(51)) AS pos
)""") + """
SELECT match_id || '_' || team AS source_file, CAST(pos AS INTEGER) AS pos,
       CASE WHEN pos = 0 THEN 'Period' WHEN pos = 1 THEN 'Frame' WHEN pos = 2 THEN 'Time [s]'
            ELSE CASE WHEN pos < 25 THEN 'Player ' || ((pos - 1) // 2)
                      WHEN team = 'home' AND pos < 49 THEN 'Sub, ' || ((pos - 25) // 2)
                      WHEN team = 'away' AND pos < 47 THEN 'Sub, ' || ((pos - 1) // 2)
                      ELSE 'Ball' END
                 || CASE WHEN pos % 2 = 1 THEN '_x' ELSE '_y' END END AS name
FROM (SELECT DISTINCT match_id FROM tracking)
CROSS JOIN (VALUES ('home'), ('away')) teams(team) CROSS JOIN headers
WHERE team = 'home' OR pos < 49""",
        "metrica_wide_to_long": _metrica(""),
        "metrica_dedupe": _metrica("WHERE kept AND (agent_id <> 'ball' OR team = 'home')"),
        "metrica_wide_table": _with(T, WIDE) + f"""
SELECT match_id, period, frame_id, {r6('time_s')},
       CASE WHEN agent = 'ball' THEN agent ELSE 'home_' || agent END AS agent_id,
       CASE WHEN agent = 'ball' THEN 'ball' ELSE 'player' END AS agent_type,
       CASE WHEN agent = 'ball' THEN 'ball' ELSE 'home' END AS team_id,
       CASE WHEN agent <> 'ball' THEN 'home_' || agent END AS player_id,
       TRY_CAST(split_part(agent, '_', 2) AS INTEGER) AS jersey_number,
       CASE WHEN agent = 'ball' THEN 'ball' ELSE 'player' END AS role,
       {r6('raw_x * 105', 'x_m')}, {r6('raw_y * 68', 'y_m')}, {r6('raw_x')},
       raw_x IS NOT NULL AND raw_y IS NOT NULL AS is_visible, 'wide' AS source_file
FROM wide_rows""",
        "metrica_events_files": _with(T, EVENT_FILES) + f"""
SELECT match_id, period, CAST(NULL AS DOUBLE) AS time_s, frame_id,
       CASE WHEN long THEN team_id END AS team_id, CASE WHEN long THEN agent_id END AS player_id,
       agent_type AS event_type, CASE WHEN NOT long THEN '7' END AS event_subtype,
       {r6('x3 * 105', 'x_m')}, CAST(NULL AS DOUBLE) AS y_m,
       CASE WHEN NOT long THEN CAST(1050 AS DOUBLE) END AS end_x_m, CAST(NULL AS DOUBLE) AS end_y_m,
       CAST(NULL AS VARCHAR) AS outcome,
       CASE WHEN long THEN
         '{{"Team":' || coalesce('"' || team_id || '"', 'null') || ',"Type":"' || agent_type
         || '","Period":' || period || ',"Start Frame":' || frame_id || ',"From":"' || agent_id
         || '","Start X":' || jx || ',"Note":"' || role || ', so \\"called\\""}}'
       ELSE
         '{{"start_x":' || jx || ',"Subtype":7,"Type":"' || agent_type || '","Frame":' || frame_id
         || ',"End, X":1e1,"Period":' || period || '}}'
       END AS raw_event
FROM event_json""",
        "csv_records": """
SELECT 'u' || (user_id % 50) AS source_file, event_id * 8 AS line_pos, hex(event_id || ',' || CASE event_id % 5
    WHEN 0 THEN '"' || event_type || chr(10) || 'second, ""quoted"" part' || chr(10) || chr(10) || '"",last"'
    WHEN 1 THEN '"one line, ' || event_type || '"'
    WHEN 2 THEN '5" tall ' || event_type
    WHEN 3 THEN ' "' || chr(10) || '", "' || event_type || '""' || chr(10) || '"'
    ELSE event_type END || ',' || user_id) AS value_hex
FROM events""",
        "metrica_events_lines": r"""
SELECT 'm' || (event_id // 2300) AS match_id, CAST(1 AS INTEGER) AS period, event_id % 90 AS frame_id,
  'home' AS team_id, CAST(event_id AS VARCHAR) AS player_id, event_type,
  '{"Team":"Home","Type":"' || event_type || '","Period":1,"Start Frame":' || (event_id % 90)
  || ',"From":' || event_id || ',"Note\nof the scout":"He said:\n\"' || event_type
  || '\", then\n, left"}' AS raw_event
FROM events""",
        "metrica_events": t + f"""
SELECT match_id, 'metrica' AS dataset, period, {r6('time_s')}, frame_id, team_id, player_id,
       agent_type AS event_type, role AS event_subtype, {r6('raw_x * 105', 'x_m')},
       {r6('raw_y * 68', 'y_m')}, {r6('raw_y * 105', 'end_x_m')}, {r6('raw_x * 68', 'end_y_m')},
       CAST(NULL AS VARCHAR) AS outcome, player_id AS raw_event FROM tracking""",
        "skillcorner_frames": t + f"""
SELECT match_id, 'skillcorner' AS dataset, period, frame_id,
       {r6(f'frame_id / {d(10)}', 'time_s')}, agent_id,
       CASE WHEN agent_type = 'ball' THEN 'ball' ELSE 'player' END AS agent_type,
       CASE WHEN agent_type = 'ball' THEN 'ball' ELSE coalesce(team_id, 'other') END AS team_id,
       CASE WHEN agent_type <> 'ball' THEN agent_id END AS player_id,
       CASE WHEN agent_type <> 'ball' THEN jersey_number END AS jersey_number,
       CASE WHEN agent_type = 'ball' THEN 'ball' ELSE 'player' END AS role,
       {r6(f'CASE WHEN x_m IS NOT NULL THEN x_m + {d(52.5)} END', 'x_m')},
       {r6('34 - y_m', 'y_m')}, CAST(NULL AS DOUBLE) AS z_m, {r6('x_m', 'raw_x')},
       {r6('y_m', 'raw_y')},
       CASE WHEN jersey_number > 3 THEN is_visible ELSE true END AS is_visible,
       'lines' AS source_file FROM tracking""",
        "statsbomb_events": t + f"""
SELECT match_id, 'statsbomb' AS dataset, period, {r6('floor(time_s)', 'time_s')}, team_id,
       CAST(frame_id AS VARCHAR) AS player_id, agent_id AS event_type,
       {r6('x_m / 120 * 105', 'x_m')}, {r6('y_m / 80 * 68', 'y_m')},
       {r6(f'CASE WHEN jersey_number > 5 THEN y_m / 120 * 105 ELSE {d(52.5)} END', 'end_x_m')},
       {r6(f'CASE WHEN jersey_number > 5 THEN x_m / 80 * 68 ELSE {d(34)} END', 'end_y_m')}
FROM tracking""",
        "stream_kinematics": _with(T, LIVE) + f"""
SELECT match_id, period, agent_id, frame_id, {r6('time_s')}, {r6('x_m')}, {r6('y_m')}, {r6('vx_mps')},
  {r6('vy_mps')}, {r6('sqrt(vx_mps * vx_mps + vy_mps * vy_mps)', 'speed_mps')}, {r6('ax_mps2')}, {r6('ay_mps2')},
  {r6('sqrt(ax_mps2 * ax_mps2 + ay_mps2 * ay_mps2)', 'accel_mps2')}, false AS frame_falls, false AS late
FROM live""",
        "stream_team_shape": _with(T, SHAPE) + f"""
SELECT match_id, period, frame_id, team_id, {', '.join(r6(c) for c in SHAPE_COLUMNS)}
FROM shape""",
        "stream_ball_distance": _with(T, LIVE, BALL) + rows("distance_to_ball_m", table="""(
  SELECT t.*, sqrt((x_m - bx) * (x_m - bx) + (y_m - by_) * (y_m - by_)) AS distance_to_ball_m
  FROM clocked t LEFT JOIN ball USING (match_id, period, frame_id))"""),
        "soccertrack_files": _with(T, """
agents AS (
  SELECT 'home' AS team, i FROM range(1, 12) r(i) UNION ALL SELECT 'away', i FROM range(1, 12) r(i)
  UNION ALL SELECT 'sub', i FROM range(23) r(i) UNION ALL SELECT 'ball', 0
), trees AS (
  SELECT f.match_id, f.frame_id, a.*, CASE WHEN team = 'ball' THEN 'ball' ELSE team || '_' || i END AS agent_id
  FROM (SELECT DISTINCT match_id, frame_id FROM tracking WHERE CAST(match_id[2:] AS BIGINT) % 2 = 0) f, agents a
)""") + f"""
SELECT match_id, CAST(1 AS INTEGER) AS period, frame_id, {r6(f'frame_id / {d(10)}', 'time_s')}, agent_id,
  CASE WHEN team = 'ball' THEN 'ball' ELSE 'player' END AS agent_type, team AS team_id,
  CASE WHEN team <> 'ball' THEN agent_id END AS player_id,
  CASE WHEN team <> 'ball' THEN CAST(i AS INTEGER) END AS jersey_number,
  CASE WHEN team = 'ball' THEN 'ball' ELSE 'player' END AS role,
  {r6('x_m')}, {r6('y_m')}, CAST(NULL AS DOUBLE) AS z_m, x_m IS NOT NULL AS is_visible
FROM trees LEFT JOIN (SELECT match_id, frame_id, agent_id, x_m, y_m FROM tracking) USING (match_id, frame_id, agent_id)
UNION ALL
SELECT match_id, period, frame_id, {r6(f'frame_id / {d(10)}', 'time_s')}, agent_id,
  CASE WHEN agent_id = 'ball' THEN 'ball' ELSE 'player' END, team_id, NULL, NULL, NULL,
  {r6('x_m')}, {r6('y_m')}, NULL, x_m IS NOT NULL
FROM tracking WHERE CAST(match_id[2:] AS BIGINT) % 2 = 1""",
        "soccertrack_mapping": t + rows(
            "x_m", "y_m", table="tracking",
            extra="'soccertrack' AS dataset, agent_type, role, team_id, jersey_number, player_id",
        ),
    }
