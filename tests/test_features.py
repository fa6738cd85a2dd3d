import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchspark.operators import frames, nearest
from pitchspark.operators.kinematics import add_kinematics
from pitchspark.operators.nearest import nearest_other
from pitchspark.operators.resample import resample_tracking
from pitchspark.operators.skew import sliced
from pitchspark.operators.timeseries import nulls_last
from pitchspark.plans.features import compute_features
from pitchspark.schema import FEATURE_VALUES, TRACKING_COLUMNS
from tests.helpers import as_set, table


# Team, place at the first frame and velocity of some agents that keep to a straight line.
STROLLERS = {
    "home_2": ("home", (20.0, 30.0), (2.0, -0.5)), "home_7": ("home", (26.0, 38.0), (-1.5, 2.0)),
    "home_9": ("home", (60.0, 5.0), (0.0, 3.25)), "away_4": ("away", (24.0, 20.0), (0.75, 1.0)),
    "away_5": ("away", (70.0, 50.0), (-4.0, -3.0)), "ball": ("ball", (22.0, 31.0), (6.0, 0.5)),
}
MOMENTS = [0.0, 0.25, 1.0, 1.5]


def place(agent, t):
    _, (x, y), (vx, vy) = STROLLERS[agent]
    return x + vx * t, y + vy * t


def strollers(spark):
    return table(spark, [
        {"match_id": "m1", "frame_id": frame, "time_s": t, "agent_id": agent, "team_id": team,
         "agent_type": "ball" if agent == "ball" else "player", "x_m": place(agent, t)[0], "y_m": place(agent, t)[1]}
        for frame, t in enumerate(MOMENTS) for agent, (team, _, _) in STROLLERS.items()
    ])


def test_strollers(spark):
    df = compute_features(strollers(spark))
    assert df.columns == TRACKING_COLUMNS + FEATURE_VALUES
    rows = df.collect()
    assert len(rows) == len(MOMENTS) * len(STROLLERS)
    for r in rows:
        team, _, (vx, vy) = STROLLERS[r.agent_id]
        here, close = place(r.agent_id, r.time_s), lambda x: pytest.approx(x, abs=1e-9)
        assert (r.vx_mps, r.vy_mps, r.speed_mps) == (close(vx), close(vy), close(math.hypot(vx, vy)))
        assert (r.ax_mps2, r.ay_mps2, r.accel_mps2) == (close(0), close(0), close(0))
        assert r.distance_to_ball_m == close(math.dist(here, place("ball", r.time_s)))
        others = {a: place(a, r.time_s) for a in STROLLERS if a not in ("ball", r.agent_id)}
        if r.agent_id == "ball":
            assert r.nearest_teammate_distance_m is None and r.nearest_opponent_distance_m is None
            assert r.team_centroid_x_m is None and r.team_width_m is None
            continue
        mates, opponents = (
            [math.dist(here, p) for a, p in others.items() if (STROLLERS[a][0] == team) == same]
            for same in (True, False)
        )
        assert r.nearest_teammate_distance_m == close(min(mates))
        assert r.nearest_opponent_distance_m == close(min(opponents))
        xs, ys = zip(here, *[p for a, p in others.items() if STROLLERS[a][0] == team])
        assert (r.team_centroid_x_m, r.team_centroid_y_m) == (close(sum(xs) / len(xs)), close(sum(ys) / len(ys)))
        assert (r.team_length_m, r.team_width_m) == (close(max(xs) - min(xs)), close(max(ys) - min(ys)))


def numpy_derivative(values, times):
    """Central differences; forward ones where times repeat; zeros where times are of no use."""
    v = np.array([np.nan if x is None else x for x in values], dtype=float)
    if len(v) < 2 or any(t is None or not math.isfinite(t) for t in times) or len(set(times)) < 2:
        return np.zeros(len(v))
    t = np.array(times, dtype=float)
    if len(set(times)) == len(times):
        return np.gradient(v, t)
    steps = np.diff(t)
    slopes = np.array([np.diff(v)[i] / steps[i] if steps[i] > 0 else np.nan
                       for i in range(len(steps))])
    return np.append(slopes, slopes[-1])


def series_rows():
    rng = random.Random(5)
    kinds = {
        "even": lambda n: [i * 0.25 for i in range(n)],
        "tenths": lambda n: [i / 10 for i in range(n)],
        "jumpy": lambda n: sorted(rng.uniform(0, 50) for _ in range(n)),
        "far": lambda n: [i * 7.5 for i in range(n)],
        "repeats": lambda n: sorted(rng.choice([0.0, 1.0, 2.0, 30.0]) for _ in range(n)),
        "pairs": lambda n: [i // 2 * 1.0 for i in range(n)],
        "tail": lambda n: [float(min(i, n - 2)) for i in range(n)],
        "one_time": lambda n: [3.0] * n,
        "missing_time": lambda n: [None if i == 1 else float(i) for i in range(n)],
        "endless": lambda n: [float("inf") if i == n - 1 else float(i) for i in range(n)],
    }
    rows = []
    for kind, times in kinds.items():
        for n in (1, 2, 3, 4, 5, 9):
            for period in (1, None):
                for frame, t in enumerate(times(n)):
                    rows.append({
                        "agent_id": f"{kind}_{n}", "period": period, "frame_id": frame, "time_s": t,
                        "x_m": None if rng.random() < 0.15 else rng.uniform(0, 105),
                        "y_m": rng.uniform(0, 68),
                    })
    return rows


@pytest.mark.parametrize("hot_rows, slice_rows", [(None, 9), (0, 4), (0, 60), (3, 12)])
def test_kinematics_match_numpy(spark, hot_rows, slice_rows):
    rows = series_rows()
    expected = []
    groups = {}
    for r in rows:
        groups.setdefault((r["period"], r["agent_id"]), []).append(r)
    for (period, agent), series in groups.items():
        series.sort(key=lambda r: (r["time_s"] is None, r["time_s"] or 0.0, r["frame_id"]))
        times = [r["time_s"] for r in series]
        vx = numpy_derivative([r["x_m"] for r in series], times)
        vy = numpy_derivative([r["y_m"] for r in series], times)
        ax, ay = numpy_derivative(vx, times), numpy_derivative(vy, times)
        for i, r in enumerate(series):
            expected.append((period, agent, r["frame_id"], vx[i], vy[i],
                             np.hypot(vx[i], vy[i]), ax[i], ay[i], np.hypot(ax[i], ay[i])))
    got = as_set(
        add_kinematics(table(spark, rows), hot_rows, slice_rows),
        ["period", "agent_id", "frame_id", "vx_mps", "vy_mps", "speed_mps", "ax_mps2", "ay_mps2",
         "accel_mps2"],
    )
    want = sorted(
        [tuple(None if isinstance(v, float) and math.isnan(v) else
               (round(float(v), 6) + 0.0 if isinstance(v, float) else v) for v in r)
         for r in expected],
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3]
        assert g[3:] == pytest.approx(w[3:], abs=2e-6)


def test_copies_and_ties_do_not_depend_on_the_plan(spark):
    rows = [{"frame_id": f, "time_s": t, "x_m": x, "y_m": x * 2}
            for f, t, x in [(0, 0.0, 1.0), (1, 1.0, 4.0), (1, 1.0, 4.0), (1, 1.0, 4.0),
                            (2, 1.0, 5.0), (3, 2.0, 9.0), (4, 5.0, 9.0), (4, 5.0, 9.0)]]
    df = table(spark, rows)
    usual, split = add_kinematics(df, None), add_kinematics(df, 0, 4)
    assert as_set(usual) == as_set(split)
    assert split.count() == 8


def test_ties_in_other_columns_do_not_depend_on_the_plan(spark):
    """Of rows tied in what orders a series one carries the values, also with extras such as maps."""
    rows = [{"frame_id": int(t), "time_s": t, "x_m": 5 * t, "role": role}
            for t in (0.0, 1.0, 2.0) for role in ("b", "a", None)]
    df = table(spark, rows).withColumns({
        "tags": F.create_map(F.lit("role"), "role"),
        "any": F.expr("parse_json(concat('{\"f\": ', frame_id, '}'))"),
        "extra name": F.length("role"),
    })
    usual, split = add_kinematics(df, None), add_kinematics(df, 0, 2)
    assert usual.columns == split.columns
    shown = ["time_s", "role", "vx_mps", "vy_mps", "ax_mps2"]
    assert as_set(usual, shown) == as_set(split, shown)
    moving = [(r.time_s, r.role) for r in usual.collect() if r.vx_mps is not None]
    assert sorted(t for t, _ in moving) == [0.0, 1.0]
    for r in split.collect():
        assert r.tags == {"role": r.role}
    shown = ["time_s", "x_m", "role"]
    assert as_set(resample_tracking(df, 2.0, 1.0, None), shown) == as_set(
        resample_tracking(df, 2.0, 1.0, 0, 2), shown
    )


def test_cells_follow_the_points(spark):
    """Stray coordinates leave the other points in small cells, and the distances right."""
    rng = np.random.default_rng(21)
    points = [(0, int(i % 2), float(x), float(y))
              for i, (x, y) in enumerate(rng.uniform(0, 100, (2000, 2)))]
    points += [(0, 0, 1e12, 5.0), (0, 1, 3.0, -1e12), (1, 0, 1.0, 1.0), (1, 1, 4.0, 5.0)]
    df = spark.createDataFrame(points, "grp int, label int, x double, y double")
    cells = nearest._placed(df).selectExpr("grp", "floor(_ux * 16) cx", "floor(_uy * 16) cy")
    assert max(r["count"] for r in cells.groupBy("grp", "cx", "cy").count().collect()) < 40
    at = np.array(points)
    for r in nearest_other(df).collect():
        others = at[(at[:, 0] == r.grp) & (at[:, 1] != r.label)]
        want = np.hypot(others[:, 2] - r.x, others[:, 3] - r.y).min()
        assert r.distance == pytest.approx(want)


def test_slices_follow_the_rows(spark):
    """A merged feed of 45 minutes with most rows at one moment: no slice has too many."""
    rows = spark.range(40_000).selectExpr(
        "'m' AS match_id", "1 AS period", "'a' AS agent_id",
        "CASE WHEN id % 4 = 0 THEN id * 0.0675D ELSE 100D END AS time_s", "id AS frame_id",
        "id % 7 * 1D AS x_m", "0D AS y_m", "'f' AS source_file",
    )
    order = nulls_last(["match_id", "period", "agent_id", "time_s", "frame_id"])
    sizes = [r["count"] for r in sliced(rows, order, 1000).groupBy("_slice").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 1000


def test_slices_are_not_tasks(spark):
    """Many slices are made by as many tasks as a shuffle has partitions, in order, none too large."""
    rows = spark.range(3000).selectExpr("pmod(id * 7919, 3000) AS t")
    out = sliced(rows, nulls_last(["t"]), 10)
    assert out.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = out.groupBy("_slice").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n"))
    found = slices.orderBy("_slice").collect()
    assert len(found) >= 300 and max(r.n for r in found) <= 10 and sum(r.n for r in found) == 3000
    assert all(a.high < b.low for a, b in zip(found, found[1:]))


def test_few_points_have_few_bounds(spark):
    """What is attached to each point grows with its group, up to the bounds of a large one."""
    rows = spark.range(2020).selectExpr(
        "CASE WHEN id < 20 THEN 'few' ELSE 'many' END AS grp", "id % 2 AS label", "id * 1D AS x", "id % 77 * 1D AS y")
    sizes = {}
    placed = nearest._placed(rows, nearest.HotKeys(rows, ["grp"], None))
    for r in placed.collect():
        sizes.setdefault(r.grp, set()).add(math.floor(r._ux * nearest.BRANCH))
        assert 0 <= r._ux < 1 and 0 <= r._uy < 1
    assert sizes == {"few": {0, 1, 2, 3}, "many": {0, 1, 2, 3}}
    few = nearest._bounds(rows).where("grp = 'few'").first()
    assert len(few._bounds_x) == 9
    many = nearest._bounds(rows).where("grp = 'many'").first()
    assert len(many._bounds_x) == nearest.PARTS + 1


def test_infinite_positions_give_nulls_and_no_nan(spark):
    df = table(spark, [{"frame_id": i, "time_s": float(i), "x_m": x}
                       for i, x in enumerate([0.0, math.inf, math.inf, 3.0])])
    for plan in (None, 0):
        out = compute_features(df, plan, plan)
        for c in FEATURE_VALUES:
            assert out.where(F.isnan(c)).count() == 0


def frame_rows():
    rng = random.Random(11)
    rows = []
    for frame in (0, 1, None):
        for i in range(30):
            kind = rng.choice(["player"] * 8 + ["referee", None])
            rows.append({
                "frame_id": frame, "agent_id": f"p{i}", "agent_type": kind,
                "team_id": rng.choice(["home", "away", None]),
                "x_m": rng.choice([None, math.inf, 5.0, *[rng.uniform(0, 105)] * 12]),
                "y_m": rng.choice([7.0, rng.uniform(0, 68), rng.uniform(0, 68)]),
            })
        # Two balls; the first by agent and time has no position in one of the frames.
        rows.append({"frame_id": frame, "agent_id": "ball", "agent_type": "ball", "team_id": "ball",
                     "time_s": 0.0, "x_m": None if frame == 1 else 50.0})
        rows.append({"frame_id": frame, "agent_id": "ball", "agent_type": "ball", "team_id": "ball",
                     "time_s": 1.0, "x_m": 20.0})
    rows.append({"frame_id": 9, "agent_id": "alone", "x_m": 3.0})
    # A place shared by team-mates and by opponents.
    for agent, team in [("s1", "home"), ("s2", "home"), ("s3", "away")]:
        rows.append({"frame_id": 10, "agent_id": agent, "team_id": team, "x_m": 8.0, "y_m": 8.0})
    return rows


def brute_frame(rows):
    out = []
    for r in rows:
        same = [o for o in rows if o["frame_id"] == r["frame_id"]]
        full = {**{"team_id": "home", "agent_type": "player", "y_m": 0.0, "time_s": 0.0}, **r}

        def get(o, k):
            return {**{"team_id": "home", "agent_type": "player", "y_m": 0.0, "time_s": 0.0}, **o}[k]

        balls = sorted((o for o in same if get(o, "agent_type") == "ball"),
                       key=lambda o: (o["agent_id"], get(o, "time_s")))
        ball = None
        if balls and balls[0]["x_m"] is not None and r["x_m"] is not None:
            ball = math.hypot(r["x_m"] - balls[0]["x_m"], full["y_m"] - get(balls[0], "y_m"))
        team = [o for o in same if get(o, "agent_type") == "player"
                and get(o, "team_id") == full["team_id"]]
        xs = [o["x_m"] for o in team if o["x_m"] is not None]
        ys = [get(o, "y_m") for o in team]

        def near(mates):
            if full["agent_type"] != "player" or r["x_m"] is None or math.isinf(r["x_m"]):
                return None
            found = [math.hypot(o["x_m"] - r["x_m"], get(o, "y_m") - full["y_m"]) for o in same
                     if o is not r and get(o, "agent_type") == "player"
                     and o["x_m"] is not None and not math.isinf(o["x_m"])
                     and (get(o, "team_id") == full["team_id"]) == mates]
            return min(found, default=None)

        span = (max(xs) - min(xs)) if xs else None
        out.append((r["frame_id"], r["agent_id"], full["time_s"], ball, near(True), near(False),
                    sum(xs) / len(xs) if xs else None, sum(ys) / len(ys) if ys else None,
                    max(ys) - min(ys) if ys else None, span))
    clean = [tuple(None if isinstance(v, float) and math.isnan(v)
                   else round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in out]
    return sorted(clean, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("hot_rows", [None, 0, 20])
def test_frame_features_match_brute_force(spark, hot_rows):
    rows = frame_rows()
    columns = frames.BALL_DISTANCE + frames.NEAREST + frames.TEAM_SHAPE
    got = as_set(frames.add_frame_features(table(spark, rows), columns, hot_rows),
                 ["frame_id", "agent_id", "time_s", *columns])
    want = brute_frame(rows)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=2e-6)


def test_nearest_other_matches_brute_force(spark):
    rng = random.Random(3)
    points = set()
    for group in range(3):
        for _ in range(400):
            cluster = rng.choice([(0.0, 0.0, 0.01), (50.0, 30.0, 3.0), (1e5, -1e5, 1.0)])
            points.add((group, rng.choice("ab") if group else "a",
                        round(rng.gauss(cluster[0], cluster[2]), 3),
                        round(rng.gauss(cluster[1], cluster[2]), 3)))
    points.add((7, "a", 1.0, 1.0))
    points.add((8, "a", 1.0, 1.0))
    points.add((8, "b", 1.0, 1.0))
    df = spark.createDataFrame(sorted(points), "grp int, label string, x double, y double")
    got = {(r.grp, r.label, r.x, r.y): r.distance for r in nearest_other(df).collect()}
    assert len(got) == len(points)
    for p in points:
        others = [math.hypot(p[2] - q[2], p[3] - q[3]) for q in points
                  if q[0] == p[0] and q[1] != p[1]]
        assert got[p] == (pytest.approx(min(others), rel=1e-12) if others else None)


def test_extras_are_kept_and_features_replaced(spark):
    df = strollers(spark).withColumns({"extra": F.lit("e"), "vx_mps": F.lit(99.0)})
    out = compute_features(df)
    assert out.columns == TRACKING_COLUMNS + ["extra"] + FEATURE_VALUES
    assert out.where("agent_id = 'ball'").first().vx_mps == 6.0
    assert compute_features(df.where("false")).count() == 0


def test_two_shuffles(spark):
    plan = compute_features(strollers(spark), None, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("Sort [") == 2
