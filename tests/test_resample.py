import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchspark.operators.resample import INTERPOLATED, resample_tracking
from tests.helpers import as_set, table


def expected(rows, fps, gap):
    """pandas on one series at a time, in the order time, frame, x."""
    out = []
    df = pd.DataFrame(rows)
    for agent, g in df.groupby("agent_id", sort=False):
        g = g[np.isfinite(g["time_s"])].sort_values(["time_s", "frame_id", "x_m"])
        if g.empty:
            continue
        start, end, dt = g["time_s"].min(), g["time_s"].max(), 1 / fps
        grid = pd.DataFrame({"time_s": np.round(np.arange(start, end + dt / 2, dt), 10)})
        m = grid.merge(g, on="time_s", how="left")
        m["missing"] = m["x_m"].isna()
        m["x_m"] = m["x_m"].interpolate(limit=int(round(gap * fps)), limit_area="inside")
        m["team_id"] = m["team_id"].ffill().bfill()
        m["frame_id"] = np.round(m["time_s"] * fps).astype(int)
        for r in m.itertuples():
            out.append((agent, round(r.time_s, 6) + 0.0, r.frame_id,
                        None if pd.isna(r.x_m) else round(r.x_m, 6) + 0.0, r.missing,
                        None if pd.isna(r.team_id) else r.team_id))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def rows():
    rng = random.Random(2)
    out = []

    def add(agent, times):
        for i, t in enumerate(times):
            out.append({"agent_id": agent, "frame_id": i, "time_s": t,
                        "x_m": None if rng.random() < 0.3 else round(rng.uniform(0, 105), 2),
                        "team_id": rng.choice(["home", None, "away"])})

    add("on_grid", [i / 10 for i in range(30)])
    add("fast", [i / 25 for i in range(60)])
    add("gaps", [0.0, 0.1, 0.9, 1.0, 3.0, 3.1, 7.5])
    add("repeats", [0.0, 0.1, 0.1, 0.1, 0.4, 0.4, 1.2, 1.2])
    add("shifted", [100.05 + i * 0.3 for i in range(20)])
    add("off", [0.0, 0.033, 0.066, 0.133, 0.5])
    add("single", [4.0])
    add("late", [2700.0 + i / 10 for i in range(20)])
    add("partly_missing", [0.0, None, 0.5, None, 0.7])
    return out


@pytest.mark.parametrize("hot_rows, slice_rows", [(None, 9), (0, 3), (0, 40), (10, 7)])
def test_resample_matches_pandas(spark, hot_rows, slice_rows):
    df = table(spark, rows())
    out = resample_tracking(df, 10.0, 0.5, hot_rows, slice_rows)
    assert out.columns == df.columns + [f"{c}_was_missing" for c in INTERPOLATED]
    got = as_set(out, ["agent_id", "time_s", "frame_id", "x_m", "x_m_was_missing", "team_id"])
    want = expected(rows(), 10.0, 0.5)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=2e-6)


def test_copies_take_a_position_each(spark):
    series = [{"frame_id": 0, "time_s": 0.0, "x_m": 0.0}, {"frame_id": 5, "time_s": 1.0, "x_m": 9.0}]
    series += [{"frame_id": 2, "time_s": 0.5, "x_m": None}] * 3
    df = table(spark, series)
    usual, split = resample_tracking(df, 4.0, 2.0, None), resample_tracking(df, 4.0, 2.0, 0, 3)
    assert as_set(usual) == as_set(split)
    assert [r.x_m for r in usual.orderBy("time_s", "x_m").collect()] == pytest.approx(
        [0.0, 1.5, 3.0, 4.5, 6.0, 7.5, 9.0])


@pytest.mark.parametrize("hot_rows", [None, 0])
def test_series_that_never_meets_its_grid(spark, hot_rows):
    start = 0.123456789012345
    df = table(spark, [{"time_s": start, "x_m": 1.0, "role": "r"},
                       {"time_s": start + 0.17, "x_m": 2.0, "frame_id": 1}])
    out = resample_tracking(df, 10.0, 0.5, hot_rows).orderBy("time_s").collect()
    assert len(out) == 3
    assert all(r.agent_id == "a" and r.x_m is None and r.role is None for r in out)
    assert [r.frame_id for r in out] == [1, 2, 3]


def test_resampling_twice_renews_the_flags(spark):
    df = table(spark, [{"time_s": t, "x_m": t} for t in (0.0, 0.1, 0.3)])
    once = resample_tracking(df)
    twice = resample_tracking(once.withColumn("vx_mps", F.lit(1.0)))
    assert len(set(twice.columns)) == len(twice.columns)
    assert not any(r.x_m_was_missing for r in twice.collect())
    assert sorted(r.x_m for r in twice.collect()) == pytest.approx([0.0, 0.1, 0.2, 0.3])


def test_arguments(spark):
    df = table(spark, [])
    assert resample_tracking(df).count() == 0
    with pytest.raises(ValueError):
        resample_tracking(df, 10.0, 0.01)
    with pytest.raises(ValueError):
        resample_tracking(df, 0.0)
