"""Streams against the batch operators and against what is known of their rows."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchspark.operators.frames import add_distance_to_ball, team_shape
from pitchspark.operators.kinematics import KINEMATICS, add_kinematics
from pitchspark.schema import canonical_tracking
from pitchspark.streaming import live

COLUMNS = ("match_id string, period int, agent_id string, agent_type string, team_id string, frame_id long, "
           "time_s double, x_m double, y_m double, at_s double")
KEY = ["match_id", "period", "agent_id", "frame_id", "time_s"]


def walk(seed, frames=40):
    """Three matches with uneven steps and different clocks; every row of a frame is taken at once."""
    rng, rows = random.Random(seed), []
    for m in range(3):
        t = 0.0
        for frame in range(frames):
            t += rng.choice([0.04, 0.1, 0.1, 0.25])
            for agent, kind, team in [("ball", "ball", "ball"), ("h1", "player", "home"), ("h2", "player", "home"),
                                      ("a1", "player", "away")]:
                if rng.random() < 0.9:
                    rows.append((f"m{m}", 1 + frame // 25, agent, kind, team, frame, t,
                                 rng.uniform(0, 105), rng.uniform(0, 68), 1000 + t))
    return rows


def play(spark, path, parts, operator):
    """Write the parts one after the other, stream them a file a batch, and read what came out."""
    for rows in parts:
        df = spark.createDataFrame(rows, COLUMNS).withColumn("at", F.timestamp_seconds("at_s")).drop("at_s")
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = operator(stream, "at")
    query = live.run_available(out, f"{path}/out", f"{path}/state")
    return spark.read.schema(out.schema).parquet(f"{path}/out"), query


def cut(rows, n):
    """Parts in the order of the moments, shuffled within, and a row that moves the watermark past all."""
    rows = sorted(rows, key=lambda r: r[-1])
    parts = [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]
    for part in parts:
        random.Random(len(part)).shuffle(part)
    return [*parts, [("end", 1, "x", "player", "t", 0, 0.0, 1.0, 1.0, 9999.0)]]


def by_key(df, columns):
    return {tuple(r[k] for k in KEY): [r[c] for c in columns] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, values in want.items():
        for a, b in zip(got[key], values, strict=True):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), key


@pytest.mark.parametrize("batches", [1, 7])
def test_derivatives_are_those_of_the_batch(spark, tmp_path, batches):
    rows = walk(1)
    got, _ = play(spark, str(tmp_path), cut(rows, batches), live.stream_kinematics)
    want = add_kinematics(canonical_tracking(spark.createDataFrame(rows, COLUMNS).drop("at_s")))
    same(by_key(got, KINEMATICS), by_key(want, KINEMATICS))
    assert not got.where("late OR frame_falls").count()


def test_late_rows_falling_frames_and_short_series(spark, tmp_path):
    def row(agent, frame, t, x=1.0, at=None):
        return ("m", 1, agent, "player", "t", frame, t, x, 2.0, 1000.0 + (t if at is None else at))

    parts = [
        [row("a", 1, 0.0), row("a", 2, 1.0, 3.0), row("b", 7, 0.0)],
        [row("a", 5, 3.0, 4.0), row("a", 9, 0.5, at=3), ("m", 1, "a", "player", "t", 10, None, 1.0, 1.0, 1003.0)],
        [row("a", 4, 4.0, None), row("c", 1, 4.0, float("nan"))],
    ]
    parts.append([("end", 1, "x", "player", "t", 0, 0.0, 1.0, 1.0, 9999.0)])
    out, _ = play(spark, str(tmp_path), parts, live.stream_kinematics)
    rows = {(r.agent_id, r.frame_id): r for r in out.where("match_id = 'm'").collect()}
    assert len(rows) == 8
    assert {k for k, r in rows.items() if r.late} == {("a", 9), ("a", 10)}
    assert all(rows["a", f].vx_mps is None for f in (9, 10))
    assert {k for k, r in rows.items() if r.frame_falls} == {("a", 4)}
    assert rows["a", 1].vx_mps == 2.0 and rows["a", 2].vx_mps == pytest.approx(2.0 * 2 / 3 + 0.5 / 3)
    assert rows["a", 5].vx_mps is None and rows["a", 4].vx_mps is None and rows["a", 4].x_m is None
    for one in (rows["b", 7], rows["c", 1]):
        assert (one.vx_mps, one.ay_mps2, one.speed_mps) == (0.0, 0.0, 0.0)
    assert rows["c", 1].x_m is None


def test_a_silent_series_ends_and_begins_anew(spark, tmp_path):
    def row(t, x):
        return ("m", 1, "a", "player", "t", int(t), t, x, 0.0, 1000 + t)

    parts = [[row(0.0, 0.0), row(1.0, 1.0)], [("n", 1, "b", "player", "t", 0, 0.0, 0.0, 0.0, 1100.0)],
             [("n", 1, "b", "player", "t", 1, 1.0, 0.0, 0.0, 1101.0)], [row(100.0, 5.0), row(101.0, 8.0)],
             [("end", 1, "x", "player", "t", 0, 0.0, 1.0, 1.0, 9999.0)]]
    out, _ = play(spark, str(tmp_path), parts, live.stream_kinematics)
    got = {r.time_s: r.vx_mps for r in out.where("match_id = 'm'").collect()}
    assert got == {0.0: 1.0, 1.0: 1.0, 100.0: 3.0, 101.0: 3.0}


def test_shape_and_ball_are_those_of_the_batch(spark, tmp_path):
    rows = walk(2)
    batch = canonical_tracking(spark.createDataFrame(rows, COLUMNS).drop("at_s"))
    got, _ = play(spark, f"{tmp_path}/shape", cut(rows, 4), live.stream_team_shape)
    want = team_shape(batch)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got, _ = play(spark, f"{tmp_path}/ball", cut(rows, 4), live.stream_ball_distance)
    same(by_key(got, ["distance_to_ball_m"]), by_key(add_distance_to_ball(batch), ["distance_to_ball_m"]))


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    rows = walk(3)
    late = [(*r[:-1], 1.0) for r in rows[:5]]
    parts = cut(rows, 3)
    parts.append([*late, ("end", 1, "x", "player", "t", 1, 0.1, 1.0, 1.0, 10000.0)])
    _, query = play(spark, str(tmp_path), parts, live.stream_ball_distance)
    assert live.groups_too_late(query) == len({(r[0], r[1], r[5]) for r in late})


def test_an_interrupted_stream_goes_on(spark, tmp_path):
    """Half of the files, then the others with the same checkpoint: no row twice, none lost."""
    rows = walk(4)
    parts = cut(rows, 6)
    play(spark, str(tmp_path), parts[:3], live.stream_kinematics)
    got, _ = play(spark, str(tmp_path), parts[3:], live.stream_kinematics)
    want = add_kinematics(canonical_tracking(spark.createDataFrame(rows, COLUMNS).drop("at_s")))
    assert got.count() == len(rows)
    same(by_key(got, KINEMATICS), by_key(want, KINEMATICS))


class HeldState:
    """What ``_series`` asks of a group's state."""

    hasTimedOut = False

    def __init__(self):
        self.getOption = None

    @property
    def exists(self):
        return self.getOption is not None

    def update(self, held):
        self.getOption = held

    def remove(self):
        self.getOption = None

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, moment):
        self.moment = moment


def test_series_make_plain_tables_and_no_empty_ones():
    """A batch that readies no row makes no table, others have arrays of numbers as columns."""
    def batch(frames, times):
        return pd.DataFrame({"frame_id": frames, "time_s": times, "x_m": times, "y_m": 1.0,
                             "at": pd.to_datetime(1000 + np.array(times), unit="s")})

    run, state = live._series(10.0, "at"), HeldState()
    assert not list(run(("m", 1, "a"), iter([batch([1, 2], [0.0, 1.0])]), state))
    out, = run(("m", 1, "a"), iter([batch([4], [3.0]), batch([3], [2.0])]), state)
    assert out["time_s"].tolist() == [0.0, 1.0] and out["vx_mps"].tolist() == [1.0, 1.0]
    assert all(isinstance(out[c].dtype, np.dtype) for c in out.columns if c not in ("match_id", "agent_id"))
    assert state.moment == 1_013_000
    late, = run(("m", 1, "a"), iter([batch([None], [1.5])]), state)
    assert late["late"].all() and late["frame_id"].isna().all() and late["vx_mps"].isna().all()
    state.hasTimedOut = True
    last, = run(("m", 1, "a"), iter([]), state)
    assert last["time_s"].tolist() == [2.0, 3.0] and last["frame_id"].tolist() == [3, 4] and not state.exists
