import math
import random

import pytest
from pyspark.sql import functions as F

from pitchspark.functions.labels import find_column, natural_key, sanitize_label, trailing_number
from pitchspark.operators import clips, pitch, quality
from pitchspark.operators.rollout import constant_velocity_rollout
from pitchspark.operators.skew import HotKeys, attach
from pitchspark.schema import (
    EVENT_COLUMNS,
    TRACKING_COLUMNS,
    TRACKING_SCHEMA,
    canonical_events,
    canonical_tracking,
    ensure_columns,
    order_columns,
    validate_tracking_schema,
)
from pitchspark.functions.coordinates import to_meters_from_normalized
from tests.helpers import as_set, table


def test_canonical_tracking(spark):
    raw = spark.createDataFrame(
        [("7", "1.0", "2.5", "abc", float("nan"), 3, "true", "e"),
         ("8", "2", " 3 ", "4.5", math.inf, None, "maybe", "f")],
        "match_id string, period string, frame_id string, x_m string, y_m double, "
        "agent_id int, is_visible string, extra string",
    )
    df = canonical_tracking(raw)
    assert df.columns == TRACKING_COLUMNS + ["extra"]
    assert [f.dataType for f in df.schema][:18] == [f.dataType for f in TRACKING_SCHEMA]
    a, b = df.orderBy("match_id").collect()
    assert (a.period, a.frame_id, a.x_m, a.y_m, a.agent_id, a.is_visible) == (
        1, None, None, None, "3", True)
    assert (b.period, b.frame_id, b.x_m, b.y_m, b.agent_id, b.is_visible, b.extra) == (
        2, 3, 4.5, math.inf, None, None, "f")


def test_canonical_events_and_column_order(spark):
    df = canonical_events(spark.createDataFrame([(1.5, "x")], "time_s double, other string"))
    assert df.columns == EVENT_COLUMNS + ["other"]
    assert order_columns(df.select("other", "x_m"), EVENT_COLUMNS).columns == ["x_m", "other"]
    assert ensure_columns(df.select("other"), TRACKING_SCHEMA).columns == TRACKING_COLUMNS + ["other"]


def test_validation(spark):
    good = table(spark, [{"agent_type": "ball"}, {"agent_type": None}])
    checked = validate_tracking_schema(good)
    assert checked.missing_columns == [] and checked.invalid_agent_types.count() == 0
    assert checked.summary.first().ok
    bad = table(spark, [{"agent_type": "zebra"}, {"agent_type": "cat"}, {"agent_type": "cat"}])
    checked = validate_tracking_schema(bad.drop("role"))
    assert checked.missing_columns == ["role"]
    assert as_set(checked.invalid_agent_types) == [("cat",), ("zebra",)]
    assert checked.summary.first().asDict() == {
        "ok": False, "missing_columns": ["role"], "invalid_agent_types": 2}
    assert not validate_tracking_schema(good.drop("agent_type")).summary.first().ok


def test_coordinates(spark):
    df = spark.createDataFrame([(0.5, 0.25)], "x double, y double")
    x, y = to_meters_from_normalized(F.col("x"), F.col("y"))
    assert tuple(df.select(x, y).first()) == (52.5, 17.0)


def test_bounds_clip_and_flip(spark):
    df = spark.createDataFrame(
        [(0.0, 34.0, 1.0), (106.0, 12.0, -2.0), (None, 99.0, None), (105.0, -1.0, 0.5)],
        "x_m double, y_m double, vx_mps double",
    )
    report = pitch.validate_pitch_bounds(df).first()
    assert not report.ok and report.out_of_bounds_rows == 2
    assert as_set(pitch.out_of_bounds_rows(df)) == [(105.0, -1.0), (106.0, 12.0)]
    assert as_set(pitch.clip_to_pitch(df), ["x_m", "y_m"]) == [
        (0.0, 34.0), (105.0, 0.0), (105.0, 12.0), (None, 68.0)]
    assert as_set(pitch.flip_left_to_right(df)) == [
        (-1.0, 56.0, 2.0), (0.0, 69.0, -0.5), (105.0, 34.0, -1.0), (None, -31.0, None)]
    missing = pitch.validate_pitch_bounds(df.drop("x_m")).first()
    assert not missing.ok and missing.out_of_bounds_rows == 0
    assert pitch.validate_pitch_bounds(df.where("false")).first().ok


def test_labels(spark):
    df = spark.createDataFrame([("Player 11",), ("__",), ("a-b_9c",), ("P_2",)], "s string")
    got = {r[0]: (r[1], r[2]) for r in df.select(
        "s", sanitize_label(F.col("s")), trailing_number(F.col("s"))).collect()}
    assert got == {"Player 11": ("player_11", 11), "__": ("unknown", None),
                   "a-b_9c": ("a_b_9c", None), "P_2": ("p_2", 2)}
    ids = spark.createDataFrame([(s,) for s in ("p_10", "p_2", "p", "o_99")], "s string")
    assert [r.s for r in ids.orderBy(*natural_key(F.col("s"))).collect()] == [
        "o_99", "p", "p_2", "p_10"]
    assert find_column(["Start X", "start_x", "Frame"], ["Nope", "Start x"]) == "start_x"
    assert find_column(["a"], ["b"]) is None


@pytest.mark.parametrize("hot_rows, slice_rows", [(None, 9), (0, 6)])
def test_frame_monotonicity(spark, hot_rows, slice_rows):
    def series(agent, pairs):
        return [{"agent_id": agent, "time_s": t, "frame_id": f} for t, f in pairs]

    df = table(spark, (
        series("up", [(0.0, 1), (1.0, 2), (5.0, 2), (9.0, 7)])
        + series("down", [(0.0, 5), (1.0, 6), (2.5, 4)])
        + series("tie", [(0.0, 5), (0.0, 1), (1.0, 5), (1.0, 9)])
        + series("tie_down", [(0.0, 5), (0.0, 1), (1.0, 4)])
        + series("hole", [(0.0, 5), (1.0, None), (2.0, 1)])
        + series("untimed", [(0.0, 5), (None, 3), (None, 4)])
        + series("untimed_up", [(0.0, 2), (None, 3), (None, 4)])
    ))
    out = quality.frame_monotonicity(df, hot_rows, slice_rows)
    assert [r[2] for r in as_set(out)] == ["down", "tie_down", "untimed"]
    assert out.first().issue == "frame_id decreases"


def test_quality_report(spark):
    rows = [{"frame_id": i, "time_s": float(i), "x_m": x, "y_m": 0.0, "agent_id": a,
             "agent_type": k}
            for a, k, step in [("walk", "player", 1.0), ("run", "player", 12.5),
                               ("ball", "ball", 30.0), ("who", None, 13.0)]
            for i, x in enumerate([0.0, step, 2 * step])]
    rows.append({"agent_id": None, "x_m": None, "y_m": 1.0, "frame_id": 5})
    df = table(spark, rows)
    report = quality.check_quality(df)
    fast = as_set(report.impossible_speeds)
    assert {(r[2], r[4]) for r in fast} == {("run", 12.0), ("who", 12.0)} and len(fast) == 6
    assert ("nan", 1, 1, 0) in as_set(report.missingness_by_agent)
    assert report.summary.first().asDict() == {
        "ok": False, "frame_issues": 0, "speed_issues": 6, "out_of_bounds_rows": 0}
    assert report.coordinate_bounds.first().ok
    clean = quality.check_quality(df.where("agent_id in ('walk', 'ball')"))
    assert clean.summary.first().ok
    given = quality.check_quality(df.withColumn("speed_mps", F.lit(99.0)))
    assert given.impossible_speeds.count() == df.count()


def test_rollout(spark):
    df = spark.createDataFrame(
        [(1, 100.0, 67.0, 10.0, 2.0), (2, None, 1.0, 1.0, None)],
        "id int, x_m double, y_m double, vx_mps double, vy_mps double",
    )
    out = constant_velocity_rollout(df, 2, 0.5)
    assert as_set(out, ["id", "step", "pred_x_m", "pred_y_m"]) == [
        (1, 1, 105.0, 68.0), (1, 2, 105.0, 68.0), (2, 1, None, None), (2, 2, None, None)]
    free = constant_velocity_rollout(df, 2, 0.5, clip_players=False)
    assert as_set(free.where("id = 1"), ["step", "pred_x_m", "pred_y_m"]) == [
        (1, 105.0, 68.0), (2, 110.0, 69.0)]
    assert constant_velocity_rollout(df, 0, 0.5).count() == 0


def test_clips_and_trails(spark):
    rng = random.Random(8)
    rows = []
    for match in ("a", None):
        for i in range(40):
            for agent in ("p", "q", "ball", None):
                if rng.random() < 0.5:
                    rows.append({"match_id": match, "period": 1 + i % 2, "frame_id": i,
                                 "time_s": i / 10, "agent_id": agent,
                                 "x_m": rng.uniform(0, 105)})
    df = table(spark, rows + rows[:5])
    rows = rows + rows[:5]
    clip = clips.clip_rows(df, 0.3, 3.1)
    inside = [r for r in rows if 0.3 <= r["time_s"] <= 0.3 + 3.1]
    assert clip.count() == len(inside)
    assert clips.clip_rows(df, 0.3, 3.1, period=2).count() == sum(
        r["period"] == 2 for r in inside)
    with pytest.raises(ValueError):
        clips.clip_rows(df, 500.0, 1.0, require_rows=True)
    frames = sorted({(r["match_id"] or "", r["time_s"], r["frame_id"], r["period"])
                     for r in inside})
    assert [(r.match_id or "", r.time_s, r.frame_id, r.period)
            for r in clips.clip_frames(clip).collect()] == frames
    for trail in (0.3, 0.1, 0.0):
        want = []
        for match, t, frame, period in frames:
            for agent in ("p", "q"):
                near = [r for r in inside if (r["match_id"] or "") == match
                        and r["agent_id"] == agent and t - trail <= r["time_s"] <= t]
                if len(near) > 1:
                    want += [(match, period, frame, agent, r["frame_id"], round(r["x_m"], 6))
                             for r in near]
        for hot_rows in (None, 0, 8):
            got = clips.agent_trails(clip, trail, hot_rows).select(
                F.coalesce("match_id", F.lit("")), "period", "frame_id", "agent_id",
                "point_frame_id", "x_m")
            assert as_set(got) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
            slices = clips.agent_trail_slices(clip, trail, hot_rows, most=4096 if hot_rows else 3)
            got = slices.select(
                F.coalesce("match_id", F.lit("")).alias("m"), "period", "frame_id", "agent_id", F.inline("trail")
            ).select("m", "period", "frame_id", "agent_id", "point_frame_id", "x_m")
            assert as_set(got) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
            for r in slices.collect():
                times = [p.point_time_s for p in r.trail]
                assert times == sorted(times)
                assert r.part == 0 or not hot_rows


def test_hot_keys_and_attach(spark):
    df = spark.createDataFrame(
        [(None, i) for i in range(6)] + [("b", 1), ("c", 1)], "k string, v int")
    hot = HotKeys(df, ["k"], 5)
    assert hot.any and hot.few
    assert hot.hot(df).count() == 6 and hot.cool(df).count() == 2
    assert not HotKeys(df, ["k"], 6).any and not HotKeys(df, ["k"], None).any
    side = spark.createDataFrame([(None, "n"), ("b", "B")], "k string, name string")
    for few in (True, False):
        out = attach(df, side, ["k"], few, F.col("v"))
        assert out.columns == ["k", "v", "name"]
        assert out.where("name = 'n'").count() == 6 and out.where("name is null").count() == 1


def test_attached_copies_are_not_broadcast(spark):
    """Small as the lookup is, its copies don't go over the driver; with the heavy keys known, only theirs
    are made, and the rows are the same."""
    df = spark.createDataFrame(
        [(None, i) for i in range(6)] + [("b", i) for i in range(4)] + [("c", 1)], "k string, v int")
    side = spark.createDataFrame([(None, "n"), ("b", "B"), ("d", "D")], "k string, name string")
    want = as_set(attach(df, side, ["k"], True, F.col("v")))
    for heavy in (None, HotKeys(df, ["k"], 5), HotKeys(df, ["k"], 100)):
        out = attach(df, side, ["k"], False, F.col("v"), heavy=heavy)
        plan = out._jdf.queryExecution().executedPlan().toString()
        # The heavy keys themselves, checked to be few, are broadcast to be told from the others.
        assert all("_hot_k" in line or "LeftAnti" in line or "LeftSemi" in line
                   for line in plan.splitlines() if "BroadcastHashJoin" in line)
        assert "SortMergeJoin" in plan and as_set(out) == want


def test_quality_summary_scans_once(spark, tmp_path):
    """The plan of the summary has one scan and one shuffle by series, and its row is that of the parts."""
    rng = random.Random(3)
    rows = [
        {"match_id": rng.choice("ab"), "period": rng.choice([1, 2, None]), "agent_id": rng.choice(["x", "y", None]),
         "frame_id": rng.choice([i, i - 3, None]), "time_s": rng.choice([i / 10, i / 10, None]),
         "x_m": rng.choice([rng.uniform(-5, 110), None]), "y_m": rng.uniform(0, 69),
         "agent_type": rng.choice(["player", "ball"])}
        for i in range(400)
    ]
    for some in (rows, rows[:1], []):
        path = str(tmp_path / f"t{len(some)}")
        table(spark, some).write.parquet(path)
        df = spark.read.parquet(path)
        report = quality.check_quality(df)
        want = quality.summarised(report.frame_monotonicity, report.impossible_speeds, report.coordinate_bounds)
        assert report.summary.collect() == want.collect()
        plan = report.summary._jdf.queryExecution().executedPlan().toString()
        plan = plan.partition("Initial Plan")[2] or plan
        assert plan.count("FileScan") == 1 and plan.count("hashpartitioning") == 1
        split = quality.check_quality(df, hot_rows=0).summary.collect()
        assert split == want.collect()
