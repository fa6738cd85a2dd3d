import random

import pytest

from pitchspark.operators import windows
from pitchspark.operators.windows import (
    WindowConfig,
    agent_slots,
    build_windows,
    time_index,
    window_cells,
    window_meta,
)
from tests.helpers import as_set, table


def rows():
    rng = random.Random(4)
    out = []
    for match, n in (("m1", 17), ("m2", 7), ("m3", 3)):
        for i in range(n):
            t = 10000.0 * (i // 9) + i * 0.5
            for agent, team, kind in [
                ("home_2", "home", "player"), ("home_10", "home", "player"),
                ("away_1", "away", "player"), ("x", None, "player"),
                ("ball", "ball", "ball"), ("ball2", "ball", "ball"), ("ref", None, "referee"),
            ]:
                if rng.random() < 0.8:
                    out.append({"match_id": match, "frame_id": i, "time_s": t, "agent_id": agent,
                                "team_id": team, "agent_type": kind,
                                "x_m": None if rng.random() < 0.2 else rng.uniform(0, 105),
                                "y_m": rng.uniform(0, 68)})
                    if rng.random() < 0.2:
                        out.append({**out[-1], "frame_id": None, "x_m": rng.uniform(0, 105)})
            out.append({"match_id": match, "frame_id": i, "time_s": t, "agent_id": "ref",
                        "agent_type": "referee"})
    # Switched sides: the agent takes a slot on both.
    out.append({"match_id": "m1", "frame_id": 3, "time_s": 1.5, "agent_id": "home_2",
                "team_id": "away", "x_m": 1.0})
    out.append({"match_id": "m1", "frame_id": 3, "time_s": None, "agent_id": "home_2"})
    return out


def brute(rows, h, f, max_agents, stride):
    out = []
    for match in sorted({r["match_id"] for r in rows}):
        own = [r for r in rows if r["match_id"] == match]
        times = sorted({r["time_s"] for r in own if r["time_s"] is not None})

        def key(agent):
            head = agent.rstrip("0123456789")
            return head, int(agent[len(head):] or -1)

        slots = []
        for side in ("home", "away", None):
            slots += sorted({r["agent_id"] for r in own
                             if r.get("agent_type", "player") == "player"
                             and (r.get("team_id", "home") == side)}, key=key)
        balls = sorted({r["agent_id"] for r in own if r.get("agent_type") == "ball"}, key=key)
        slots = slots[: max_agents - 1] + balls[:1] if balls else slots[:max_agents]
        slots += [""] * (max_agents - len(slots))
        for start in range(0, len(times) - h - f + 1, stride):
            for step in range(h + f):
                t = times[start + step]
                for slot, agent in enumerate(slots):
                    at = [r for r in own if r["time_s"] == t and r["agent_id"] == agent]
                    at.sort(key=lambda r: (r["frame_id"] is None, r["frame_id"] or 0,
                                           r["x_m"] is None, r["x_m"] or 0))
                    x = at[-1]["x_m"] if at else None
                    out.append((match, round(times[start], 6), step, slot, agent,
                                None if x is None else round(x, 6), x is not None))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("max_agents, stride, block", [(6, 1, 256), (3, 2, 1), (9, 3, 4), (1, 9, 2)])
def test_windows_match_brute_force(spark, monkeypatch, max_agents, stride, block):
    monkeypatch.setattr(windows, "BLOCK_STEPS", block)
    df = table(spark, rows())
    cfg = WindowConfig(1.0, 1.5, 2.0, max_agents, stride)
    built = build_windows(df, cfg=cfg)
    cells = window_cells(built).selectExpr(
        "match_id", "start_time_s", "step", "slot", "agent_id", "values[0] as x", "mask"
    )
    assert as_set(cells) == brute(rows(), 2, 3, max_agents, stride)
    meta = window_meta(df, cfg)
    assert as_set(meta) == as_set(built, meta.columns)


def test_shapes_and_metadata(spark):
    df = table(spark, rows())
    cfg = WindowConfig(1.0, 1.0, 2.0, 23)
    w = build_windows(df, cfg=cfg, feature_names=["x_m", "y_m", "no_such"])
    r = w.first()
    assert (len(r.x_history), len(r.x_history[0]), len(r.x_history[0][0])) == (2, 23, 3)
    assert (len(r.y_future), len(r.y_future[0]), len(r.y_future[0][0])) == (2, 23, 2)
    assert len(r.mask_history) == 2 and len(r.mask_future[0]) == 23 and len(r.agent_ids) == 23
    assert all(v[2] is None for step in r.x_history for v in step)
    assert w.schema["x_history"].metadata == {"names": ["x_m", "y_m", "no_such"]}
    assert (r.history_steps, r.future_steps, r.fps) == (2, 2, 2.0)


def test_features_are_the_source_when_given(spark):
    tracking = table(spark, [])
    features = table(spark, [{"time_s": float(i), "frame_id": i, "x_m": 1.0} for i in range(4)])
    assert build_windows(tracking, features, WindowConfig(1, 1, 1)).count() == 3
    assert build_windows(tracking, None, WindowConfig(1, 1, 1)).count() == 0


def test_slots_are_cut_before_the_shuffle(spark):
    plan = agent_slots(table(spark, rows()), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_time_index_spans_slices(spark):
    got = as_set(time_index(table(spark, rows())).where("match_id = 'm1'"), ["idx", "time_s", "n"])
    times = sorted({r["time_s"] for r in rows() if r["match_id"] == "m1"
                    and r["time_s"] is not None})
    assert sorted(got) == [(i, t, len(times)) for i, t in enumerate(times)]


@pytest.mark.parametrize("bad", [
    {"history_s": 0}, {"future_s": -1}, {"fps": 0}, {"max_agents": 0}, {"stride_steps": 0},
    {"history_s": 0.01},
])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        WindowConfig(**bad)


def test_steps_round_half_to_even():
    assert WindowConfig(0.25, 0.35, 10.0).history_steps == 2
    assert WindowConfig(0.25, 0.35, 10.0).future_steps == 4
