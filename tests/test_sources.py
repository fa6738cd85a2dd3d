import json

import pytest
from pyspark.sql import functions as F

from pitchspark.schema import EVENT_COLUMNS, TRACKING_COLUMNS
from pitchspark.sources import metrica, skillcorner, soccertrack, statsbomb
from pitchspark.sources.registry import PROVIDERS


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


TWO_ROWS = (
    "Period,Frame,Time [s],Player11,,Ball,\n"
    ",,,x,y,x,y\n"
    "1,0,0.0,0.10,0.20,0.50,0.50\n"
    "1,1,0.1,0.11,,0.51,0.50\n"
)
AWAY = (
    ",,,Away,,,\n"
    ",,,7,,,\n"
    "Period,Frame,Time [s],Player7,,Ball,\n"
    "1,0,0.0,0.30,0.40,0.99,0.99\n"
    "1,1,0.1,NaN,NaN,0.51,0.50\n"
)
ONE_ROW = "Period,Frame,Time [s],Player 2_x,Player 2_y,Ball_x,Ball_y\n2,5,1.5,0.5,0.5,1.2,0.5\n"


def test_metrica_tracking(spark, tmp_path):
    write(tmp_path / "game 1+a" / "RawData_TrackingData_Home.csv", TWO_ROWS)
    write(tmp_path / "game 1+a" / "RawData_TrackingData_Away.csv", AWAY)
    write(tmp_path / "game2" / "tracking_home.csv", ONE_ROW)
    df = metrica.read_tracking(spark, str(tmp_path))
    assert df.columns == TRACKING_COLUMNS
    rows = {(r.match_id, r.frame_id, r.agent_id): r for r in df.collect()}
    assert {k[0] for k in rows} == {"game 1+a", "game2"}
    assert {k[2] for k in rows} == {"home_player11", "away_player7", "ball", "home_player_2"}
    assert len(rows) == df.count() == 8
    r = rows["game 1+a", 0, "home_player11"]
    assert (r.x_m, r.y_m) == pytest.approx((10.5, 13.6))
    assert (r.team_id, r.jersey_number, r.role, r.agent_type) == ("home", 11, "player", "player")
    assert r.source_file.endswith("RawData_TrackingData_Home.csv")
    hidden = rows["game 1+a", 1, "home_player11"]
    assert hidden.y_m is None and hidden.x_m is not None and hidden.is_visible is False
    lost = rows["game 1+a", 1, "away_player7"]
    assert lost.x_m is None and lost.raw_x is None and lost.jersey_number == 7
    # The home file's ball wins.
    ball = rows["game 1+a", 0, "ball"]
    assert ball.x_m == pytest.approx(52.5) and ball.team_id == "ball" and ball.player_id is None
    assert rows["game2", 5, "ball"].x_m == pytest.approx(126.0)
    assert rows["game2", 5, "home_player_2"].period == 2


def test_metrica_keeps_every_match(spark, tmp_path):
    write(tmp_path / "flat" / "g1_Tracking_Home.csv", TWO_ROWS)
    write(tmp_path / "flat" / "g1_Tracking_Away.csv", AWAY)
    write(tmp_path / "flat" / "g2_Tracking_Home.csv", ONE_ROW)
    write(tmp_path / "a" / "game" / "tracking_home.csv", ONE_ROW)
    write(tmp_path / "b" / "game" / "tracking_home.csv", TWO_ROWS)
    with pytest.warns(UserWarning, match="3 of 4 Metrica matches .* no away"):
        rows = metrica.read_tracking(spark, str(tmp_path)).collect()
    agents = {}
    for r in rows:
        agents.setdefault(r.match_id, set()).add(r.agent_id)
    assert agents == {
        "g1": {"home_player11", "away_player7", "ball"}, "g2": {"home_player_2", "ball"},
        "a/game": {"home_player_2", "ball"}, "b/game": {"home_player11", "ball"},
    }
    assert len(rows) == 6 + 2 + 2 + 4
    for chosen, count in (("g1", 6), ("g2", 2), ("b/game", 4)):
        got = metrica.read_tracking(spark, str(tmp_path), chosen)
        assert {r.match_id for r in got.collect()} == {chosen} and got.count() == count
    for chosen in ("game", "flat", "other"):
        with pytest.raises(ValueError, match=f"match id {chosen}"):
            metrica.read_tracking(spark, str(tmp_path), chosen)


def test_metrica_single_match_takes_the_name(spark, tmp_path):
    write(tmp_path / "x" / "tracking_home.csv", TWO_ROWS)
    assert {r.match_id for r in metrica.read_tracking(spark, str(tmp_path), "m1").collect()} == {"m1"}
    write(tmp_path / "x" / "home_tracking.csv", ONE_ROW)
    with pytest.raises(ValueError, match="two files of one role"):
        metrica.read_tracking(spark, str(tmp_path))


def test_metrica_keeps_the_first_line(spark, tmp_path):
    """Of repeated frames the first line, even if it is empty; of repeated agents the first pair."""
    header = "Period,Frame,Time [s],P 1_x,P 1_y,P-1_x,P-1_y,Ball_x,Ball_y\n"
    write(tmp_path / "g" / "tracking_home.csv", header
          + "1,0,0.0,0.9,0.9,0.1,0.1,0.5,0.5\n1,0,0.0,0.1,0.1,0.1,0.1,0.1,0.1\n"
          + "1,1,0.1,,,,,,\n1,1.0,0.10,0.3,0.3,0.3,0.3,0.3,0.3\n")
    write(tmp_path / "g" / "tracking_away.csv",
          "Period,Frame,Time [s],Q_x,Q_y,Ball_x,Ball_y\n1,1,0.1,0.2,0.2,0.7,0.7\n1,2,0.2,,,0.8,0.8\n")
    rows = metrica.read_tracking(spark, str(tmp_path)).collect()
    got = {(r.frame_id, r.agent_id): r.raw_x for r in rows}
    assert len(rows) == len(got) and got == {
        (0, "home_p_1"): 0.9, (0, "ball"): 0.5, (1, "home_p_1"): None, (1, "ball"): None,
        (1, "away_q"): 0.2, (2, "away_q"): None, (2, "ball"): 0.8,
    }


def test_metrica_quoted_cells(spark, tmp_path):
    write(tmp_path / "g" / "tracking_home.csv",
          'Period,Frame,Time [s],"Doe, J 1",,Ball,\n,,,x,y,x,y\n1,0,"0.0",0.1,"0.2",0.5,0.5\n')
    rows = {r.agent_id: r for r in metrica.read_tracking(spark, str(tmp_path)).collect()}
    assert set(rows) == {"home_doe_j_1", "ball"}
    assert (rows["home_doe_j_1"].raw_y, rows["ball"].raw_x) == (0.2, 0.5)


def test_metrica_many_files_plan_gives_the_same_rows(spark, tmp_path):
    write(tmp_path / "a" / "tracking_home.csv", TWO_ROWS)
    write(tmp_path / "b" / "tracking_away.csv", AWAY)
    lines = spark.read.text([str(p) for p in tmp_path.rglob("*.csv")]).select(
        "value", F.input_file_name().alias("source_file"), F.lit("m").alias("match_id"),
        F.lit("home").alias("team"), F.monotonically_increasing_id().alias("line_pos"),
    )
    few = metrica.tracking_from_lines(lines, True)
    many = metrica.tracking_from_lines(lines, False)
    assert few.count() == 8
    assert few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0


def test_metrica_bad_header_and_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        metrica.read_tracking(spark, str(tmp_path / "nowhere"))
    write(tmp_path / "tracking_home.csv", "a,b,c\nd,e,f\n1,2,3\n")
    with pytest.raises(Exception, match="cannot read the tracking header"):
        metrica.read_tracking(spark, str(tmp_path)).collect()


def test_metrica_wide_table(spark):
    wide = spark.createDataFrame(
        [(1, 0, 0.0, 0.10, 0.20, "0.5", "bad")],
        ["Period", " frame", "Time [s]", "Player11_x", "Player11.Y", "Match Ball x", "Match Ball y"],
    )
    rows = {r.agent_id: r for r in metrica.tracking_from_wide(wide, "away", "m", "f").collect()}
    assert set(rows) == {"away_player11", "ball"}
    assert rows["away_player11"].y_m == pytest.approx(13.6)
    assert rows["ball"].x_m == 52.5 and rows["ball"].y_m is None
    with pytest.raises(ValueError):
        metrica.tracking_from_wide(wide.drop("Period"), "home", "m")
    assert metrica.tracking_from_wide(wide.select("Period", " frame", "Time [s]"), "home", "m"
                                      ).count() == 0


def test_metrica_events(spark, tmp_path):
    write(
        tmp_path / "g" / "RawEventsData.csv",
        "Team,Type,Subtype,Period,Start Frame,Start Time [s],End Frame,End Time [s],From,To,"
        "Start X,Start Y,End X,End Y\n"
        "Away,SET PIECE,KICK OFF,1,1,0.04,0,0,,,NaN,NaN,NaN,NaN\n"
        "Home,PASS,,1,3,0.12,4,0.2,Player9,Player8,0.5,0.25,1.0,0.5\n",
    )
    df = metrica.read_events(spark, str(tmp_path))
    assert df.columns == EVENT_COLUMNS
    first, second = df.orderBy("frame_id").collect()
    assert first.team_id == "away" and first.x_m is None and first.player_id is None
    assert (second.x_m, second.y_m, second.end_x_m, second.end_y_m) == (52.5, 17.0, 105.0, 34.0)
    assert (second.match_id, second.player_id, second.event_subtype) == ("g", "Player9", None)
    raw = json.loads(second.raw_event)
    assert raw["Subtype"] is None and raw["Start Frame"] == 3 and raw["To"] == "Player8"
    assert metrica.read_events(spark, str(tmp_path / "none")).count() == 0
    # Other columns in another order, quotes, and a column that is text in some rows only.
    write(
        tmp_path / "h" / "RawEventsData.csv",
        'From,"Start, note",Start Y,Start X,Period,Type,Team,Start Frame\n'
        'Player1,"say ""x"", y",0.5,0.5,2,SHOT,HOME,7\n7,plain,,,2,12,Away,8\n',
    )
    by_match = {r.match_id: [] for r in metrica.read_events(spark, str(tmp_path)).collect()}
    for r in metrica.read_events(spark, str(tmp_path)).orderBy("frame_id").collect():
        by_match[r.match_id].append(r)
    assert [len(by_match[m]) for m in ("g", "h")] == [2, 2]
    shot, other = by_match["h"]
    assert (shot.period, shot.team_id, shot.event_type, shot.x_m, shot.y_m) == (2, "home", "SHOT", 52.5, 34.0)
    assert shot.time_s is None and shot.player_id == "Player1"
    assert json.loads(shot.raw_event) == {
        "From": "Player1", "Start, note": 'say "x", y', "Start Y": 0.5, "Start X": 0.5, "Period": 2,
        "Type": "SHOT", "Team": "HOME", "Start Frame": 7,
    }
    assert (other.player_id, other.event_type, other.x_m) == ("7", "12", None)
    assert by_match["g"][1].event_type == "PASS" and by_match["g"][1].frame_id == 3


def test_skillcorner(spark, tmp_path):
    frames = [
        {"frame": 1, "timestamp": 0.1, "period": 1, "ball_data": {"x": 0.0, "y": 0.0},
         "player_data": [
             {"player_id": 5, "group": "home team", "number": 9, "x": 10, "y": 4,
              "is_detected": False},
             {"player_id": 6, "group": "", "team": "away", "x": None, "y": 4, "is_detected": None},
         ]},
        {"frame": 2, "timestamp": "00:01:02.50", "period": None, "ball_data": {},
         "player_data": None},
        {"frame": 3, "timestamp": "00:01:02.50", "period": 2, "ball_data": {"x": None}},
    ]
    write(tmp_path / "11" / "11_tracking_extrapolated.jsonl",
          "\n".join(json.dumps(f) for f in frames) + "\n")
    write(tmp_path / "22" / "tracking.jsonl", json.dumps(frames[0]) + "\n")
    df = skillcorner.read_tracking(spark, str(tmp_path))
    rows = {(r.match_id, r.frame_id, r.agent_id): r for r in df.collect()}
    assert len(rows) == 7
    ball = rows["11", 1, "ball"]
    assert (ball.x_m, ball.y_m, ball.is_visible, ball.team_id) == (52.5, 34.0, True, "ball")
    five = rows["11", 1, "5"]
    assert (five.x_m, five.y_m, five.raw_y, five.jersey_number) == (62.5, 30.0, 4.0, 9)
    assert five.is_visible is False and five.team_id == "home team" and five.player_id == "5"
    six = rows["11", 1, "6"]
    assert six.x_m is None and six.y_m is None and six.raw_y == 4.0
    assert six.team_id == "away" and six.is_visible is None
    assert rows["11", 3, "ball"].time_s is None
    timed = skillcorner.read_tracking(spark, str(tmp_path), clock_times=True)
    assert timed.where("frame_id = 3").first().time_s == 62.5
    for chosen, count in (("11", 4), ("22", 3)):
        one = skillcorner.read_tracking(spark, str(tmp_path), chosen)
        assert {r.match_id for r in one.collect()} == {chosen} and one.count() == count
    with pytest.raises(ValueError, match="no SkillCorner matches .* match id m"):
        skillcorner.read_tracking(spark, str(tmp_path), "m")
    named = skillcorner.read_tracking(spark, str(tmp_path / "22"), "m")
    assert {r.match_id for r in named.collect()} == {"m"} and named.count() == 3
    write(tmp_path / "x" / "11" / "tracking.jsonl", json.dumps(frames[0]) + "\n")
    with pytest.raises(ValueError, match="several SkillCorner matches"):
        skillcorner.read_tracking(spark, str(tmp_path), "11")
    with pytest.raises(FileNotFoundError):
        skillcorner.read_tracking(spark, str(tmp_path / "22" / "none"))


def test_statsbomb(spark, tmp_path):
    events = [
        {"period": 1, "minute": 2, "second": 3, "location": [60.0, 40.0, 1.0],
         "team": {"id": 1, "name": "A"}, "player": {"id": 77, "name": "p"},
         "type": {"id": 30, "name": "Pass"}, "note": '{"end_location": [1, 1]} said',
         "pass": {"length": 3, "end_location": [120.0, 80.0]},
         "carry": {"end_location": [0.0, 0.0]}},
        {"period": 2, "minute": None, "location": [1.0], "type": {"name": "Start"}},
    ]
    write(tmp_path / "data" / "events" / "42.json", json.dumps(events, indent=1))
    write(tmp_path / "other" / "events" / "43.json", json.dumps(events))
    df = statsbomb.read_events(spark, str(tmp_path))
    first, second = df.orderBy("period").collect()
    assert (first.match_id, first.time_s, first.team_id, first.player_id) == ("42", 123.0, "A", "77")
    assert (first.x_m, first.y_m, first.end_x_m, first.end_y_m) == (52.5, 34.0, 105.0, 68.0)
    assert first.event_type == "Pass" and json.loads(first.raw_event) == events[0]
    assert second.time_s == 0.0 and second.x_m is None and second.end_x_m is None
    assert second.team_id is None and second.frame_id is None
    assert statsbomb.read_events(spark, str(tmp_path / "other")).first().match_id == "43"
    assert statsbomb.read_events(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(NotImplementedError):
        PROVIDERS["statsbomb"].read_tracking(spark, str(tmp_path))


def test_soccertrack_mapping(spark):
    raw = spark.createDataFrame(
        [(3, 8, "left", 1.0, 2.0, "referee")],
        ["image_id", "track_id", "team_side", "x", "y", "role"],
    )
    r = soccertrack.annotations_to_tracking(raw, F.lit("m")).first()
    assert (r.frame_id, r.agent_id, r.team_id, r.x_m, r.role) == (3, "8", "left", 1.0, "referee")
