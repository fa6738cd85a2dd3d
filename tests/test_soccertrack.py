"""SoccerTrack files of both shapes."""

import pytest

from pitchspark.schema import TRACKING_COLUMNS
from pitchspark.sources import soccertrack
from pitchspark.sources.registry import PROVIDERS

TREE = """TeamID,0,,,,0,,1,,ball,
PlayerID,3,,,,12,,3,,,
Attributes,x,y,conf,z,x,y,x,y,X,Y
frame,,,,,,,,,,
0,1.5,2.5,0.9,0.1,3,4,,nan,50,34
1,1.6,2.6,0.9,,3,oops,7,8,51,34

"""
FLAT = """image_id,track_id,"team side",x,y,role,jersey_number,time_s,period
5,p1,left,10,20,GK,1,0.2,2
6,Ball,,11,,ball,,0.24,2
"""


def by_key(df):
    return {(r.match_id, r.frame_id, r.agent_id): r for r in df.collect()}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "D_1.csv").write_text(TREE)
    (tmp_path / "flat.CSV").write_text(FLAT)
    (tmp_path / "notes.txt").write_text("nothing")
    return str(tmp_path)


def test_both_shapes_are_read(spark, folder):
    df = soccertrack.read_tracking(spark, folder, fps=10.0)
    assert df.columns == TRACKING_COLUMNS
    rows = by_key(df)
    assert len(rows) == df.count() == 2 * 4 + 2
    r = rows["D_1", 0, "0_3"]
    assert (r.x_m, r.y_m, r.z_m, r.team_id, r.jersey_number, r.agent_type) == (1.5, 2.5, 0.1, "0", 3, "player")
    assert (r.period, r.time_s, r.is_visible, r.dataset) == (1, 0.0, True, "soccertrack")
    r = rows["D_1", 0, "1_3"]
    assert (r.x_m, r.y_m, r.is_visible, r.player_id) == (None, None, False, "1_3")
    r = rows["D_1", 1, "0_12"]
    assert (r.x_m, r.y_m, r.is_visible, r.time_s) == (3.0, None, False, 0.1)
    r = rows["D_1", 1, "ball"]
    assert (r.x_m, r.agent_type, r.team_id, r.player_id, r.jersey_number) == (51.0, "ball", "ball", None, None)
    r = rows["flat", 5, "p1"]
    assert (r.x_m, r.y_m, r.team_id, r.role, r.jersey_number, r.time_s, r.period) == (10, 20, "left", "GK", 1, 0.2, 2)
    r = rows["flat", 6, "Ball"]
    assert (r.agent_type, r.team_id, r.is_visible) == ("ball", None, False)


def test_matches_are_chosen_by_name(spark, folder, tmp_path):
    assert {k[0] for k in by_key(soccertrack.read_tracking(spark, folder, "flat"))} == {"flat"}
    with pytest.raises(ValueError, match="none of 2"):
        soccertrack.read_tracking(spark, folder, "other")
    one = f"{folder}/a"
    assert {k[0] for k in by_key(soccertrack.read_tracking(spark, one, "mine"))} == {"mine"}
    with pytest.raises(FileNotFoundError):
        soccertrack.read_tracking(spark, f"{folder}/none")
    assert PROVIDERS["soccertrack"].read_tracking is soccertrack.read_tracking


def test_other_files_fail(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="annotation header"):
        soccertrack.read_tracking(spark, str(tmp_path)).collect()


def test_few_and_many_files_give_the_same(spark):
    lines = [("m", f"f{i}", j, line) for i, text in enumerate((TREE, FLAT)) for j, line in enumerate(text.split("\n"))]
    df = spark.createDataFrame(lines, "match_id string, source_file string, line_pos long, value string")
    few, many = (soccertrack.tracking_from_lines(df, flag).collect() for flag in (True, False))
    assert sorted(map(str, few)) == sorted(map(str, many)) and len(few) == 10
