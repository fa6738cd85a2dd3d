import json

from pyspark.sql import functions as F

from pitchspark import cli
from pitchspark.plans import jobs
from pitchspark.schema import FEATURE_SCHEMA, TRACKING_COLUMNS, TRACKING_SCHEMA
from pitchspark.sources import tables
from tests.helpers import as_set, table
from tests.test_sources import AWAY, TWO_ROWS, write


def run(spark, capsys, *args):
    code = cli.main(list(args), spark)
    return code, capsys.readouterr().out


def test_files_to_windows(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    write(raw / "007" / "tracking_home.csv", TWO_ROWS)
    write(raw / "007" / "tracking_away.csv", AWAY)
    write(raw / "007" / "events.csv", "Team,Type,Period,Start Frame\nHome,PASS,1,3\n")
    out = str(tmp_path / "out")
    code, text = run(spark, capsys, "ingest", "--raw-dir", str(raw), "--out-dir", out)
    paths = json.loads(text)
    assert code == 0 and set(paths) == {"tracking", "events"}
    tracking = tables.read_tracking(spark, paths["tracking"])
    assert tracking.columns == TRACKING_COLUMNS and tracking.count() == 6
    # Partition values keep their text.
    assert {r.match_id for r in tracking.collect()} == {"007"}
    assert tables.read_events(spark, paths["events"]).first().event_type == "PASS"

    features = f"{out}/features.parquet"
    assert run(spark, capsys, "features", "--tracking", paths["tracking"], "--out", features)[0] == 0
    stored = tables.read_features(spark, features)
    assert stored.columns == FEATURE_SCHEMA.names and stored.count() == 6
    assert stored.where("agent_id = 'ball'").first().vx_mps is not None

    code, text = run(spark, capsys, "quality", "--tracking", paths["tracking"], "--out",
                     f"{out}/quality")
    assert json.loads(text)["ok"] is True
    assert spark.read.parquet(f"{out}/quality/missingness_by_agent.parquet").count() == 3

    code, text = run(
        spark, capsys, "export-windows", "--tracking", paths["tracking"], "--features", features,
        "--out", f"{out}/windows", "--history-s", "0.1", "--future-s", "0.1", "--max-agents", "4",
    )
    paths = json.loads(text)
    windows, meta = (spark.read.parquet(paths[k]) for k in ("windows", "window_meta"))
    assert windows.count() == meta.count() == 1 and len(meta.columns) == 9
    assert windows.schema["x_history"].metadata["names"][-1] == "distance_to_ball_m"
    assert windows.first().agent_ids == ["home_player11", "away_player7", "ball", ""]


def test_one_match_is_exported_again(spark, tmp_path, capsys):
    """The others' files stay as they are, and names of digits stay text."""
    rows = [
        {"match_id": m, "period": 1, "frame_id": i, "time_s": i / 10, "agent_id": "home_1", "agent_type": "player",
         "team_id": "home", "x_m": 1.0 * i, "y_m": 2.0}
        for m in ("007", "8") for i in range(6)
    ]
    path, out = str(tmp_path / "t"), str(tmp_path / "w")
    tables.write_table(table(spark, rows).withColumn("dataset", F.lit("d")), path)
    args = ["export-windows", "--tracking", path, "--out", out, "--history-s", "0.1", "--future-s", "0.1"]
    assert run(spark, capsys, *args)[0] == 0

    def files():
        found = tmp_path.glob("w/*/match_id=*/*.parquet")
        return {str(f): (f.stat().st_mtime_ns, f.read_bytes()) for f in found}

    def counts(part):
        df = tables.read_windows(spark, f"{out}/{part}.parquet")
        return {r.match_id: r["count"] for r in df.groupBy("match_id").count().collect()}

    before = files()
    assert counts("windows") == counts("window_meta") == {"007": 5, "8": 5}
    tables.write_table(table(spark, rows[:5]).withColumn("dataset", F.lit("d")), path)
    assert run(spark, capsys, *args, "--match-id", "007")[0] == 0
    after = files()
    assert counts("windows") == counts("window_meta") == {"007": 4, "8": 5}
    kept = {f: v for f, v in before.items() if "match_id=8" in f}
    assert kept and kept.items() <= after.items()
    assert not {f for f in before if "match_id=007" in f} & after.keys()
    assert tables.read_windows(spark, f"{out}/windows.parquet").schema["x_history"].metadata["names"]


def test_missing_files_exit_with_one(spark, tmp_path, capsys):
    code, text = run(spark, capsys, "ingest", "--raw-dir", str(tmp_path / "no"), "--out-dir",
                     str(tmp_path / "out"))
    assert code == 1 and "no Metrica tracking" in text


def test_events_only_provider_is_written(spark, tmp_path):
    write(tmp_path / "raw" / "events" / "9.json", '[{"period": 1, "type": {"name": "Pass"}}]')
    paths = jobs.ingest(spark, "statsbomb", str(tmp_path / "raw"), str(tmp_path / "out"))
    assert set(paths) == {"events"}
    assert tables.read_events(spark, paths["events"]).first().match_id == "9"


def test_writing_a_match_again_replaces_only_that_match(spark, tmp_path):
    path = str(tmp_path / "t")
    both = table(spark, [{"match_id": m, "x_m": 1.0} for m in ("1", "2")]).withColumn(
        "extra", F.lit("e"))
    tables.write_table(both, path)
    tables.write_table(both.where("match_id = '2'").withColumn("x_m", F.lit(5.0)), path)
    stored = tables.read_tracking(spark, path)
    assert as_set(stored, ["match_id", "x_m", "extra"]) == [("1", 1.0, "e"), ("2", 5.0, "e")]


def test_a_match_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(table(spark, [{"match_id": m} for m in ("1", "2")]), path)
    plan = tables.read_tracking(spark, path).where("match_id = '2' and time_s > 1").select(
        "x_m")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(match_id" in plan
    assert "GreaterThan(time_s,1.0)" in plan and "ReadSchema: struct<time_s:double,x_m:double>" in plan


def test_tables_of_other_tools(spark, tmp_path):
    """Other widths of numbers, floats, a match named by digits, and stored NaN."""
    path = str(tmp_path / "other.parquet")
    for mode, kinds in (("overwrite", "bigint"), ("append", "int")):
        spark.createDataFrame(
            [(7, 2, 9.0, float("nan"), 1.5, "x")],
            "match_id bigint, period bigint, jersey_number double, x_m double, y_m float, extra string",
        ).selectExpr("match_id", f"cast(period as {kinds}) as period", "jersey_number", "x_m", "y_m",
                     "extra").write.mode(mode).parquet(path)
    df = tables.read_tracking(spark, path)
    assert df.schema[:len(TRACKING_SCHEMA)] == TRACKING_SCHEMA and df.columns[-1] == "extra"
    for r in df.collect():
        assert (r.match_id, r.period, r.jersey_number, r.x_m, r.y_m, r.z_m, r.extra) == (
            "7", 2, 9, None, 1.5, None, "x")
    own = str(tmp_path / "own.parquet")
    tables.write_table(df.withColumn("dataset", F.lit("d")).withColumn("match_id", F.lit("007")), own)
    again = tables.read_tracking(spark, own).first()
    assert (again.match_id, again.x_m, again.period) == ("007", None, 2)
