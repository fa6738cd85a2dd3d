"""Runs that read new files only."""

import json

import pytest

from pitchspark import cli
from pitchspark.sources import metrica, tables
from pitchspark.streaming.ingest import ingest_new
from tests.test_sources import AWAY, TWO_ROWS, write


def snapshot(out):
    return {str(f): (f.stat().st_mtime_ns, f.read_bytes()) for f in out.glob("*.parquet/dataset=*/match_id=*/*.parquet")}


def ledger(df):
    rows = [(r.batch, r.source_file.rsplit("/", 2)[-2:], r.match_id, r.is_new) for r in df.collect()]
    return sorted((b, "/".join(f), m, n) for b, f, m, n in rows)


def test_a_new_file_touches_its_match_only(spark, tmp_path, monkeypatch):
    raw, out = tmp_path / "raw", tmp_path / "out"
    for m in ("m1", "m 2 [x]"):
        write(raw / m / "tracking_home.csv", TWO_ROWS)
        write(raw / m / "events.csv", "Team,Type,Period,Start Frame\nHome,PASS,1,3\n")
    write(raw / "m1" / "tracking_away.csv", AWAY)
    first = ledger(ingest_new(spark, "metrica", str(raw), str(out)))
    assert len(first) == 5 and all(n for *_, n in first)
    tracking = tables.read_tracking(spark, f"{out}/tracking.parquet")
    counts = {r.match_id: r["count"] for r in tracking.groupBy("match_id").count().collect()}
    before = snapshot(out)

    # Nothing new: nothing is read or written.
    read = []
    monkeypatch.setattr(metrica, "_lines", lambda *a: read.append(a[-1]) or pytest.fail("read"))
    assert ledger(ingest_new(spark, "metrica", str(raw), str(out))) == first
    assert snapshot(out) == before and not read
    monkeypatch.undo()

    write(raw / "m 2 [x]" / "tracking_away.csv", AWAY)
    real, paths = metrica._lines, []
    monkeypatch.setattr(metrica, "_lines", lambda *a: paths.extend(a[-1]) or real(*a))
    second = ledger(ingest_new(spark, "metrica", str(raw), str(out)))
    assert {p.rsplit("/", 2)[-2] for p in paths} == {"m 2 [x]"}
    assert [x for x in second if x in first] == first
    added = [x for x in second if x not in first]
    assert sorted((f.split("/")[1], n) for _, f, _, n in added) == [
        ("events.csv", False), ("tracking_away.csv", True), ("tracking_home.csv", False)
    ]
    after = snapshot(out)
    kept = {f: v for f, v in before.items() if "match_id=m1" in f}
    assert kept and kept.items() <= after.items()
    tracking = tables.read_tracking(spark, f"{out}/tracking.parquet")
    now = {r.match_id: r["count"] for r in tracking.groupBy("match_id").count().collect()}
    assert now == counts | {"m 2 [x]": counts["m1"]}
    assert tables.read_events(spark, f"{out}/events.parquet").count() == 2


def test_batches_of_few_files_and_a_batch_run_again(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    for i in range(5):
        write(raw / "events" / f"{i}.json", '[{"period": 1, "type": {"name": "Pass"}}, {"period": 2}]')
    rows = ledger(ingest_new(spark, "statsbomb", str(raw), str(out), max_files=2))
    assert [b for b, *_ in rows] == [0, 0, 1, 1, 2]
    assert tables.read_events(spark, f"{out}/events.parquet").count() == 10
    # A batch that failed before it was committed is run again and replaces what it wrote.
    last = max((out / "_files" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    (out / "_files" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()
    assert ledger(ingest_new(spark, "statsbomb", str(raw), str(out), max_files=2)) == rows
    assert tables.read_events(spark, f"{out}/events.parquet").count() == 10


def test_command_line_and_other_files(spark, tmp_path, capsys):
    raw, out = tmp_path / "raw", tmp_path / "out"
    write(raw / "notes.txt", "x")
    write(raw / "a.csv", "image_id,track_id,x,y\n1,p,2,3\n")
    args = ["ingest-new", "--dataset", "soccertrack", "--raw-dir", str(raw), "--out-dir", str(out)]
    assert cli.main(args, spark) == 0
    assert json.loads(capsys.readouterr().out) == {"files": 1, "matches": 1}
    assert tables.read_tracking(spark, f"{out}/tracking.parquet").first().match_id == "a"
    write(raw / "more.txt", "y")
    assert cli.main(args, spark) == 0
    assert json.loads(capsys.readouterr().out) == {"files": 1, "matches": 1}
