"""Records that span lines, against a walk along the text of each file."""

import random

import pytest
from pyspark.sql import functions as F

from pitchspark.sources import metrica, records


def walked(text):
    """Records of a file, one character at a time: a cell that begins with a quote ends with one."""
    found, cell, inside, at = [""], "", False, 0
    while at < len(text):
        c = text[at]
        if inside:
            if c == '"' and text[at + 1 : at + 2] == '"':
                found[-1] += c
                at += 1
            elif c == '"':
                inside = False
            found[-1] += c if c != "\r" else ""
        elif c == "\n":
            found.append("")
            cell = ""
        else:
            if c == '"' and not cell.strip():
                inside = True
            cell = "" if c == "," else cell + c
            found[-1] += c
        at += 1
    return found, inside


def made_file(rng):
    cells = ["1", "", " x ", 'a"b', '"q"', '"a,b"', '"two\nlines"', ' "\n\n"', '"say ""hi""\n, then"', '"x" tail',
             '"",""', '"\n""\n"', 'end"', '""', '"a""b"']
    return "\n".join(
        ",".join(rng.choices(cells, weights=[6, 6, 6] + [1] * (len(cells) - 3), k=rng.randint(1, 6)))
        for _ in range(rng.randint(1, 40))
    )


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_records_match_a_walk_along_the_text(spark, block):
    rng = random.Random(block)
    files = {f"f{i}": made_file(rng) for i in range(25)} | {"plain": "a,b\n1,2\n\n3,4", "empty": ""}
    rows = [(name, i * 3, line, name.upper()) for name, text in files.items() for i, line in enumerate(text.split("\n"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source_file string, line_pos long, value string, match_id string").repartition(5)
    got = records.whole_records(df, F.floor(F.col("line_pos") / (3 * block)))
    assert got.columns == df.columns
    found = {}
    for r in sorted(got.collect(), key=lambda r: r.line_pos):
        assert r.match_id == r.source_file.upper()
        found.setdefault(r.source_file, []).append(r.value)
    want = {name: walked(text) for name, text in files.items()}
    assert not any(open_ for _, open_ in want.values())
    assert found == {name: lines for name, (lines, _) in want.items()}
    assert any("\n" in v for lines in found.values() for v in lines)


def test_functions_of_single_lines(spark):
    rng = random.Random(9)
    lines = ["".join(rng.choices('", a', k=rng.randint(0, 12))) for _ in range(600)]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    for r in df.withColumns(records._functions(F.col("value"))).collect():
        assert r._out == walked(r.value)[1], r.value
        assert r._in == walked('"' + "\n" + r.value)[1], r.value


def test_open_files_fail_and_plain_ones_are_left_alone(spark):
    schema = "source_file string, line_pos long, value string"
    plain = spark.createDataFrame([("a", 0, 'x,"y"'), ("a", 1, '5" tall'), ("b", 0, None)], schema)
    assert records.whole_records(plain, F.lit(0)) is plain
    opened = spark.createDataFrame([("a", 0, '1,"x'), ("a", 1, "2"), ("b", 0, "3")], schema)
    with pytest.raises(Exception, match="stays open at the end of a"):
        records.whole_records(opened, F.lit(0)).collect()
    long = spark.createDataFrame([("a", 0, '1,"' + "x" * 200_000), ("a", 1, '",' + ",".join(["7"] * 5000))], schema)
    [row] = records.whole_records(long, F.col("line_pos")).collect()
    assert row.value.count("\n") == 1 and len(row.value) > 200_000
    none = records.whole_records(plain.limit(0), F.lit(0))
    assert none.count() == 0


def test_metrica_events_with_line_breaks(spark, tmp_path):
    (tmp_path / "m1_RawEventsData.csv").write_text(
        'Team,Type,Period,"Start\nFrame",From,Note\nHome,PASS,1,7,P1,"first\nsecond, ""x"""\nAway,"SHOT",2,9,P2,plain\n'
    )
    rows = sorted(metrica.read_events(spark, str(tmp_path)).collect(), key=lambda r: r.period)
    assert [(r.team_id, r.event_type, r.frame_id, r.player_id) for r in rows] == [
        ("home", "PASS", 7, "P1"), ("away", "SHOT", 9, "P2")
    ]
    assert '"Note":"first\\nsecond, \\"x\\""' in rows[0].raw_event
