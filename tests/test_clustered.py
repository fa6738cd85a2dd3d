"""Tables clustered by time and place."""

import random

from pyspark.sql import functions as F

from pitchspark.operators.clips import clip_rows
from pitchspark.sources import tables
from tests.helpers import table


def rows_scanned(df):
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().get("numOutputRows").get().value()


def moving(spark, n):
    """A match of two agents that run about the pitch, in no order."""
    return spark.range(n).select(
        F.lit("m").alias("match_id"), F.lit("d").alias("dataset"), F.lit(1).alias("period"),
        F.col("id").alias("frame_id"), (F.col("id") / 500.0).alias("time_s"),
        F.concat(F.lit("home_"), F.col("id") % 2).alias("agent_id"), F.lit("player").alias("agent_type"),
        (52.5 + 50 * F.sin(F.col("id") / 997.0)).alias("x_m"), (34 + 30 * F.cos(F.col("id") / 613.0)).alias("y_m"),
        F.sha2(F.col("id").cast("string"), 256).alias("source_file"),
    ).orderBy(F.xxhash64("frame_id"))


def test_ranges_of_time_and_place_skip_most_rows(spark, tmp_path):
    n = 400_000
    df = moving(spark, n)
    plain, clustered = str(tmp_path / "plain"), str(tmp_path / "clustered")
    tables.write_table(df, plain)
    tables.write_table(df, clustered, clustered=True)

    def both(pick):
        found = [pick(tables.read_tracking(spark, p)) for p in (plain, clustered)]
        assert found[0].count() == found[1].count() > 0
        return [rows_scanned(x.select("x_m", "time_s", "source_file")) for x in found]

    seen, few = both(lambda t: clip_rows(t, 400.0, 20.0))
    assert seen > n / 2 and few < n / 8
    seen, few = both(lambda t: clip_rows(t, 300.0, 80.0).where("x_m BETWEEN 90 AND 100"))
    assert few < seen / 8
    seen, few = both(lambda t: t.where("x_m < 12 AND y_m < 12"))
    assert few < 0.8 * seen


def test_rows_are_the_same_and_odd_ones_are_kept(spark, tmp_path):
    rng, inf = random.Random(2), float("inf")
    rows = [
        {"match_id": rng.choice("ab"), "dataset": "d", "period": rng.choice([1, 2, None]), "frame_id": i,
         "time_s": rng.choice([rng.uniform(-50, 9e5), None, inf]), "x_m": rng.choice([rng.uniform(-9, 120), None, -inf]),
         "y_m": rng.choice([rng.uniform(-9, 120), None, float("nan")])}
        for i in range(500)
    ]
    df = table(spark, rows)
    paths = [str(tmp_path / name) for name in ("plain", "clustered")]
    for path, clustered in zip(paths, (False, True), strict=True):
        tables.write_table(df, path, clustered)
    found = [sorted(map(str, tables.read_tracking(spark, p).collect())) for p in paths]
    assert found[0] == found[1] and len(found[0]) == 500
    tables.write_table(df.where("match_id = 'a'").limit(1), paths[1], clustered=True)
    now = tables.read_tracking(spark, paths[1])
    assert now.where("match_id = 'a'").count() == 1
    assert now.where("match_id = 'b'").count() == sum(r["match_id"] == "b" for r in rows)
    tables.write_table(df.limit(0), str(tmp_path / "none"), clustered=True)
