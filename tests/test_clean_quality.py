import pytest
from aerolith.operators.clean import clean, one_per_key, union_drifted
from aerolith.operators.quality import QualityError, Status, duplicate_rows, judge, metrics, quarantine, require_columns
from pyspark.sql import functions as F

SCHEMA = "pos_id bigint, icao24 string, latitude double, longitude double, flight string, reg string, s bigint"
ROWS = [
    (1, "AA ", 90.0, 180.0, None, None, 5), (2, "aa", 1.0, 1.0, None, None, 5), (3, None, -90.0, -180.0, " F1", None, 6),
    (4, "bb", 90.0001, 0.0, None, None, 7), (5, "bb", None, 0.0, None, None, 7), (6, "bb", float("nan"), 0.0, None, None, 8), (7, "cc", 1.0, 1.0, None, None, None),
]


def test_clean(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = clean(df, F.col("s"), ["pos_id"])
    assert {(r.pos_id, r.icao24) for r in out.collect()} == {(1, "aa"), (3, "f1")}
    again = clean(out.withColumn("s", F.col("second")), F.col("s"), ["pos_id"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert {r.second for r in clean(df, F.col("s"), ["pos_id"], now=F.lit(99)).collect()} == {5, 6, 99}
    text = spark.createDataFrame([(1, "a", "1.5", "x", None, None, 1), (2, "a", "1.5", "2", None, None, 1)], SCHEMA.replace("latitude double, longitude double", "latitude string, longitude string"))
    assert [r.pos_id for r in clean(text, F.col("s"), ["pos_id"]).collect()] == [2]
    assert clean(df.limit(0), F.col("s"), ["pos_id"]).count() == 0


def test_bounds_reach_the_scan(spark, data):
    t = spark.read.parquet(f"{data}/bronze_positions.parquet")
    plan = clean(t, F.unix_seconds("timestamp"), ["pos_id"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(latitude" in plan


def test_quality(spark):
    df = spark.createDataFrame([(1, None, 5.0, 1.0, 7), (2, None, 5.0, 1.0, 7), (3, "a", None, 1.0, 7), (4, "a", 95.0, 1.0, 8), (5, "b", 1.0, 1.0, 8), (6, "b", 2.0, 1.0, 8)], "i int, icao24 string, latitude double, longitude double, timestamp bigint")
    m = metrics(df).first()
    assert (m.total_rows, m.null_count, m.range_count, m.duplicate_groups, m.duplicate_rows, m.status) == (6, 1, 1, 2, 4, "WARNING")
    assert m.messages == "null ratio above threshold | 1 rows out of range | 2 duplicate groups"
    keys = ["icao24", "timestamp"]
    assert {r.i for r in duplicate_rows(df, keys).collect()} == {1, 2, 5, 6} and {r.i for r in duplicate_rows(df, keys, False).collect()} == {5, 6}
    q = quarantine(df, "run")
    assert {k: v.count() for k, v in q.items()} == {"nulls": 1, "range": 1, "duplicates": 4} and "run_id" in q["nulls"].columns
    assert judge(df, ["icao24"])[0] is Status.WARNING
    with pytest.raises(QualityError):
        require_columns(df, ["nope"])
    with pytest.raises(QualityError):
        judge(df.limit(0), ["icao24"])


def test_small_ones(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "i int, lat double"), spark.createDataFrame([(2, "x")], "i int, flight string")
    assert sorted(union_drifted([a, b]).columns) == ["flight", "i", "latitude"]
    d = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (None, "d")], "k int, v string")
    assert {(r.k, r.v) for r in one_per_key(d, ["k"], ["v"]).collect()} == {(1, "a"), (None, "c")}
