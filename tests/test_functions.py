import math
import random

import brute
import pytest
from aerolith.functions.geo import haversine_km, on_globe
from aerolith.functions.identity import identity
from aerolith.functions.instants import day_range, event_second, local_text, text_seconds, utc_date, utc_hour
from aerolith.functions.risk import normalise_risk, probability, risk_colour
from pyspark.sql import functions as F


def test_identity_rules(spark):
    rows = [(0, "AbC123", None, None), (1, " abc123 ", None, None), (2, "", " FL1 ", None), (3, None, None, "R-1"), (4, None, None, None), (5, "\tX1\t", None, None), (6, "  ", None, None)]
    df = spark.createDataFrame(rows, "i int, icao24 string, flight string, reg string")
    got = {r: [x[0] for x in df.orderBy("i").select(identity(r)).collect()] for r in ("canonical", "bronze", "silver", "stream", "producer")}
    assert got["canonical"] == ["abc123", "abc123", "fl1", "r-1", "unknown", "x1", "unknown"]
    assert got["bronze"] == ["abc123", " abc123 ", " fl1 ", "r-1", "unknown", "\tx1\t", "  "]
    assert got["silver"] == ["abc123", "abc123", "", "r-1", "unknown", "\tx1\t", ""]
    assert got["stream"] == ["abc123", "abc123", "", "", "", "\tx1\t", ""]
    assert got["producer"] == ["abc123", "abc123", None, None, None, "x1", None]


def test_times(spark):
    df = spark.createDataFrame([("1700000000",), ("2024-01-01 00:00:00",), ("1700000000.9",), ("bad",), (None,), ("-1.5",)], "t string")
    assert [r[0] for r in df.select(text_seconds("t")).collect()] == [1700000000, 1704067200, 1700000000, None, None, -2]
    assert [r[0] for r in df.select(event_second("silver", "t", now=F.lit(7))).collect()][3:5] == [7, 7]
    d = spark.createDataFrame([(-1,), (0,), (86399,), (1730613600,)], "s bigint")
    rows = d.select(utc_date("s").cast("string"), utc_hour("s"), local_text("s")).collect()
    assert [tuple(r) for r in rows] == [
        ("1969-12-31", 23, "1970-01-01 05:29:59"), ("1970-01-01", 0, "1970-01-01 05:30:00"), ("1970-01-01", 23, "1970-01-02 05:29:59"), ("2024-11-03", 6, "2024-11-03 11:30:00"),
    ]


def test_day_range():
    a, b = day_range("today", 1_700_000_000, 0)
    assert (b - a) == 86_400_000_000 - 1000
    assert day_range("yesterday", 1_700_000_000, 0)[0] == a - 86_400_000_000
    assert day_range("custom", 0, 0, 1, 2) == (86_400_000_000, 3 * 86_400_000_000 - 1)
    with pytest.raises(ValueError):
        day_range("custom range", 0)


def test_haversine(spark):
    rnd = random.Random(1)
    pts = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180), rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(300)]
    pts += [(0.0, 0.0, 0.0, 180.0), (90.0, 0.0, -90.0, 0.0), (10.0, 179.9, 10.0, -179.9), (5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(pts, "a double, b double, c double, d double")
    for r in df.select("*", haversine_km("a", "b", "c", "d").alias("x"), haversine_km("c", "d", "a", "b").alias("y")).collect():
        assert r.x == pytest.approx(brute.hav(*r[:4]), abs=1e-6) and r.x == pytest.approx(r.y, abs=1e-9)
        assert 0 <= r.x <= math.pi * 6371 + 1e-6
    edge = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (90.0001, 0.0), (0.0, -180.0001), (None, 0.0), (float("nan"), 0.0)], "a double, b double")
    assert [r[0] for r in edge.select(on_globe("a", "b")).collect()] == [True, True, False, False, False, False]


def test_risk(spark):
    df = spark.createDataFrame([(0.2,), (None,), (float("nan"),), (-1.0,)], "r double")
    assert [r.risk for r in normalise_risk(df, "r").collect()] == [0.2, 0, 0, 0]
    pct = spark.createDataFrame([(20.0,), (90.0,), (250.0,)], "r double")
    assert [r.risk for r in normalise_risk(pct, "r").collect()] == [0.2, 0.9, 1.0]
    assert normalise_risk(df.limit(0), "r").count() == 0
    assert df.limit(1).select(risk_colour(F.lit(0.0)), risk_colour(F.lit(1.0)), risk_colour(F.lit(0.5))).first()[:] == ("#00ff00", "#ff0000", "#7f7f00")
    assert df.limit(1).select(probability([F.lit(1), F.lit(0.7)])).first()[0] == pytest.approx(0.5)
