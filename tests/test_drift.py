import json

from aerolith.operators.drift import changes, ingest, ledger, replay

SCHEMA = "rec_id bigint, f bigint, lane string, seq int, payload string"


def found(spark, rows):
    df = ingest(spark.createDataFrame(rows, SCHEMA), ["f", "lane", "seq"])
    return {tuple(r) for r in changes(ledger(df, "f", "lane", "seq")).collect()}


def test_each_change(spark):
    j = json.dumps
    rows = [
        (1, 10, "a", 1, j({"lat": 1.5, "icao": "x", "n": 1})), (2, 10, "a", 1, j({"lat": None, "icao": "y"})),
        (3, 30, "a", 3, j({"Latitude": "1.5", "icao": "x", "squawk": "1"})),  # in true order: last
        (4, 20, "a", 2, "{broken"), (5, 20, "a", 2, None), (6, 20, "a", 2, ""), (7, 20, "a", 2, "[1]"),
        (8, 40, "b", 1, j({"x": 1})), (9, 41, "b", 2, j({"X": 1})), (10, 42, "b", 3, "{}"), (11, 43, "b", 4, j({"x": None})), (12, 44, "b", 5, j({"x": True})),
    ]
    assert found(spark, rows) == {
        (30, "latitude", "renamed"), (30, "latitude", "retyped"), (30, "n", "removed"), (30, "squawk", "added"),
        (41, "X", "renamed"), (42, "X", "removed"), (43, "x", "added"),
    }
    assert found(spark, []) == set()


def test_ingest_rescue_and_replay(spark):
    rows = [
        (1, 1, "a", 1, json.dumps({"icao": "ab", "lat": "1.5", "lng": 2, "ts": 1700000000123, "squawk": "7000", "nic": 8})),
        (2, 1, "a", 1, json.dumps({"hex": "cd", "latitude": "north", "timestamp": "2024-01-01T00:00:00Z"})),
        (3, 1, "a", 1, "not json"), (4, 1, "a", 1, None), (5, 1, "a", 1, json.dumps({"timestamp": 1700000000.5, "flight": None})),
    ]
    t = ingest(spark.createDataFrame(rows, SCHEMA), ["rec_id", "f"])
    r = {x.rec_id: x for x in t.selectExpr("*", "unix_micros(timestamp) AS us").collect()}
    assert (r[1].icao24, r[1].latitude, r[1].longitude, r[1].us) == ("ab", 1.5, 2.0, 1700000000123000)
    assert json.loads(r[1]._rescued) == {"squawk": '"7000"', "nic": "8"}
    assert r[2].latitude is None and json.loads(r[2]._rescued) == {"latitude": '"north"'} and str(r[2].date) == "2024-01-01"
    assert json.loads(r[3]._rescued) == {"_payload": "not json"} and r[4]._rescued is None and r[5].us == 1700000000500000
    again = {x.rec_id: x for x in replay(t, {"squawk": "string", "nic": "bigint"}).collect()}
    assert (again[1].squawk, again[1].nic, again[1]._rescued) == ("7000", 8, None) and again[2]._rescued is not None


def test_renames_by_words_and_by_content(spark):
    j = json.dumps
    a = lambda n: {"squawk": f"{1000 + n}", "lat": 40.0 + n / 10, "kind": f"b7{n}", "nic": n, "on": True, "gone": n}
    b = lambda n: {"squawk_code": f"{1200 + n}", "position_lat": 40.2 + n / 10, "Model": f"b7{n}", "sil": 5 + n / 7, "off": True, "new_gone_by": f"t{n}"}
    rows = [(n, 1, "a", 1, j(a(n))) for n in range(6)] + [(10 + n, 2, "a", 2, j(b(n))) for n in range(6)]
    assert found(spark, rows) == {
        (2, "squawk_code", "renamed"), (2, "latitude", "renamed"), (2, "Model", "renamed"), (2, "nic", "removed"), (2, "sil", "added"),
        (2, "on", "removed"), (2, "off", "added"), (2, "gone", "removed"), (2, "new_gone_by", "added"),
    }


def test_one_field_is_renamed_to_one_other(spark):
    j = json.dumps
    rows = [(1, 1, "a", 1, j({"code": "12"})), (2, 2, "a", 2, j({"code_a": "13", "code_b": "12"})), (3, 3, "a", 3, j({"CodeA": 13, "code_b": "12"}))]
    assert found(spark, rows) == {(2, "code_a", "renamed"), (2, "code_b", "added"), (3, "CodeA", "renamed"), (3, "CodeA", "retyped")}


def test_times_in_every_form(spark):
    forms = ["2024-01-01T00:00:00.5Z", "2024-01-01T02:00:00.5+02:00", "2024-01-01 00:00:00.5", "2023-12-31T19:00:00.5-0500", 1704067200.5, "1704067200.5", "1704067200500", "12:30", "2024-13-01T00:00:00Z", "soon"]
    rows = [(i, 1, "a", 1, json.dumps({"timestamp": f})) for i, f in enumerate(forms)]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            t = ingest(spark.createDataFrame(rows, SCHEMA), ["rec_id"]).selectExpr("rec_id", "unix_micros(timestamp) AS us", "date", "_rescued")
            got = {r.rec_id: r for r in t.collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [got[i].us for i in range(len(forms))] == [1704067200500000] * 7 + [None] * 3
        assert str(got[0].date) == "2024-01-01" and got[0]._rescued is None and all(got[i]._rescued for i in (7, 8, 9))
