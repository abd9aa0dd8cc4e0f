import http.server
import json
import threading

import pytest
from aerolith.operators.quality import QualityError
from aerolith.sources import kafka, parquet, poll, wire
from pyspark.sql import functions as F


def test_drifted_files(spark, tmp_path):
    root = str(tmp_path / "b")
    w = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}")
    w([("a", 1.0, 2.0, 1700000000)], "icao24 string, lat double, lon double, timestamp bigint", "1")
    w([("b", "3.5", "x", "2024-01-01 00:00:00")], "icao24 string, latitude string, longitude string, timestamp string", "2")
    w([("c", 1.0, 2.0, None)], "icao24 string, latitude double, longitude double, flight string", "3")
    w([("h", 1.0)], "icao24 string, lat double", "_temporary")
    (tmp_path / "b" / "broken.parquet").write_bytes(b"PAR1 no")
    got = parquet.by_schema(spark, root)
    rows = {r.icao24: r for r in got.frame.collect()}
    assert set(rows) == {"a", "b", "c"} and len(got.skipped) == 1
    assert rows["a"].latitude == 1.0 and rows["a"].second == 1700000000 and rows["b"].second == 1704067200 and rows["b"].longitude is None and rows["c"].date is None
    part = parquet.with_columns(spark, root, ["icao24", "latitude"])
    assert {r.icao24 for r in part.frame.collect()} == {"b", "c"} and len(part.skipped) == 2
    with pytest.raises(QualityError):
        parquet.by_schema(spark, str(tmp_path / "nothing"))
    assert parquet.listed(spark, str(tmp_path / "nothing")) == []


def test_wire(spark):
    now = F.lit(7)
    recs = [{"hex": " AB ", "lat": 1, "alt_baro": 0, "alt": 500, "callsign": " X "}, {"icao24": "cd", "alt_baro": "ground", "flight": "  "}, {"icao": ""}, {"hex": "", "icao24": None, "icao": "EF"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in recs] + [("not json",), (None,)], "record string")
    got = {r.icao24: r for r in wire.normalised(df, now=now).collect()}
    assert set(got) == {"ab", "cd", "ef"} and got["ab"].alt_baro == 500 and got["ab"].flight == "X" and got["cd"].flight is None and got["cd"].alt_baro is None
    raw = spark.createDataFrame([('{"icao24":"A","lat":"x","lon":1,"timestamp":5}', 9), ("not json", 9), (None, 9)], "value string, t bigint").select("value", F.timestamp_seconds("t").alias("timestamp"))
    b = [tuple(r) for r in wire.bronze(raw).select("icao24", "latitude", "longitude", F.unix_seconds("timestamp")).collect()]
    assert b == [("a", None, 1.0, 5), ("unknown", None, None, 9), ("unknown", None, None, 9)]
    assert wire.dead_letters(raw).count() == 2


def test_kafka_by_options(spark):
    assert kafka.producer_options("h:1", "t")["kafka.acks"] == "all"
    kafka.stream_reader(spark, "h:1", "t", "latest")
    df = spark.createDataFrame([("a", 1, None)], "icao24 string, n int, x string")
    assert tuple(kafka.messages(df, "icao24").first()) == ("a", '{"icao24":"a","n":1}')
    raw = spark.createDataFrame([(bytearray(b'{"a":1}'),), (bytearray(b"no"),), (bytearray(b"\xff{"),)], "value binary")
    assert [r[0] for r in kafka.readable(raw).collect()] == ['{"a":1}']


class Stub(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        code, body = {"/ok": (200, {"ac": [{"hex": "a"}, 5]}), "/list": (200, [{"hex": "b"}]), "/odd": (200, 7)}.get(self.path, (500, None))
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *a):
        pass


def test_poll(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert poll.fetch_zone(f"{at}/ok") == [{"hex": "a"}] and poll.fetch_zone(f"{at}/list") == [{"hex": "b"}]
        assert poll.fetch_zone(f"{at}/odd") == [] and poll.fetch_zone(f"{at}/none") == [] and poll.fetch_zone("http://127.0.0.1:9/") == []
        poll.register(spark)
        s = spark.readStream.format("zone_poll").option("zones", f"{at}/ok,{at}/list").option("interval", "60").load()
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(json.loads(r.record)["hex"] for r in spark.read.parquet(f"{tmp_path}/o").collect()) == ["a", "b"]
    finally:
        server.shutdown()
    assert poll.zones_from_env({"ZONE1": "a", "ZONE2": " ", "ZONE3": "c"}) == ["a", "c"]
    with pytest.raises(ValueError):
        poll.zones_from_env({})
