import os
import random

import pytest
from aerolith.operators.motion import features, label
from aerolith.operators.report import kept_in_thinning, tracks
from aerolith.streaming import flows
from pyspark.sql import functions as F

SCHEMA = "icao24 string, second bigint, latitude double, longitude double, date date"


def batch(spark, rows, **kw):
    df = spark.createDataFrame(rows, "icao24 string, second bigint, latitude double, longitude double").withColumn("date", F.to_date(F.lit("2024-01-01")))
    return {(r.icao24, r.second): (r.delta_t, r.movement_score, r.risk_label) for r in features(df, **kw).collect()}


def test_edges(spark):
    rows = [("a", 0, 0.0, 179.9), ("a", 600, 0.0, -179.9), ("a", 1201, 0.0, -179.9), ("b", 5, 1.0, 1.0)]
    got = batch(spark, rows, movement="km_per_s")
    assert set(got) == {("a", 600), ("a", 1201)} and got["a", 600][1] == pytest.approx(22.239 / 600, rel=1e-3)
    l1 = batch(spark, rows, movement="l1_degrees", label_rule="gap_or_still")
    assert l1["a", 600] == (600, pytest.approx(359.8), 0) and l1["a", 1201][2] == 1
    assert batch(spark, rows, first=True)["b", 5] == (None, 0.0, 0)
    x = spark.createDataFrame([(None, None), (700, None), (None, 0.0009), (5, 0.001)], "d bigint, m double")
    assert [r[0] for r in x.select(label("gap_or_still", F.col("d"), F.col("m"))).collect()] == [0, 1, 1, 0]
    assert [r[0] for r in x.limit(1).select(label("fast", F.lit(1), F.lit(0.7))).collect()] == [1]


def test_thinning(spark):
    for n in (1, 2, 3, 49, 50, 51, 52, 99, 500, 1234):
        df = spark.createDataFrame([("f", i) for i in range(n)], "flight_id string, second bigint")
        kept = sorted(r.point for r in tracks(df, most=50, least=1).collect())
        assert len(kept) == min(n, 50) and kept[0] == 0 and kept[-1] == n - 1
        gaps = {b - a for a, b in zip(kept, kept[1:])}
        assert not gaps or max(gaps) - min(gaps) <= 1
    one = spark.createDataFrame([(0, 5), (1, 5)], "r bigint, n bigint")
    assert [x[0] for x in one.select(kept_in_thinning(F.col("r"), F.col("n"), 1)).collect()] == [True, False]
    assert tracks(spark.createDataFrame([("f", 1), (None, 2)], "flight_id string, second bigint"), least=2).count() == 0


def made(n=240, seed=3):
    rnd = random.Random(seed)
    at = {k: [0, 10.0, 10.0] for k in "abc"}
    rows = []
    for i in range(n):
        k = rnd.choice("abc")
        p = at[k]
        p[0] += rnd.randint(1, 40)
        p[1] += rnd.gauss(0, 0.05)
        p[2] += rnd.gauss(0, 0.05)
        rows.append((k, p[0], p[1], p[2], i))
    return rows


def streamed(spark, tmp, rows, parts, fail_after=None, **kw):
    src, out, cp = (f"{tmp}/{x}" for x in ("in", "out", "cp"))
    os.makedirs(src, exist_ok=True)
    schema = "icao24 string, evt_ts bigint, latitude double, longitude double, tie bigint"

    def go():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        flows.score_stream(s, out, cp, every=None, **kw).start().awaitTermination()

    size = -(-len(rows) // parts)
    for p in range(parts):
        chunk = rows[p * size : (p + 1) * size]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(src)
        if fail_after is not None and p == fail_after:
            go()  # stops here and starts again from the checkpoint below
    go()
    return {(r.icao24, r.evt_ts): (r.delta_t, r.movement_score) for r in spark.read.parquet(out).collect()}


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_equals_batch(spark, tmp_path, parts):
    rows = made()
    want = batch(spark, [r[:4] for r in rows])
    got = streamed(spark, tmp_path, rows, parts, fail_after=1 if parts == 3 else None)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == (want[k][0], pytest.approx(want[k][1], abs=1e-12))


def test_late_rows_by_policy(spark, tmp_path):
    rows = [("a", 100, 1.0, 1.0, 1), ("a", 50, 2.0, 2.0, 2), ("a", 160, 1.0, 1.0, 3), ("a", 160, 3.0, 3.0, 4)]
    assert set(streamed(spark, tmp_path / "e", [rows[0]] + rows[1:], 4)) == {("a", 160)}
    late = streamed(spark, tmp_path / "r", rows, 4, policy="arrival", smooth=False, emit_first=True)
    assert late["a", 50] == (0, 0.0) and late["a", 100] == (0, 0.0)


def test_stream_dedupe_and_file_sink(spark, tmp_path):
    rows = [("a", 100), ("a", 100), ("b", 100), ("a", 101), ("a", 10**10)]
    df = spark.createDataFrame(rows, "icao24 string, s bigint").select("icao24", F.timestamp_seconds("s").alias("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = flows.deduplicated(s, ["icao24", "timestamp"], latest="timestamp'2200-01-01'").withColumn("date", F.to_date("timestamp"))
    flows.to_parquet(out, f"{tmp_path}/out", f"{tmp_path}/cp", ["date"], every=None).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    seen = []
    write = flows.two_sinks(str(tmp_path / "o"), lambda df: seen.append(df.count()))
    df = spark.createDataFrame([("a", 1)], "icao24 string, evt_ts bigint")
    write(df, 4)
    write(df, 4)
    write(df.limit(0), 5)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1 and seen == [1, 1]
