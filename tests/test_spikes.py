import random

from aerolith.operators.spikes import ReadingRule, implausible, judged, scatter
from pyspark.sql import functions as F

SCHEMA = "log_seq bigint, icao24 string, s bigint, alt_baro double, gs double, lat double, lon double"


def flight(n=200, noise=2.0, seed=1, key="ab12cd"):
    rnd = random.Random(seed)
    return [[i, key, 1000 + 10 * i, 8000.0 + 25 * rnd.randint(-2, 2), 200 + rnd.gauss(0, noise), 40 + 0.005 * i, ((179.5 + 0.005 * i + 180) % 360) - 180] for i in range(n)]


def cases(spark, rows, **kw):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    out = implausible(df, "icao24", F.col("s"), "log_seq", ReadingRule(**kw))
    return {(r.log_seq, r.field, r.kind) for r in out.collect()}


def test_a_clean_flight_over_the_date_line_has_no_case(spark):
    assert cases(spark, flight()) == set()


def test_planted_cases(spark):
    rows = flight()
    rows[50][4] += 120  # one reading
    for i in (80, 81, 82):
        rows[i][3] += 5000  # three in a row
    for i in range(100, 104):
        rows[i][4] += 150  # four in a row are no spike
    for i in range(120, 135):
        rows[i][5] = rows[120][5]  # stuck
    rows[150][4] = -3.0
    rows[160][5] = 95.0
    rows[170][6] = None
    rows[171][4] = float("nan")
    for i in range(180, 200):
        rows[i][4] += 80  # a new level
    want = {(50, "gs", "spike"), (150, "gs", "impossible"), (160, "lat", "impossible")} | {(i, "alt_baro", "spike") for i in (80, 81, 82)}
    want |= {(i, "lat", "stuck") for i in range(120, 135)}
    assert cases(spark, rows) == want
    assert cases(spark, rows, slice_s=640, reach_s=400) == want
    copies = rows + [[1000 + r[0], " AB12CD", r[2], 1.0, 1.0, 1.0, 1.0] for r in rows]
    assert cases(spark, copies) == want


def test_a_spike_is_held_against_the_scatter_of_its_source(spark):
    rows = flight(400, noise=15.0)
    rows[100][4] += 90  # six times the scatter
    assert not any(k == "spike" for _, _, k in cases(spark, rows))
    rows[200][4] += 400
    assert {c for c in cases(spark, rows) if c[2] == "spike"} == {(200, "gs", "spike")}


def test_rough_hours_have_a_fence_of_their_own(spark):
    """Calm in even hours, rough in odd ones: the roughness isn't taken for spikes, and the planted ones are found."""
    rnd, rows = random.Random(6), flight(4 * 360 * 4, noise=1.0)
    for r in rows:
        r[5] = 40 + 0.0001 * r[0]
        r[6] = 10 + 0.0001 * r[0]
        if r[2] // 3600 % 2:
            r[4] += rnd.gauss(0, 12)
    quiet = next(i for i, r in enumerate(rows) if r[2] // 3600 == 2) + 100
    rough = next(i for i, r in enumerate(rows) if r[2] // 3600 == 3) + 100
    rows[quiet][4] += 150
    rows[rough][4] += 400
    found = {c for c in cases(spark, rows) if c[2] == "spike"}
    assert {(quiet, "gs", "spike"), (rough, "gs", "spike")} <= found and len(found) <= 4
    flat = {c for c in cases(spark, rows, hour_prior=1e12) if c[2] == "spike"}  # overall fence only
    assert len(flat) > 4


def test_rest_is_not_stuck_and_breaks_end_runs(spark):
    rows = [[i, "aa", 10 * i, 500.0, 0.0, 10.0 + 1e-4 * (i % 3), 10.0] for i in range(40)]
    assert cases(spark, rows) == set()
    rows = flight(40)
    for i in range(10, 21):
        rows[i][4] = 123.0
    for i in range(21, 40):
        rows[i][2] += 700  # the run of 11 goes on after a break
    rows[21][4] = 123.0
    assert cases(spark, rows) == set()


def test_edges(spark):
    assert cases(spark, []) == set()
    rows = [[1, None, 5, 1.0, 1.0, 95.0, 1.0], [2, "a", None, 1.0, 1.0, 95.0, 1.0], [3, "a", 6, None, None, None, None], [4, "a", 7, 1.0, 1.0, 95.0, 1.0]]
    assert cases(spark, rows) == {(4, "lat", "impossible")}


def test_sketches_merge(spark):
    df = spark.createDataFrame([tuple(r) for r in flight(2000, noise=4.0)], SCHEMA)
    p = judged(df, "icao24", F.col("s"), "log_seq", ReadingRule())
    whole = scatter(p, ["k", "field"]).where("field = 'gs'").first()
    assert 3.6 < whole.q2 / 0.6745 < 4.4
    assert scatter(p, ["k", "field", "hour"]).where("field = 'gs'").agg(F.sum("readings")).first()[0] == whole.readings
