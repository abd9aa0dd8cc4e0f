import random

import brute
import pytest
from aerolith.operators.trips import StopRule, clean_pings, longest_first, stops_and_trips, windows_of
from pyspark.sql import functions as F

SCHEMA = "pos_id bigint, icao24 string, latitude double, longitude double, s bigint"


def found(df, **kw):
    pings = clean_pings(df, "icao24", "latitude", "longitude", F.col("s"), "pos_id")
    return {tuple(r) for r in stops_and_trips(pings, StopRule(**kw)).select("icao24", "kind", "start_s", "end_s").collect()}


def walk(seed, step_s, n, lat=10.0, lon=179.99):
    """Rests, slow drifts, flights, silences and outliers; about the date line."""
    rnd, s, out = random.Random(seed), 0, []
    while len(out) < n:
        kind = rnd.choice(["rest", "rest", "drift", "fly", "silence"])
        for _ in range(rnd.randint(5, 60)):
            s += rnd.randint(1, 2 * step_s)
            if kind == "fly":
                lat, lon = lat + 0.002 * step_s / 5, lon + 0.001 * step_s / 5
            if kind == "drift":
                lat += 0.0004
            a, o = lat + rnd.gauss(0, 2e-4), lon + rnd.gauss(0, 2e-4)
            if rnd.random() < 0.02:
                a += 5
            out.append((s, a, (o + 180) % 360 - 180))
        if kind == "silence":
            s += rnd.choice([1000, 2700, 2701, 9000])
    return out[:n]


@pytest.mark.parametrize("step", [3, 40, 120])
def test_against_the_plain_version(spark, step):
    rows = [(i, k, a, o, s) for k in ("aa", " AA ", "bb") for i, (s, a, o) in enumerate(walk(ord(k.strip().lower()[0]) + step, step, 500))]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    rows += [(9990, None, 1.0, 1.0, 5), (9991, "aa", None, 1.0, 6), (9992, "aa", 91.0, 1.0, 7), (9993, "aa", 1.0, 1.0, None)]
    want = brute.stops_and_trips(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == want
    assert found(df, slice_s=3000, segment_s=600) == want


def test_whole_table(spark, data):
    t = spark.read.parquet(f"{data}/bronze_positions.parquet").select("pos_id", "icao24", "latitude", "longitude", F.unix_seconds("timestamp").alias("s"))
    assert found(t, slice_s=7200, segment_s=900) == brute.stops_and_trips([tuple(r) for r in t.collect()])


def test_nothing_in_nothing_out(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == set()
    assert found(spark.createDataFrame([(1, "a", 1.0, 1.0, 5)], SCHEMA)) == set()


def test_places_recur(spark):
    rows, i = [], 0
    for visit, (lat, lon) in enumerate([(0.0, 0.0), (1.0, 1.0), (0.0005, 0.0), (1.0, 1.0)]):
        for m in range(8):
            rows.append((i := i + 1, "a", lat, lon, visit * 2000 + m * 120))
    df = spark.createDataFrame(rows, SCHEMA)
    pings = clean_pings(df, "icao24", "latitude", "longitude", F.col("s"), "pos_id")
    out = stops_and_trips(pings).orderBy("start_s", "kind").collect()
    stops = [r.place for r in out if r.kind == "stop"]
    assert len(stops) == 4 and stops[0] == stops[2] != stops[1] == stops[3]
    trips = [r for r in out if r.kind == "trip"]
    assert len(trips) == 3 and all(150 < t.distance_km < 160 and t.path_km >= t.distance_km - 0.1 for t in trips)
    assert [(t.place, t.to_place) for t in trips][0] == (stops[0], stops[1])


def longest_runs(s, p, near, least):
    import numpy as np

    s = np.asarray(s)
    at = {int(x): i for i, x in enumerate(s)}
    got = longest_first(windows_of(s, np.arange(len(s)), np.asarray(p, float) + [6371.0, 0, 0], near, least), least)
    for a, b, n, *_ in got:
        assert n == at[b] - at[a] + 1
    return [(at[a], at[b]) for a, b, *_ in got]


def test_longest_runs_take_the_longest_first():
    import numpy as np

    s = np.array([0, 300, 600, 900, 1200])
    p = np.array([[0, 0, 0], [0, 0.2, 0], [0, 0.8, 0], [0, 1.1, 0], [0, 1.15, 0]], float)
    assert longest_runs(s, p, 1.0, 600) == [(1, 4)]


def test_any_series_of_points():
    import numpy as np
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.tuples(st.integers(1, 400), st.integers(-12, 12)), min_size=1, max_size=25))
    def check(moves):
        s = np.cumsum([m[0] for m in moves])
        x = np.cumsum([m[1] for m in moves]) / 10
        p = np.c_[np.zeros_like(x), x, np.zeros_like(x)]

        def longest(a, b):
            fits = [(s[j] - s[i], -j, i, j) for i in range(a, b + 1) for j in range(i, b + 1) if x[i : j + 1].max() - x[i : j + 1].min() <= 1 + 1e-9]
            if not fits or max(fits)[0] < 600:
                return []
            _, _, i, j = max(fits)
            return longest(a, i - 1) + [(i, j)] + longest(j + 1, b) if a <= b else []

        got = longest_runs(s, p, 1 + 1e-9, 600)
        assert all(s[j] - s[i] >= 600 and x[i : j + 1].max() - x[i : j + 1].min() <= 1 + 1e-8 for i, j in got)
        assert [int(s[j] - s[i]) for i, j in got] == [int(s[j] - s[i]) for i, j in longest(0, len(s) - 1)]

    check()


def test_windows_in_the_plane_against_all_pairs():
    import numpy as np
    from aerolith.operators.trips import maximal_windows

    rng = np.random.default_rng(3)
    for wide in (0.3, 0.49, 0.498, 0.51, 1.0):
        angle = rng.uniform(0, 2 * np.pi, 400)
        r = wide * (1 if wide in (0.49, 0.498) else np.sqrt(rng.random(400)))
        p = np.c_[np.full(400, 6371.0), r * np.cos(angle), r * np.sin(angle)] + np.c_[np.zeros(400), np.repeat(rng.normal(size=8), 50) * (wide > 0.5), np.zeros(400)]
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) > 1
        want, first = [], 0
        for j in range(400):
            off = np.flatnonzero(d[j, first:j])
            first += int(off[-1]) + 1 if off.size else 0
            want.append(first)
        assert maximal_windows(p, 1.0).tolist() == want


def test_a_circle_of_pings_takes_linear_time():
    import time

    import numpy as np
    from aerolith.operators.trips import maximal_windows

    angle = np.random.default_rng(1).uniform(0, 2 * np.pi, 40_000)
    p = np.c_[np.full(40_000, 6371.0), 0.49 * np.cos(angle), 0.49 * np.sin(angle)]
    began = time.time()
    assert not maximal_windows(p, 1.0).any() and time.time() - began < 8


def parked(days=3):
    """Jitters about one stand by day and another, 1.3 km off, by night, without a break; pings every 60 seconds."""
    rnd, rows, at = random.Random(9), [], 0.0
    for i in range(days * 1440):
        goal = 0.0117 if (i // 360) % 2 else 0.0
        at += max(-0.0004, min(0.0004, goal - at))
        rows.append((i, "aa", 10 + at + rnd.gauss(0, 2e-4), 20 + rnd.gauss(0, 2e-4), 60 * i))
    return rows


def test_a_parked_aircraft_is_searched_in_parts(spark, monkeypatch):
    from aerolith.operators import trips

    rows = parked()
    df = spark.createDataFrame(rows, SCHEMA)
    seen, plain = [], trips.parts_of
    monkeypatch.setattr(trips, "parts_of", lambda *a: seen.append(plain(*a)) or seen[-1])
    assert found(df) == brute.stops_and_trips(rows)
    assert seen[0].count() > 4
    # without communities there is one visit, and one part of all its pings
    monkeypatch.setattr(trips, "place_communities", lambda still, rule: still.select(
        "k", *[F.floor(F.col(f"{c}_med") / rule.cell_km).cast("int").alias(f"c{c}") for c in "xyz"]).distinct().withColumn("place", F.lit("one")))
    assert found(df) == brute.stops_and_trips(rows)
    assert seen[1].count() == 1
