import random

import brute
from aerolith.functions.identity import entity_key
from aerolith.operators.regions import Grid, near_pairs, points_in_regions

SCHEMA = "id bigint, k string, lat double, lon double, s bigint"


def pairs(df, grid=Grid()):
    return {tuple(r) for r in near_pairs(df, "id", entity_key("k"), "lat", "lon", "s", 1.0, 120, grid).collect()}


def test_near_pairs_everywhere(spark):
    rnd, rows = random.Random(5), []
    centres = [(0, 0), (45, 180), (45, -179.999), (89.999, 10), (89.995, -170), (-89.9999, 0), (60, 30), (90.0, 0.0), (-90.0, 77.0)]
    for i in range(700):
        a, o = rnd.choice(centres)
        a, o = a + rnd.gauss(0, 0.006), o + rnd.gauss(0, 0.006 if abs(a) < 80 else 40)
        rows.append((i, rnd.choice(["a", " A", "b", "c", "", None]), max(-90.0, min(90.0, a)), (o + 180) % 360 - 180, rnd.randint(0, 500)))
    rows += [(900, "x", None, 1.0, 5), (901, "y", 91.0, 1.0, 5), (902, "z", 1.0, 1.0, None), (903, "w", float("nan"), 0.0, 1)]
    rows += [(904, "p", 60.0, 180.0, 5), (905, "q", 60.0, -180.0, 125), (906, "r", 60.0, 180.0, 126)]
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and None not in (x[2], x[3], x[4], y[2], y[3], y[4]) and x[0] not in (901, 903) and y[0] not in (901, 903):
                kx, ky = brute.key_of(x[1]), brute.key_of(y[1])
                if kx and ky and kx != ky and abs(x[4] - y[4]) <= 120 and brute.hav(x[2], x[3], y[2], y[3]) <= 1.0:
                    want.add((x[0], y[0]))
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(want) > 100 and pairs(df) == want
    assert pairs(df, Grid(0.7, 9.0)) == want
    assert pairs(df.limit(0)) == set()


def test_near_pairs_over_the_date_line_beside_a_pole(spark):
    rnd = random.Random(8)
    rows = [(0, "a", 89.9, 179.0, 5), (1, "b", 89.9, -178.5, 5)]
    for i in range(2, 500):  # where boxes are wider than a degree and hold no pole
        a = rnd.choice([-1, 1]) * (90 - rnd.choice([0.0091, 0.012, 0.02, 0.03, 0.1, 0.3, 0.6]) - abs(rnd.gauss(0, 0.003)))
        wide = min(150.0, 0.6 / (90 - abs(a)))
        rows.append((i, rnd.choice("abc"), a, (180 + rnd.uniform(-wide, wide) + 180) % 360 - 180, 5))
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] != y[1] and brute.hav(x[2], x[3], y[2], y[3]) <= 1.0}
    over = {(i, j) for i, j in want if rows[i][3] * rows[j][3] < 0}
    assert (0, 1) in over and len(over) > 1000
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(df) == want and pairs(df, Grid(0.7, 9.0)) == want


def inside(lat, lon, ring):
    odd = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if (a > lat) != (c > lat) and lon < b + (lat - a) / (c - a) * (d - b):
            odd = not odd
    return odd


def test_points_in_polygons_and_on_their_edges(spark):
    rings = {
        1: [(0.0, 0.0), (0.0, 4.0), (3.0, 4.0), (3.0, 0.0)], 2: [(1.0, 1.0), (5.0, 3.0), (1.0, 5.0), (2.0, 3.0)],
        3: [(10.0, 178.0), (10.0, 183.0), (14.0, 183.0), (14.0, 178.0)], 4: [(0.0, 0.0), (1.0, 1.0)],
    }
    regions = spark.createDataFrame([(k, [{"lat": a, "lon": o} for a, o in r]) for k, r in rings.items()], "r bigint, ring array<struct<lat:double,lon:double>>")
    rnd = random.Random(2)
    pts = [(i, rnd.uniform(-1, 15), rnd.choice([rnd.uniform(-1, 6), rnd.uniform(177, 180), rnd.uniform(-180, -176)])) for i in range(600)]
    df = spark.createDataFrame(pts, "i bigint, a double, o double")
    got = {tuple(x) for x in points_in_regions(df, regions, "i", "a", "o", "r", "ring").collect()}
    want = {(i, k) for i, a, o in pts for k, r in rings.items() if len(r) > 2 and any(inside(a, o + t, r) for t in (0, 360, -360))}
    assert got == want
    edge = spark.createDataFrame([(1, 0.0, 2.0), (2, 3.0, 2.0), (3, 1.0, 0.0), (4, 1.0, 4.0), (5, 0.0, 0.0), (6, 0.0, 5.0)], "i bigint, a double, o double")
    one = regions.where("r = 1")
    assert {x[0] for x in points_in_regions(edge, one, "i", "a", "o", "r", "ring", boundary=True).collect()} == {1, 2, 3, 4, 5}
    assert {x[0] for x in points_in_regions(edge, one, "i", "a", "o", "r", "ring", boundary=False).collect()} == set()
    assert points_in_regions(edge.limit(0), one, "i", "a", "o", "r", "ring").count() == 0


def test_keys_of_a_crowded_place_are_not_paired_off(spark):
    """Many keys in one bin, none near another: no row gets past the boxes of the keys."""
    from aerolith.operators import regions

    rows = [(i, f"k{i}", 10 + 0.001 * (i % 20), 10 + 0.001 * (i // 20), 100 + i % 50) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    made, plain = [], regions.ring_edges
    try:
        regions.ring_edges = lambda t, *a: made.append(t) or plain(t, *a)
        out = near_pairs(df, "id", entity_key("k"), "lat", "lon", "s", 0.05, 120)
        assert out.count() == 0 and made[0].count() == 0
    finally:
        regions.ring_edges = plain
    out = near_pairs(df, "id", entity_key("k"), "lat", "lon", "s", 0.115, 120).count()
    assert out == sum(brute.hav(*x[2:4], *y[2:4]) <= 0.115 for x in rows for y in rows if x[0] < y[0]) > 300
