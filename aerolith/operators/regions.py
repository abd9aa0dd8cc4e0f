"""Points in regions, and points near points, by crossing parity in SQL.

Edges of polygons are binned into latitude strips, and inside a strip into cells of about one width in km, over the
span of their region; a point looks only at the edges in its own strip and cell (and, where both have them, in its own
bucket of time or any other key). A ray runs east from the point; an edge is crossed if the point's latitude is in the
edge's half-open range of latitudes, so a vertex counts for one of its edges, and horizontal edges for none. Crossings
are grouped by point and region: an odd number is inside. Points on an edge are handled explicitly: `boundary` puts
them in or out. Longitudes are unrolled: a region may reach beyond +-180, and points near the date line also stand
there once more, 360 degrees on; a region that holds a pole spans all longitudes up to the pole.

The nearby points of a point are the points in the box around its circle, by the same operator; the exact distance on
the sphere decides, and is asked before a crossing moves. Rows of one key in one bin are first taken together with the
box around them: only bins and keys whose boxes come near each other are looked at row by row. So neither the rows of
one key nor the keys of a crowded place are paired off. No cross join, nothing broadcast by hand.

Defined results: coordinates that are null, NaN or off the globe are nowhere. Rings may be open or closed; fewer than
three vertices hold nothing. Repeated points are points of their own. Empty input, empty output.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km, on_globe

KM_PER_DEGREE = math.pi * EARTH_KM / 180


@dataclass(frozen=True)
class Grid:
    strip_km: float = 4.0
    cell_km: float = 4.0

    def strip(self, lat: Column) -> Column:
        return F.floor(lat * (KM_PER_DEGREE / self.strip_km)).cast("int")

    def cell(self, strip: Column, lon: Column) -> Column:
        """Number of the cell; cells of a strip are equally wide, one strip near a pole is one cell."""
        middle = (strip + 0.5) * (self.strip_km / KM_PER_DEGREE)
        around = F.greatest(F.lit(1.0), F.floor(F.cos(F.radians(middle)) * (360 * KM_PER_DEGREE / self.cell_km)))
        return F.floor((lon + 180) / 360 * around).cast("int")


def unrolled(points: DataFrame, lat: str, lon: str, margin: float | Column) -> DataFrame:
    """points on the globe, those within `margin` degrees of the date line once more on the other side: _lat, _lon."""
    p = points.where(on_globe(lat, lon)).withColumn("_lat", F.col(lat).cast("double"))
    x = F.col(lon).cast("double")
    copies = F.array(x, F.when(x > 180 - margin, x - 360), F.when(x < margin - 180, x + 360))
    return p.withColumn("_lon", F.explode(F.array_compact(copies)))


def ring_edges(regions: DataFrame, region: str, ring: str, carry: list[str]) -> DataFrame:
    """One row per edge of each ring (array of structs lat, lon): (region, carry, lat1, lon1, lat2, lon2, _west, _east)."""
    r = regions.where(F.size(ring) >= 3).select(
        F.col(region).alias("region"), *carry, F.col(ring).alias("_r"),
        F.array_min(F.transform(ring, lambda v: v["lon"])).alias("_west"), F.array_max(F.transform(ring, lambda v: v["lon"])).alias("_east"),
    )
    ends = F.transform("_r", lambda v, i: F.struct(v.alias("a"), F.element_at("_r", (i + 1) % F.size("_r") + 1).alias("b")))
    r = r.select("region", *carry, "_west", "_east", F.explode(ends).alias("e"))
    return r.select("region", *carry, F.col("e.a.lat").alias("lat1"), F.col("e.a.lon").alias("lon1"), F.col("e.b.lat").alias("lat2"), F.col("e.b.lon").alias("lon2"), "_west", "_east")


def binned(edges: DataFrame, grid: Grid) -> DataFrame:
    lo, hi = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    e = edges.withColumn("_strip", F.explode(F.sequence(grid.strip(lo), grid.strip(hi))))
    return e.withColumn("_cell", F.explode(F.sequence(grid.cell(F.col("_strip"), F.col("_west")), grid.cell(F.col("_strip"), F.col("_east")))))


def placed(points: DataFrame, grid: Grid) -> DataFrame:
    p = points.withColumn("_strip", grid.strip(F.col("_lat")))
    return p.withColumn("_cell", grid.cell(F.col("_strip"), F.col("_lon")))


BIN = ["_strip", "_cell"]


def crossings(points: DataFrame, edges: DataFrame, point: list[str], keys: list[str], also: Column | None = None, boundary: bool | None = None) -> DataFrame:
    """Pairs inside: (point, region). points: from `placed`; edges: from `binned`. keys: what must be equal, BIN among
    it. also: a condition on the pair that may drop it early. boundary: what a point on an edge is; None if it doesn't
    matter (edges without height can then be left out before)."""
    lo, hi = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    spans = (F.col("_lat") >= lo) & (F.col("_lat") < hi)
    at = F.col("lon1") + (F.col("_lat") - F.col("lat1")) / (F.col("lat2") - F.col("lat1")) * (F.col("lon2") - F.col("lon1"))
    crossed = F.when(spans, F.coalesce(F.when(F.col("lat1") != F.col("lat2"), at) > F.col("_lon"), F.lit(False))).otherwise(False)
    on = (
        (F.col("_lat") >= lo) & (F.col("_lat") <= hi)
        & F.when(F.col("lat1") == F.col("lat2"), F.col("_lon").between(F.least("lon1", "lon2"), F.greatest("lon1", "lon2"))).otherwise(at == F.col("_lon"))
    )
    joined = points.join(edges, keys)
    if also is not None:
        joined = joined.where(also)
    joined = joined.withColumn("_x", crossed.cast("int")).withColumn("_on", on if boundary is not None else F.lit(False))
    joined = joined.where((F.col("_x") == 1) | F.col("_on"))
    g = joined.groupBy(*point, "_lon", "region").agg((F.sum("_x") % 2).alias("_odd"), F.max("_on").alias("_on"))
    inside = F.col("_odd") == 1
    if boundary is not None:
        inside = F.when(F.col("_on"), F.lit(boundary)).otherwise(inside)
    return g.where(inside).select(*point, "region").distinct()


def points_in_regions(points: DataFrame, regions: DataFrame, point: str, lat: str, lon: str, region: str, ring: str, grid: Grid = Grid(50.0, 50.0), boundary: bool = True) -> DataFrame:
    """(point, region): which regions hold which points. Longitudes of rings may reach from -360 to 360. The grid
    should be about as wide as the regions are."""
    p = points.select(F.col(point).alias("point"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    p = placed(unrolled(p, "lat", "lon", 180.0), grid)
    return crossings(p, binned(ring_edges(regions, region, ring, []), grid), ["point"], BIN, boundary=boundary)


def box_ring(lat: Column, lon: Column, radius_km: float) -> Column:
    """The box around the circle, as a ring."""
    r = radius_km / EARTH_KM * (1 + 1e-9) + 1e-12
    dlat = math.degrees(r)
    polar = F.abs(lat) + dlat >= 90
    dlon = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(r)) / F.cos(F.radians(lat))))) * (1 + 1e-9) + 1e-9
    west, east = F.when(polar, F.lit(-180.5)).otherwise(lon - dlon), F.when(polar, F.lit(180.5)).otherwise(lon + dlon)
    south, north = lat - dlat - 1e-9, lat + dlat + 1e-9
    v = lambda a, o: F.struct(a.alias("lat"), o.alias("lon"))
    return F.array(v(south, west), v(south, east), v(north, east), v(north, west))


def reach(lat: Column, radius_km: float) -> Column:
    """How far over the date line, in degrees, a box around a place can reach that holds a point of this latitude: the
    place is at most the box's height nearer to the pole. Boxes that hold a pole reach half a degree over."""
    r = radius_km / EARTH_KM * (1 + 1e-9) + 1e-12
    nearest = F.abs(lat) + math.degrees(r) + 1e-6  # of the places whose boxes hold the point
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(r)) / F.cos(F.radians(nearest))))) + 1e-6
    return F.when(nearest >= 90, F.lit(180.0)).otherwise(F.greatest(F.lit(1.0), wide))


def near_pairs(df: DataFrame, id_: str, key: Column, lat: str, lon: str, second: str, radius_km: float, within_s: int, grid: Grid = Grid()) -> DataFrame:
    """(id_a, id_b): pairs of rows with different keys, at most radius_km apart, at most within_s apart in time."""
    rows = df.select(F.col(id_).alias("id"), key.alias("k"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(second).cast("bigint").alias("s"))
    rows = rows.where(F.col("id").isNotNull() & F.col("k").isNotNull() & F.col("s").isNotNull() & on_globe("lat", "lon"))
    wide = 8 * within_s
    bucket = lambda s: F.floor(s / wide)
    at = [*BIN, "_t"]
    points = placed(unrolled(rows.withColumn("_t", bucket(F.col("s"))), "lat", "lon", reach(F.col("lat"), radius_km)), grid)
    # places by the bins that their boxes touch; the edges are only made where two keys come near each other
    places = rows.select(*[F.col(c).alias(f"{c}_a") for c in ("id", "k", "s", "lat", "lon")])
    ring = box_ring(F.col("lat_a"), F.col("lon_a"), radius_km)
    south, north, west, east = ring[0]["lat"], ring[2]["lat"], ring[0]["lon"], ring[1]["lon"]
    touched = places.withColumn("_strip", F.explode(F.sequence(grid.strip(south), grid.strip(north))))
    touched = touched.withColumn("_cell", F.explode(F.sequence(grid.cell(F.col("_strip"), west), grid.cell(F.col("_strip"), east))))
    touched = touched.withColumn("_t", F.explode(F.sequence(bucket(F.col("s_a") - within_s), bucket(F.col("s_a") + within_s))))
    # one row per bin and key, with the box in space and time around its rows: rows of one key are never held against
    # each other, and rows of two keys only where these boxes overlap
    span = lambda low, high, name: [F.min(low).alias(f"{name}_lo"), F.max(high).alias(f"{name}_hi")]
    boxes = touched.groupBy(*at, "k_a").agg(*span(south, north, "a"), *span(west, east, "o"), *span(F.col("s_a") - within_s, F.col("s_a") + within_s, "s"))
    seen = points.groupBy(*at, "k").agg(*span("_lat", "_lat", "pa"), *span("_lon", "_lon", "po"), *span("s", "s", "ps"))
    overlap = F.col("k") != F.col("k_a")
    for c in "aos":
        overlap = overlap & (F.col(f"{c}_lo") <= F.col(f"p{c}_hi")) & (F.col(f"p{c}_lo") <= F.col(f"{c}_hi"))
    meet = boxes.join(seen, at).where(overlap).select(*at, "k_a", "k")
    touched = touched.join(meet, [*at, "k_a"]).withColumn("ring", ring)
    edges = ring_edges(touched, "id_a", "ring", [*at, "k", "s_a", "lat_a", "lon_a"]).where("lat1 <> lat2")
    edges = edges.where(F.col("_strip").between(grid.strip(F.least("lat1", "lat2")), grid.strip(F.greatest("lat1", "lat2"))))
    near = haversine_km("lat", "lon", "lat_a", "lon_a") <= radius_km  # before the crossings of a pair move
    also = (F.col("region") < F.col("id")) & (F.abs(F.col("s") - F.col("s_a")) <= within_s) & near
    pairs = crossings(points, edges, ["id"], [*at, "k"], also)
    return pairs.select(F.col("region").alias("id_a"), F.col("id").alias("id_b")).distinct()
