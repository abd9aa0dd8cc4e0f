"""Raw positions to clean ones: identity, coordinates, time, and one row per entity and second."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import on_globe
from ..functions.identity import identity
from ..functions.instants import utc_date

SILVER = ["icao24", "latitude", "longitude", "flight", "reg", "second", "date"]


def in_bounds(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows with both coordinates on the globe, bounds included. Plain comparisons on the stored columns, so that
    they reach the scan."""
    return df.where(F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0))


def one_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; `order` must be total."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def normalised(df: DataFrame, second: Column, tie_break: list[str], rule: str = "canonical", now: Column | None = None) -> DataFrame:
    """All rows under the columns that `clean` decides by: SILVER without the date, and the tie-break columns."""
    kinds = dict(df.dtypes)
    number = lambda c: F.col(c) if kinds[c] == "double" else F.col(c).try_cast("double")
    s = second if now is None else F.coalesce(second, now)
    return df.select(
        identity(rule).alias("icao24"), number("latitude").alias("latitude"), number("longitude").alias("longitude"),
        "flight", "reg", s.cast("bigint").alias("second"), *tie_break,
    )


def passes() -> Column:
    """Which normalised rows are clean, but for copies."""
    return F.col("second").isNotNull() & on_globe("latitude", "longitude")


def clean(df: DataFrame, second: Column, tie_break: list[str], rule: str = "canonical", now: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """SILVER and the tie-break columns. Rows without a time take `now`; without one they are left out (the daily run
    keeps them by `quality.quarantine` over the normalised rows). Coordinates that aren't numbers are null and go.
    order: what decides between copies, where the tie-break alone isn't total."""
    out = in_bounds(normalised(df, second, tie_break, rule, now)).where(passes())
    out = one_per_key(out, ["icao24", "second"], order or tie_break)
    return out.select(*SILVER[:-1], utc_date("second").alias("date"), *tie_break)


def union_drifted(frames: list[DataFrame], renames: dict[str, str] | None = None) -> DataFrame:
    """UNION ALL by name; columns under other names are renamed, missing ones are null."""
    renames = {"lat": "latitude", "lon": "longitude"} if renames is None else renames
    fixed = [f.withColumnsRenamed({a: b for a, b in renames.items() if a in f.columns and b not in f.columns}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fixed)
