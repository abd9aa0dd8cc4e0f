"""Gold aggregates. Each is one partial and one final hash aggregate; nothing here orders an entity's rows except the
speeds, which go through slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_NAUTICAL_MILE, haversine_km
from ..functions.instants import utc_hour
from .slices import sliced


def rows_per_day(df: DataFrame, name: str = "total_flights") -> DataFrame:
    return df.groupBy("date").agg(F.count(F.lit(1)).alias(name))


def entities_per_day(df: DataFrame, entity: str = "icao24") -> DataFrame:
    return df.groupBy("date").agg(F.count_distinct(entity).alias("unique_aircraft"))


def rows_per_hour(df: DataFrame, name: str = "flights") -> DataFrame:
    return df.groupBy("date", utc_hour("second").alias("hour")).agg(F.count(F.lit(1)).alias(name))


def top_entities(df: DataFrame, n: int = 100, entity: str = "icao24") -> DataFrame:
    """The n entities seen most often; ties by name."""
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("sightings")).orderBy(F.desc("sightings"), entity).limit(n)


def busiest_cells(df: DataFrame) -> DataFrame:
    """Records per tenth of a degree."""
    cell = lambda c: (F.floor(F.col(c) * 10) / 10).cast("double")
    return df.groupBy(cell("latitude").alias("lat_cell"), cell("longitude").alias("lon_cell")).agg(F.count(F.lit(1)).alias("records"))


def speeds(df: DataFrame, entity: str = "icao24") -> DataFrame:
    """Speed in knots between successive positions of an entity; df has one row per entity and second."""
    cut = sliced(df.select(entity, "second", "latitude", "longitude"), entity, "second", back=1)
    w = W.partitionBy(entity, "_slice").orderBy("second")
    lag = F.lag(F.struct("latitude", "longitude", "second")).over(w)
    cut = cut.withColumn("_p", lag).where("_own")
    hours = (F.col("second") - F.col("_p.second")) / F.lit(3600.0)
    nm = haversine_km("_p.latitude", "_p.longitude", "latitude", "longitude") / F.lit(KM_PER_NAUTICAL_MILE)
    return cut.select(entity, "second", F.when(hours > 0, nm / hours).alias("speed_kts"))


def speed_stats(df: DataFrame, entity: str = "icao24") -> DataFrame:
    s = speeds(df, entity).where(F.col("speed_kts").isNotNull() & ~F.isnan("speed_kts"))
    return s.groupBy(entity).agg(
        F.count(F.lit(1)).alias("intervals"), F.avg("speed_kts").alias("avg_speed_kts"), F.percentile_approx("speed_kts", 0.5).alias("median_speed_kts")
    )


def gold_daily(df: DataFrame) -> dict[str, DataFrame]:
    return {"rows_per_day": rows_per_day(df), "entities_per_day": entities_per_day(df), "rows_per_hour": rows_per_hour(df)}


def gold_sql(spark: SparkSession, view: str = "aircraft_cleaned") -> dict[str, DataFrame]:
    """The six named results from a registered view, three of them as SQL text."""
    day = spark.sql(f"SELECT date, count(*) AS total_flights FROM {view} GROUP BY date ORDER BY date")
    unique = spark.sql(f"SELECT date, count(DISTINCT icao24) AS unique_aircraft FROM {view} GROUP BY date ORDER BY date")
    hour = spark.sql(
        f"SELECT date, CAST(pmod(floor(second / 3600), 24) AS int) AS hour, count(*) AS total_flights FROM {view} GROUP BY date, hour ORDER BY date, hour"
    )
    df = spark.table(view)
    return {
        "flights_per_day": day, "unique_aircraft_per_day": unique, "flights_per_hour": hour, "top_aircraft": top_entities(df),
        "busiest_cells": busiest_cells(df).orderBy(F.desc("records"), "lat_cell", "lon_cell"),
        "speed_stats": speed_stats(df).orderBy(F.desc("avg_speed_kts"), "icao24"),
    }
