"""Frames that feed a report: prepared scores, statistics per flight, key figures, ranked flights, thinned tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.instants import local_iso
from ..functions.risk import line_weight, normalise_risk, risk_colour
from .slices import numbered

REQUIRED = ["icao24", "evt_ts", "latitude", "longitude", "risk_probability"]


def prepare(df: DataFrame) -> DataFrame:
    """Names of the report, risks as fractions, rows without time or coordinates out."""
    out = normalise_risk(df.select(*REQUIRED), "risk_probability").select(
        F.col("icao24").alias("flight_id"), F.col("evt_ts").cast("bigint").alias("second"),
        F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), "risk",
    )
    return out.dropna(subset=["second", "lat", "lon"])


def dropped(df: DataFrame) -> DataFrame:
    """One row: how many rows `prepare` takes and leaves out."""
    there = F.col("evt_ts").isNotNull() & F.col("latitude").try_cast("double").isNotNull() & F.col("longitude").try_cast("double").isNotNull()
    return df.agg(F.count_if(there).alias("kept"), F.count_if(~there).alias("dropped"))


def selected(df: DataFrame, flights: list[str]) -> DataFrame:
    return df.where(F.col("flight_id").isin(flights))


def in_range(df: DataFrame, first_us: int, last_us: int) -> DataFrame:
    """Times within both ends, in microseconds; a range of whole seconds on the stored column, so it is pushed down."""
    return df.where(F.col("second").between(-(-first_us // 1_000_000), last_us // 1_000_000))


def flight_stats(df: DataFrame) -> DataFrame:
    """Points, first and last time, mean and highest risk of each flight, that of no name too."""
    return df.groupBy("flight_id").agg(
        F.count("second").alias("points"), F.min("second").alias("first_s"), F.max("second").alias("last_s"),
        F.avg("risk").alias("avg_risk"), F.max("risk").alias("max_risk"),
    )


def key_figures(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_distinct("flight_id").alias("flights"), F.count(F.lit(1)).alias("points"),
        F.coalesce(F.avg("risk"), F.lit(0.0)).alias("avg_risk"), F.coalesce(F.max("risk"), F.lit(0.0)).alias("max_risk"),
    )


def top_flights(stats: DataFrame, n: int = 15) -> DataFrame:
    return stats.orderBy(F.desc("avg_risk"), F.desc("points"), "flight_id").limit(n)


def median_exact(df: DataFrame, column: str, bins: int = 4096) -> Column:
    """The median, between ranks, as a scalar: rows are counted in `bins` equal parts of the range, and only the values
    in the parts of the two middle ranks are counted one by one, so no task holds all distinct values unless they lie
    in one part of 4,096."""
    x = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).cast("double").alias("x"))
    r = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not r["n"]:
        return F.lit(None).cast("double")
    wide = (r["hi"] - r["lo"]) / bins or 1.0
    part = F.least(F.lit(bins - 1), F.floor((F.col("x") - r["lo"]) / wide)).cast("int")
    x, counts = x.withColumn("b", part), {}
    for b, n in x.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `bins` rows
        counts[b] = n
    ranks, upto, before = ((r["n"] - 1) // 2, r["n"] // 2), 0, {}
    for b in sorted(counts):
        for k in ranks:
            if upto <= k < upto + counts[b]:
                before[k] = (b, upto)
        upto += counts[b]
    values = x.where(F.col("b").isin([b for b, _ in before.values()])).groupBy("b", "x").agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("upto", F.sum("n").over(W.partitionBy("b").orderBy("x")))
    at = [F.min(F.when((F.col("b") == b) & (F.col("upto") > k - first), F.col("x"))) for k, (b, first) in ((k, before[k]) for k in ranks)]
    return values.agg(((at[0] + at[1]) / 2).alias("m")).scalar()


def centre(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(median_exact(df, "lat").alias("lat"), median_exact(df, "lon").alias("lon"))


def kept_in_thinning(row: Column, rows: Column, most: int) -> Column:
    """Whether row number `row` (from 0) of `rows` stays when a track is thinned evenly to `most` points; the first
    and the last stay. Integers only."""
    if most <= 1:
        return row == 0
    m, n = F.lit(most - 1), F.greatest(rows - 1, F.lit(1))
    up = F.floor((row * m + n - 1) / n)
    return (rows <= most) | ((up * n) < (row + 1) * m)


def tracks(df: DataFrame, most: int = 200, least: int = 2, order: list[str] | None = None) -> DataFrame:
    """Points of each flight in order, at most `most` of them; flights with fewer than `least` points are left out."""
    order = order or ["second"]
    cut = numbered(df.where(F.col("flight_id").isNotNull()), "flight_id", order, F.floor(F.col("second") / 21600))
    cut = cut.where((F.col("_len") >= least) & kept_in_thinning(F.col("_rn"), F.col("_len"), most))
    return cut.withColumn("point", F.col("_rn").cast("bigint")).drop("_rn", "_len")


def drawn(df: DataFrame) -> DataFrame:
    """Colour and line weight of each flight from its mean risk."""
    return df.withColumns({"colour": risk_colour(F.col("avg_risk")), "weight": line_weight(F.col("avg_risk"))})


def exported(df: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """A track or flight list as it leaves for a file: epoch columns as local ISO-8601 times with offset."""
    return df.select(*[local_iso(c, zone).alias(c.removesuffix("_s")) if c in ("second", "first_s", "last_s") else F.col(c) for c in df.columns])


def ends(df: DataFrame) -> DataFrame:
    """First and last point of each flight."""
    p = F.struct("second", "lat", "lon")
    return df.groupBy("flight_id").agg(F.min(p).alias("a"), F.max(p).alias("b")).select(
        "flight_id", F.col("a.lat").alias("lat_from"), F.col("a.lon").alias("lon_from"), F.col("b.lat").alias("lat_to"), F.col("b.lon").alias("lon_to")
    )
