"""Motion features between successive positions: one definition for batch and stream, variants by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from .slices import sliced

MOVEMENTS = ("l1_degrees", "km_per_s", "km_per_s_ma3")
LABELS = ("fast", "gap_or_still")


def km_per_s(km: Column, delta_t: Column) -> Column:
    """0 for a first observation, missing coordinates or no time between."""
    return F.when(delta_t.isNull() | km.isNull() | (delta_t <= 0), F.lit(0.0)).otherwise(km / F.greatest(F.lit(1), delta_t))


def label(rule: str, delta_t: Column, movement: Column) -> Column:
    """fast: movement of at least 0.7. gap_or_still: more than ten minutes, or a movement under 0.001."""
    hit = {"fast": movement >= 0.7, "gap_or_still": (delta_t > 600) | (movement < 0.001)}[rule]
    return F.when(hit, 1).otherwise(0)


def features(df: DataFrame, movement: str = "km_per_s_ma3", label_rule: str = "fast", first: bool = False, entity: str = "icao24") -> DataFrame:
    """(entity, second, flight_date, delta_t, movement_score, risk_label) from positions with one row per entity and
    second. The first observation of an entity is left out unless `first`. One slice-wise window, so that an entity
    with a third of all rows is many tasks; deltas cross midnight."""
    if movement not in MOVEMENTS:
        raise ValueError(f"no movement {movement!r}")
    cut = sliced(df.select(entity, "second", "latitude", "longitude", "date"), entity, "second", back=4)
    w = W.partitionBy(entity, "_slice").orderBy("second")
    cut = cut.withColumn("_p", F.lag(F.struct("latitude", "longitude", "second")).over(w))
    delta = F.col("second") - F.col("_p.second")
    km = haversine_km("_p.latitude", "_p.longitude", "latitude", "longitude")
    cut = cut.withColumns({"delta_t": delta, "_v": km_per_s(km, delta)})
    score = {
        "l1_degrees": F.abs(F.col("latitude") - F.col("_p.latitude")) + F.abs(F.col("longitude") - F.col("_p.longitude")),
        "km_per_s": F.col("_v"),
        "km_per_s_ma3": F.avg("_v").over(w.rowsBetween(-2, 0)),
    }[movement]
    out = cut.withColumn("movement_score", score).where("_own")
    if not first:
        out = out.where("delta_t IS NOT NULL")
    return out.select(
        entity, "second", F.col("date").alias("flight_date"), "delta_t", "movement_score",
        label(label_rule, F.col("delta_t"), F.col("movement_score")).alias("risk_label"),
    )


def key_split(df: DataFrame, key: Column, parts: int = 10, test: int = 2) -> DataFrame:
    """A column `is_test`, the same for a key at every run, in any order and partitioning: integer arithmetic on it."""
    return df.withColumn("is_test", F.pmod(key * F.lit(2654435761), F.lit(1000003)) % parts < test)
