"""The wire format: JSON position records to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import entity_key, identity, strip
from ..functions.instants import event_second, utc_date

BRONZE_SCHEMA = "icao24 string, lat double, lon double, flight string, reg string, timestamp bigint"
SCORE_SCHEMA = BRONZE_SCHEMA + ", alt_baro double, gs double, track double"


def parsed(raw: DataFrame, schema: str = BRONZE_SCHEMA, value: str = "value", ingest: str = "timestamp") -> DataFrame:
    """(data struct, ingest_ts): a bad field is null, a bad document a struct of nulls, a null value null."""
    return raw.select(F.from_json(F.col(value).cast("string"), schema).alias("data"), F.col(ingest).alias("ingest_ts"))


def bronze(raw: DataFrame, now: Column | None = None, rule: str = "bronze") -> DataFrame:
    """(icao24, latitude, longitude, flight, reg, timestamp, date) of messages (value, timestamp): the schema of the
    bronze files, as the daily run reads them."""
    d = parsed(raw).select("data.*", "ingest_ts")
    second = event_second("bronze", "timestamp", "ingest_ts", now)
    return d.select(
        identity(rule).alias("icao24"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "flight", "reg", F.timestamp_seconds(second).alias("timestamp"), utc_date(second).alias("date"),
    )


def dead_letters(raw: DataFrame, value: str = "value") -> DataFrame:
    """Messages that aren't one JSON object."""
    return raw.where(F.expr(f"try_cast(try_parse_json(CAST(`{value}` AS string)) AS map<string, variant>) IS NULL"))


def normalised(records: DataFrame, record: str = "record", now: Column | None = None) -> DataFrame:
    """Free-form feed records in the wire schema. Identity is the first filled of hex, icao24, icao; altitude the first
    of alt_baro, alt that is neither null nor 0; callsign the first filled of flight, callsign, stripped, null where
    blank. Records without identity are dropped. The time is the producer's."""
    m = F.expr(f"try_cast(try_parse_json(`{record}`) AS map<string, variant>)")
    r = records.withColumn("_m", m)
    text = lambda k: F.try_element_at("_m", F.lit(k)).try_cast("string")
    num = lambda k: F.try_element_at("_m", F.lit(k)).try_cast("double")
    full = lambda k: F.nullif(text(k), F.lit(""))
    out = r.select(
        entity_key(F.coalesce(full("hex"), full("icao24"), full("icao"))).alias("icao24"),
        num("lat").alias("lat"), num("lon").alias("lon"),
        F.coalesce(F.nullif(num("alt_baro"), F.lit(0.0)), F.nullif(num("alt"), F.lit(0.0))).alias("alt_baro"),
        num("gs").alias("gs"), num("track").alias("track"),
        F.nullif(strip(F.coalesce(full("flight"), full("callsign"))), F.lit("")).alias("flight"),
        text("reg").alias("reg"), text("src").alias("src"),
        (now if now is not None else F.lit(None)).cast("bigint").alias("timestamp"),
    )
    return out.where(F.col("icao24").isNotNull())
