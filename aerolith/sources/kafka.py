"""Kafka as source and sink, by options only: the connector is a jar the cluster brings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader


def stream_reader(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataStreamReader:
    """starting: earliest for ingestion, latest for scoring."""
    return spark.readStream.format("kafka").options(**{
        "kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false"
    })


def producer_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.linger.ms": "5"}


def messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, value): all columns as JSON; null fields are left out of it."""
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")
    return df.select(value) if key is None else df.select(F.col(key).cast("string").alias("key"), value)


def publish(df: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    messages(df, key).write.format("kafka").options(**producer_options(servers, topic)).save()


def readable(raw: DataFrame) -> DataFrame:
    """Values as text, bytes that aren't UTF-8 dropped from them, and only those that are JSON objects."""
    text = raw.select(F.try_validate_utf8(F.col("value").cast("string")).alias("value"))
    return text.where(F.expr("try_cast(try_parse_json(value) AS map<string, variant>) IS NOT NULL"))
