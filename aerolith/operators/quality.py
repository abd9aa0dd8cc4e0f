"""Data quality: rules, metrics in one pass, quarantine by rule, duplicates."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Status(Enum):
    PASS = 0
    WARNING = 1
    ERROR = 2


class QualityError(Exception):
    """Input that can't be judged: missing, empty or of another schema."""

    status = Status.ERROR


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise QualityError(f"missing columns: {', '.join(missing)}")


def is_null(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def out_of_range(lat: str = "latitude", lon: str = "longitude") -> Column:
    """Strictly outside the bounds; a null is no violation."""
    bad = (F.col(lat) < -90) | (F.col(lat) > 90) | (F.col(lon) < -180) | (F.col(lon) > 180)
    return F.coalesce(bad, F.lit(False))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_rows(df: DataFrame, keys: list[str], null_keys: bool = True) -> DataFrame:
    """All rows of duplicate groups: an inner join with the groups, which are aggregated on the map side, so a group
    of any size is split by adaptive skew joins. With null_keys null equals null; without, a group with a null in its
    key never matches."""
    groups = duplicate_groups(df, keys).select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) if null_keys else F.col(k) == F.col(f"_g{i}") for i, k in enumerate(keys)]
    return df.join(groups, same, "inner").select(*[F.col(f"`{c}`") for c in df.columns])


def metrics(df: DataFrame, keys: list[str] | None = None, columns: list[str] | None = None, threshold: float = 0.05) -> DataFrame:
    """One row: total_rows, null_count, null_ratio, range_count, duplicate_groups, duplicate_rows, status, messages.
    Rows are first counted by key with partial sums, so everything comes from one scan and one exchange."""
    keys = keys or ["icao24", "timestamp"]
    columns = columns or ["latitude", "longitude", "timestamp"]
    by_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_null(columns)).alias("nulls"), F.count_if(out_of_range()).alias("bad")
    )
    m = by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("range_count"), F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    )
    m = m.withColumn("null_ratio", F.when(F.col("total_rows") > 0, F.col("null_count") / F.col("total_rows")).otherwise(0.0))
    says = [
        F.when(F.col("null_ratio") > threshold, F.lit("null ratio above threshold")),
        F.when(F.col("range_count") > 0, F.format_string("%d rows out of range", "range_count")),
        F.when(F.col("duplicate_groups") > 0, F.format_string("%d duplicate groups", "duplicate_groups")),
    ]
    m = m.withColumn("messages", F.concat_ws(" | ", *says))
    status = F.when(F.col("total_rows") == 0, "ERROR").when(F.col("messages") != "", "WARNING").otherwise("PASS")
    return m.withColumn("status", status).select(
        "total_rows", "null_count", "null_ratio", "range_count", "duplicate_groups", "duplicate_rows", "status", "messages"
    )


def quarantine(df: DataFrame, run_id: str, keys: list[str] | None = None, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """rule -> the rows it rejects, with the run. Write each under run_id=..., which hides no column of the rows."""
    keys = keys or ["icao24", "timestamp"]
    columns = columns or ["latitude", "longitude", "timestamp"]
    rules = {"nulls": df.where(is_null(columns)), "range": df.where(out_of_range()), "duplicates": duplicate_rows(df, keys)}
    return {name: rows.withColumn("run_id", F.lit(run_id)) for name, rows in rules.items()}


def judge(df: DataFrame, required: list[str], **kw) -> tuple[Status, dict]:
    """Status and metrics of a table; QualityError if it can't be judged."""
    require_columns(df, required)
    row = metrics(df, **kw).first().asDict()
    if not row["total_rows"]:
        raise QualityError("no rows")
    return Status[row["status"]], row
