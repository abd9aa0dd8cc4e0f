"""File sinks."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession


def parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Snappy Parquet. With partition columns an overwrite replaces only the partitions it writes, so a rerun of a day
    leaves the others and doubles nothing."""
    w = df.write.mode(mode).option("compression", "snappy")
    if by:
        w = w.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def one_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for small results. White space at the ends of texts is kept."""
    w = df.coalesce(1).write.mode("overwrite").option("header", True)
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def result(df: DataFrame, folder: str, name: str, by: list[str] | None = None) -> None:
    """A gold result: Parquet, and a CSV preview read from it, so the plan runs once."""
    parquet(df, f"{folder}/{name}", by)
    one_csv(df.sparkSession.read.parquet(f"{folder}/{name}"), f"{folder}/{name}_csv")


def latest_json(row: dict, path: str, spark: SparkSession | None = None) -> None:
    """One row of metrics as a file that people read, replaced as a whole; with a session on whatever file system the
    path names."""
    if spark is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(at(f"{path}.tmp"), True)
        out.write(bytearray(json.dumps(row, indent=2, default=str), "utf-8"))
        out.close()
        fs.delete(at(path), False)
        fs.rename(at(f"{path}.tmp"), at(path))
        return
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(row, f, indent=2, default=str)
    os.replace(tmp, path)
