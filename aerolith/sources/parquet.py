"""Reading Parquet folders whose files drift, and files that can't be read."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import event_second, utc_date
from ..operators.clean import union_drifted
from ..operators.quality import QualityError

RENAMES = {"lat": "latitude", "lon": "longitude"}
BRONZE = {"icao24": "string", "latitude": "double", "longitude": "double", "flight": "string", "reg": "string"}


def bulk(spark: SparkSession, folder: str, merge: bool = True) -> DataFrame:
    return spark.read.option("mergeSchema", merge).parquet(folder)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """All Parquet files below a folder, as Spark's own index sees them: hidden and temporary ones don't count.
    A folder that isn't there has none; any other failure is one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path")
    return sorted(r[0] for r in files.collect())


def _footers(batches):
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    for b in batches:
        out = []
        for path in b.column(0).to_pylist():
            try:
                uri = "file:///" + path[5:].lstrip("/") if path.startswith("file:/") else path
                system, inner = fs.FileSystem.from_uri(uri)
            except (pa.ArrowException, ValueError, OSError):
                out.append("?")  # no such file system here; the driver asks Spark
                continue
            try:
                out.append(pq.read_schema(inner, filesystem=system).remove_metadata().to_string(show_field_metadata=False))
            except (pa.ArrowException, OSError):
                out.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["path", "footer"])


def footers(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    """The schema of each file as text, None where its footer can't be read. Footers are read by the executors; only
    for file systems that Python can't open there, Spark is asked file by file."""
    if not paths:
        return {}
    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(1000, len(paths) // 50)))
    got = {r[0]: r[1] for r in df.mapInArrow(_footers, "path string, footer string").collect()}
    for p, f in got.items():
        if f == "?":
            try:
                got[p] = spark.read.parquet(p).schema.json()
            except (PySparkException, Py4JJavaError):
                got[p] = None
    return got


@dataclass
class Drifted:
    frame: DataFrame
    read: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def by_schema(spark: SparkSession, folder: str, also: dict[str, str] | None = None, paths: list[str] | None = None) -> Drifted:
    """All readable files, one scan for each distinct schema, brought to one schema and united by name; files that
    can't be opened are skipped and named. QualityError if none can. also: columns to keep besides BRONZE, with their
    types; paths: these files of the folder only."""
    groups: dict[str, list[str]] = {}
    skipped = []
    for path, footer in sorted(footers(spark, listed(spark, folder) if paths is None else paths).items()):
        skipped.append(path) if footer is None else groups.setdefault(footer, []).append(path)
    if not groups:
        raise QualityError(f"no readable Parquet file in {folder}")
    frames = [typed(spark.read.parquet(*group), also) for group in groups.values()]
    return Drifted(union_drifted(frames), [p for g in groups.values() for p in g], skipped)


def typed(df: DataFrame, also: dict[str, str] | None = None) -> DataFrame:
    """Columns of one file group under their names and types; a time in any form becomes epoch seconds."""
    df = df.withColumnsRenamed({a: b for a, b in RENAMES.items() if a in df.columns and b not in df.columns})
    kinds = dict(df.dtypes)
    cols = [F.col(c).try_cast(t).alias(c) if c in kinds else F.lit(None).cast(t).alias(c) for c, t in (BRONZE | (also or {})).items()]
    if "timestamp" in kinds:
        kind = kinds["timestamp"]
        if kind == "timestamp":
            second = event_second("feature", "timestamp")
        elif kind == "timestamp_ntz":
            second = F.unix_timestamp("timestamp")
        else:
            second = event_second("silver", F.col("timestamp").cast("string"))
    else:
        second = F.col("second") if "second" in kinds else F.lit(None)
    out = df.select(*cols, second.cast("bigint").alias("second"))
    return out.withColumn("date", utc_date("second"))


def with_columns(spark: SparkSession, folder: str, required: list[str]) -> Drifted:
    """A projected read of the files that have all required columns; others are skipped, not filled with nulls."""
    groups: dict[str | None, list[str]] = {}
    for path, footer in sorted(footers(spark, listed(spark, folder)).items()):
        groups.setdefault(footer, []).append(path)
    good, frames, skipped = [], [], groups.pop(None, [])
    for paths in groups.values():  # one scan for each distinct schema
        one = spark.read.parquet(*paths)
        if set(required) <= set(one.columns):
            good += paths
            frames.append(one.select(*required))
        else:
            skipped += paths
    if not good:
        raise QualityError(f"no file in {folder} has {required}")
    return Drifted(union_drifted(frames, {}), good, skipped)
