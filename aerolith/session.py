"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "aerolith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for: UTC, adaptive plans, ANSI left on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.int96RebaseModeInRead": "CORRECTED",
        "spark.sql.parquet.datetimeRebaseModeInRead": "CORRECTED",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    for k, v in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in ``spark.checkpoint.dir``; only where it is unset
    (tests, local mode) a temporary one is made."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"aerolith-checkpoints-{os.getpid()}")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def shared(spark: SparkSession, name: str) -> str:
    """A new folder of this session below the shared checkpoint folder; it goes when the session's program ends."""
    top = f"{checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if top not in _MADE:
        _MADE.add(top)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

        def remove():  # registered after Spark's own, so it runs before the session ends
            try:
                fs.delete(at, True)
            except Exception:  # the session is gone already: whoever owns the folder clears it
                pass

        atexit.register(remove)
    return f"{top}/{name}-{uuid.uuid4().hex}"


_MADE: set[str] = set()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared checkpoint folder: compressed, read by columns, and there
    whatever executors are lost. A task that is run again replaces its own file only (the output committer's rule)."""
    spark = df.sparkSession
    path = shared(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
