"""The daily run: stages in order, each with what must be there before and after."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import risk_model
from ..operators import aggregates, motion, quality
from ..operators.clean import SILVER, clean, normalised, passes
from ..sinks import files
from ..sources import parquet


@dataclass
class Stage:
    name: str
    run: Callable[[SparkSession, dict], None]
    needs: list[str] = field(default_factory=list)
    gives: list[str] = field(default_factory=list)


@dataclass
class Done:
    name: str
    seconds: float
    attempts: int


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run(spark: SparkSession, stages: list[Stage], where: dict[str, str], retries: int = 1, wait_s: float = 300.0) -> list[Done]:
    """Runs the stages one after the other; a stage that fails is tried again, a quality error isn't."""
    done = []
    for s in stages:
        for n in s.needs:
            if not _there(spark, where[n]):
                raise quality.QualityError(f"{s.name}: {where[n]} is missing")
        began = time.time()
        for attempt in range(1, retries + 2):
            try:
                s.run(spark, where)
                break
            except quality.QualityError:
                raise
            except Exception:
                if attempt > retries:
                    raise
                time.sleep(wait_s)
        for g in s.gives:
            if not _there(spark, where[g]):
                raise quality.QualityError(f"{s.name}: {where[g]} wasn't written")
        done.append(Done(s.name, time.time() - began, attempt))
    return done


def _rows(spark: SparkSession, w: dict, paths: list[str] | None = None) -> parquet.Drifted:
    """The bronze rows, whatever the schemas of their files are, normalised; pos_id is null where a file has none."""
    got = parquet.by_schema(spark, w["bronze"], {"pos_id": "bigint"}, paths)
    got.frame = normalised(got.frame, F.col("second"), ["pos_id"])
    return got


def _clean(spark: SparkSession, w: dict) -> None:
    """Silver, and the list of the files of the run: those read and those skipped."""
    got = _rows(spark, w)
    order = ["pos_id", "latitude", "longitude", "flight", "reg"]
    files.parquet(clean(got.frame, F.col("second"), ["pos_id"], order=order), w["silver"], ["date"])
    seen = [(p, True) for p in got.read] + [(p, False) for p in got.skipped]
    files.parquet(spark.createDataFrame(seen, "path string, read boolean").withColumn("run_id", F.lit(w["run_id"])), w["files"], ["run_id"])


def _accounts(rows: DataFrame, keys: list[str]) -> dict:
    """What became of the rows: silver_rows + copies + rejected_rows are all of them."""
    good = F.coalesce(passes(), F.lit(False))
    by_key = rows.groupBy(*keys, good.alias("good")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_key.agg(
        F.count_if("good").alias("silver_rows"), total(F.when(F.col("good"), F.col("n") - 1)).alias("copies"), total(F.when(~F.col("good"), F.col("n"))).alias("rejected_rows")
    ).first().asDict()


def _validate(spark: SparkSession, w: dict) -> None:
    """Judges the bronze rows as the clean stage sees them: in silver nothing is left to find. A row is in silver, in
    quarantine, or (of a duplicate group, whose rows are all in quarantine) in both."""
    seen = [tuple(r) for r in spark.read.parquet(w["files"]).where(F.col("run_id") == w["run_id"]).select("path", "read").collect()]
    again = _rows(spark, w, [p for p, read in seen if read])  # files that came since belong to the next run
    if again.skipped:
        raise OSError(f"read by the clean stage, unreadable now: {', '.join(again.skipped)}")
    rows, skipped = again.frame, sum(not read for _, read in seen)
    keys, cols = ["icao24", "second"], ["latitude", "longitude", "second"]
    status, row = quality.judge(rows, ["icao24", "latitude", "longitude", "second"], keys=keys, columns=cols)
    row |= _accounts(rows, keys) | {"status": status.name, "files_read": len(again.read), "files_skipped": skipped}
    if skipped:
        row["messages"] = " | ".join(filter(None, [row["messages"], f"{skipped} unreadable files skipped"]))
        row["status"] = quality.Status.WARNING.name
    for name, bad in quality.quarantine(rows, w["run_id"], keys, cols).items():
        if not bad.isEmpty():
            bad.write.mode("overwrite").parquet(f"{w['quarantine']}/{name}/run_id={w['run_id']}")
    # under the run, so a stage that is tried again replaces what it wrote
    files.parquet(spark.createDataFrame([row]).withColumn("run_id", F.lit(w["run_id"])), w["metrics"], ["run_id"])
    files.latest_json({"run_id": w["run_id"], **row}, f"{w['metrics']}_latest.json", spark)
    if not row["silver_rows"]:
        raise quality.QualityError("no row passed")
    quality.require_columns(spark.read.parquet(w["silver"]), SILVER)


def _gold(spark: SparkSession, w: dict) -> None:
    silver = spark.read.parquet(w["silver"])
    for name, df in aggregates.gold_daily(silver).items():
        files.parquet(df, f"{w['gold']}/{name}", ["date"])
    silver.createOrReplaceTempView("aircraft_cleaned")
    for name, df in aggregates.gold_sql(spark).items():
        files.result(df, f"{w['gold']}/sql", name)


def _features(spark: SparkSession, w: dict) -> None:
    files.parquet(motion.features(spark.read.parquet(w["silver"])), w["features"], ["flight_date"])


def _train(spark: SparkSession, w: dict) -> None:
    model, _ = risk_model.train(spark.read.parquet(w["features"]), F.col("second"))
    risk_model.save(model, w["model"])


def _score(spark: SparkSession, w: dict) -> None:
    files.parquet(risk_model.score(spark.read.parquet(w["features"]), risk_model.load(w["model"])), w["scores"])


DAILY = [
    Stage("clean", _clean, ["bronze"], ["silver", "files"]),
    Stage("validate", _validate, ["bronze", "files", "silver"], ["metrics"]),
    Stage("gold", _gold, ["silver"], ["gold"]),
    Stage("features", _features, ["silver"], ["features"]),
    Stage("train", _train, ["features"], ["model"]),
    Stage("score", _score, ["features", "model"], ["scores"]),
]


def folders(root: str, bronze: str, run_id: str) -> dict[str, str]:
    names = ("silver", "files", "metrics", "quarantine", "gold", "features", "model", "scores")
    return {"bronze": bronze, "run_id": run_id, **{n: f"{root}/{n}" for n in names}}


