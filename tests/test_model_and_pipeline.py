import json

import pytest
from aerolith.ml import risk_model
from aerolith.operators.quality import QualityError
from aerolith.plans import pipeline
from aerolith.sinks import files
from pyspark.sql import functions as F


def labelled(spark, n=600):
    df = spark.range(n).select(F.col("id").alias("second"), (F.col("id") % 7).alias("delta_t"), ((F.col("id") * 37 % 100) / 100.0).alias("movement_score"))
    return df.withColumn("risk_label", (F.col("movement_score") >= 0.7).cast("int"))


def test_train_save_load_score(spark, tmp_path):
    df = labelled(spark)
    model, auc = risk_model.train(df, F.col("second"))
    assert auc > 0.99 and risk_model.weights_of(model)[0][1] > 0
    risk_model.save(model, f"{tmp_path}/m")
    back = risk_model.load(f"{tmp_path}/m")
    a = {r.second: r for r in risk_model.score(df, back).collect()}
    b = {r.second: r for r in risk_model.score_native(df, *risk_model.weights_of(back)).collect()}
    assert all(a[k].risk_probability == pytest.approx(b[k].risk_probability, abs=1e-12) and a[k].predicted_risk == b[k].predicted_risk for k in a)
    with pytest.raises(QualityError):
        risk_model.train(df.where("risk_label = 0"), F.col("second"))
    with pytest.raises(QualityError):
        risk_model.score(df.drop("delta_t"), back)
    train, test = risk_model.split(df, F.col("second"))
    assert train.count() + test.count() == 600 and train.join(test, "second").count() == 0
    assert [x.count() for x in risk_model.split(df, order=["second"])] == [x.count() for x in risk_model.split(df.repartition(3), order=["second"])]


def test_daily_run_twice(spark, data, tmp_path):
    where = pipeline.folders(str(tmp_path), f"{data}/bronze_positions.parquet", "20240101T000000Z")
    done = pipeline.run(spark, pipeline.DAILY, where, wait_s=0)
    assert [d.name for d in done] == ["clean", "validate", "gold", "features", "train", "score"]
    n = spark.read.parquet(where["silver"]).count()
    pipeline.run(spark, pipeline.DAILY[:1], where, wait_s=0)
    assert spark.read.parquet(where["silver"]).count() == n
    assert spark.read.parquet(where["gold"] + "/rows_per_day").agg(F.sum("total_flights")).first()[0] == n
    assert spark.read.option("header", True).csv(where["gold"] + "/sql/top_aircraft_csv").count() > 0
    with pytest.raises(QualityError):
        pipeline.run(spark, pipeline.DAILY[:1], {**where, "bronze": f"{tmp_path}/nothing"})


def test_every_bronze_row_is_kept_or_quarantined(spark, data, tmp_path):
    where = pipeline.folders(str(tmp_path), f"{data}/bronze_positions.parquet", "r1")
    pipeline.run(spark, pipeline.DAILY[:2], where, wait_s=0)
    ids = lambda df: {r[0] for r in df.select("pos_id").collect()}
    bronze, silver = spark.read.parquet(where["bronze"]), ids(spark.read.parquet(where["silver"]))
    held = {n: ids(spark.read.parquet(f"{where['quarantine']}/{n}")) for n in ("nulls", "range", "duplicates")}
    assert ids(bronze) == silver.union(*held.values())
    assert held["nulls"] == ids(bronze.where("timestamp IS NULL OR latitude IS NULL OR longitude IS NULL")) and held["nulls"]
    assert held["range"] == ids(bronze.where("abs(latitude) > 90 OR abs(longitude) > 180")) and held["range"]
    assert not silver & (held["nulls"] | held["range"])
    m = spark.read.parquet(where["metrics"]).first()
    assert (m.total_rows, m.null_count, m.range_count) == (bronze.count(), len(held["nulls"]), len(held["range"]))
    assert m.silver_rows == len(silver) and m.rejected_rows == len(held["nulls"] | held["range"]) and m.copies > 0
    assert m.total_rows == m.silver_rows + m.copies + m.rejected_rows


def test_daily_run_on_drifted_files(spark, data, tmp_path):
    whole = spark.read.parquet(f"{data}/bronze_positions.parquet")
    part = lambda i: whole.where(F.pmod("pos_id", F.lit(3)) == i).coalesce(1)
    part(0).write.parquet(f"{tmp_path}/b/0")
    part(1).withColumnsRenamed({"latitude": "lat", "longitude": "lon"}).write.parquet(f"{tmp_path}/b/1")
    part(2).withColumn("timestamp", F.unix_seconds("timestamp")).write.parquet(f"{tmp_path}/b/2")
    (tmp_path / "b" / "broken.parquet").write_bytes(b"PAR1 no")
    where = pipeline.folders(f"{tmp_path}/o", f"{tmp_path}/b", "r1")
    pipeline.run(spark, pipeline.DAILY, where, wait_s=0)
    want = pipeline.clean(whole, F.unix_seconds("timestamp"), ["pos_id"])
    got = spark.read.parquet(where["silver"]).select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    m = spark.read.parquet(where["metrics"]).first()
    assert (m.files_read, m.files_skipped, m.status) == (3, 1, "WARNING") and "1 unreadable files skipped" in m.messages
    assert m.total_rows == whole.count() == m.silver_rows + m.copies + m.rejected_rows
    assert [r.path.rpartition("/")[2] for r in spark.read.parquet(where["files"]).where("NOT read").collect()] == ["broken.parquet"]


def test_a_stage_is_tried_again(spark):
    tries = []

    def flaky(s, w):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError

    assert pipeline.run(spark, [pipeline.Stage("x", flaky)], {}, wait_s=0)[0].attempts == 2


def test_latest_json(tmp_path):
    files.latest_json({"a": 1}, f"{tmp_path}/m.json")
    files.latest_json({"a": 2}, f"{tmp_path}/m.json")
    assert json.load(open(f"{tmp_path}/m.json")) == {"a": 2}
