"""Queries of the telemetry operators over whole tables, and their SQL. Derived doubles are rounded here only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import entity_key, identity
from ..functions.instants import day_range, event_second, local_text, run_stamp
from ..functions.risk import normalise_risk, risk_colour
from ..ml import risk_model
from ..operators import aggregates, motion, quality, report
from ..operators.clean import clean, in_bounds, one_per_key, union_drifted
from ..operators.exactly_once import instant_seconds
from ..session import materialise, shared
from ..sinks import files
from ..sources import parquet, wire
from ..streaming import flows
from . import pipeline
from .records import KEY_SQL
from .tables import table


def r6(c: str):
    return F.round(c, 6).alias(c)


def r12(c: str):
    """For means of values with six digits, where a tie at the sixth is common."""
    return F.round(c, 12).alias(c)


def silver(spark: SparkSession, d: str) -> DataFrame:
    return clean(table(spark, d, "bronze_positions"), F.unix_seconds("timestamp"), ["pos_id"])


# --- identity, time, cleaning


def identity_rules(spark, d):
    rules = [identity(r).alias(r) for r in ("canonical", "bronze", "silver", "stream", "producer")]
    return table(spark, d, "bronze_positions").select("pos_id", *rules)


def event_times(spark, d):
    t, now = table(spark, d, "aircraft_positions"), F.lit(1_700_000_000)
    return t.select("log_seq", event_second("bronze", "timestamp", "kafka_ts", now).alias("bronze"), event_second("stream_score", "timestamp", "kafka_ts").alias("stream_score"))


def event_times_from_text(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    second = F.unix_timestamp("ts")
    raw = F.when(i % 37 == 0, "bad").when(i % 31 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(second.cast("string"))
    e = e.select("event_id", raw.alias("raw"))
    return e.select("event_id", event_second("silver", "raw").alias("second"), event_second("silver", "raw", now=F.lit(1_700_000_000)).alias("second_or_now"))


def silver_clean(spark, d):
    return silver(spark, d)


def silver_clean_injected_now(spark, d):
    now = F.lit(1_700_000_000)
    return clean(table(spark, d, "bronze_positions"), F.unix_seconds("timestamp"), ["pos_id"], rule="silver", now=now)


def dedupe_first(spark, d):
    t = in_bounds(table(spark, d, "bronze_positions"))
    return one_per_key(t.select("pos_id", "icao24", F.unix_micros("timestamp").alias("us")), ["icao24", "us"], ["pos_id"])


def union_by_name_drift(spark, d):
    t = table(spark, d, "bronze_positions").select("pos_id", "icao24", "latitude", "longitude", "reg")
    old = t.where("pos_id % 2 = 0").select("pos_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return union_drifted([old, t.where("pos_id % 2 = 1")])


# --- gold


def rows_per_day(spark, d):
    return aggregates.rows_per_day(silver(spark, d))


def entities_per_day(spark, d):
    return aggregates.entities_per_day(silver(spark, d))


def rows_per_hour(spark, d):
    return aggregates.rows_per_hour(silver(spark, d))


def top_entities(spark, d):
    return aggregates.top_entities(silver(spark, d))


def busiest_grid(spark, d):
    return aggregates.busiest_cells(silver(spark, d))


def speed_stats(spark, d):
    return aggregates.speed_stats(silver(spark, d)).select("icao24", "intervals", F.round("avg_speed_kts", 4).alias("avg_speed_kts"), F.round("median_speed_kts", 4).alias("median_speed_kts"))


def gold_sql_hours(spark, d):
    silver(spark, d).createOrReplaceTempView("aircraft_cleaned")
    return aggregates.gold_sql(spark)["flights_per_hour"]


def orders_per_day(spark, d):
    day = F.col("o_orderdate").cast("date").alias("date")
    return aggregates.rows_per_day(table(spark, d, "orders").select(day), "orders")


def customers_per_day(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_custkey")
    return aggregates.entities_per_day(t, "o_custkey")


def top_parts(spark, d):
    return aggregates.top_entities(table(spark, d, "lineitem"), 100, "l_partkey")


# --- quality


def dq_metrics(spark, d):
    return quality.metrics(table(spark, d, "bronze_positions"))


def dq_nulls(spark, d):
    return table(spark, d, "bronze_positions").where(quality.is_null(["latitude", "longitude", "timestamp"])).select("pos_id")


def dq_range(spark, d):
    return table(spark, d, "bronze_positions").where(quality.out_of_range()).select("pos_id")


def dq_duplicates(spark, d):
    t = table(spark, d, "bronze_positions").select("pos_id", "icao24", "timestamp")
    return quality.duplicate_rows(t, ["icao24", "timestamp"], null_keys=False).select("pos_id")


def dq_duplicates_window(spark, d):
    t = table(spark, d, "bronze_positions").select("pos_id", "icao24", "timestamp")
    return quality.duplicate_rows(t, ["icao24", "timestamp"]).select("pos_id")


def dq_duplicate_groups(spark, d):
    t = table(spark, d, "bronze_positions").select("icao24", F.unix_micros("timestamp").alias("us"))
    return quality.duplicate_groups(t, ["icao24", "us"])


def dq_quarantine(spark, d):
    parts = quality.quarantine(table(spark, d, "bronze_positions").select("pos_id", "icao24", "latitude", "longitude", "timestamp"), "20240101T000000Z")
    return union_drifted([p.select("pos_id", "run_id", F.lit(n).alias("rule")) for n, p in parts.items()])


# --- motion


def _motion(movement, rule="fast", first=False):
    def q(spark, d):
        f = motion.features(silver(spark, d), movement, rule, first)
        return f.select("icao24", "second", "flight_date", "delta_t", r6("movement_score"), "risk_label")

    return q


def _scores(spark, d):
    return risk_model.score_native(motion.features(silver(spark, d)), (0.0, 4.0), -2.8)


def score_native(spark, d):
    return _scores(spark, d).select("icao24", "second", r6("risk_probability"), "predicted_risk")


def hash_split(spark, d):
    return motion.key_split(motion.features(silver(spark, d)), F.col("second")).select("icao24", "second", "is_test")


def train_and_score(spark, d):
    f = materialise(motion.features(silver(spark, d)))  # read by every pass of the fit, the test and the scores
    model, auc = risk_model.train(f, F.col("second"))
    out = risk_model.score(f, model)
    return out.groupBy("risk_label", "predicted_risk").agg(F.count(F.lit(1)).alias("rows")).withColumn("auc", F.lit(auc))


# --- report


def _prepared(spark, d):
    return report.prepare(table(spark, d, "stream_scores"))


def flight_stats(spark, d):
    return report.drawn(report.flight_stats(_prepared(spark, d))).select("flight_id", "points", "first_s", "last_s", r12("avg_risk"), r12("max_risk"), "colour", r12("weight"))


def key_figures(spark, d):
    return report.key_figures(_prepared(spark, d)).select("flights", "points", r12("avg_risk"), r12("max_risk"))


def top_flights(spark, d):
    return report.top_flights(report.flight_stats(_prepared(spark, d))).select("flight_id", "points", r12("avg_risk"), r12("max_risk"))


def report_dropped(spark, d):
    return report.dropped(table(spark, d, "stream_scores"))


def selected_track(spark, d):
    return report.selected(_prepared(spark, d), ["561230", "47CDF8"]).select("flight_id", "second", "lat", "lon")


def run_stamps(spark, d):
    return table(spark, d, "stream_scores").select("score_id", run_stamp("evt_ts").alias("stamp"))


def median_centre(spark, d):
    return report.centre(_prepared(spark, d)).select(r6("lat"), r6("lon"))


def track_thinned(spark, d):
    t = table(spark, d, "stream_scores").select("score_id", F.col("icao24").alias("flight_id"), F.col("evt_ts").alias("second"))
    return report.tracks(t, most=50, order=["second", "score_id"]).select("flight_id", "score_id", "point")


def track_ends(spark, d):
    t = _prepared(spark, d).where("flight_id IS NOT NULL")
    return report.ends(t)


def normalised_risk(spark, d):
    return normalise_risk(table(spark, d, "events"), "value").select("event_id", F.round("risk", 9).alias("risk"))


def risk_colours(spark, d):
    r = normalise_risk(table(spark, d, "stream_scores"), "risk_probability")
    return r.select("score_id", risk_colour(F.col("risk")).alias("colour"))


def local_time_range(spark, d):
    first, last = day_range("yesterday", 1_672_900_000)
    t = report.in_range(table(spark, d, "stream_scores").withColumnRenamed("evt_ts", "second"), first, last)
    return t.select("score_id", local_text("second").alias("local"))


# --- wire format


def wire_normalised(spark, d):
    t = table(spark, d, "raw_records").withColumn("n", F.lit(1))
    out = wire.normalised(t, "payload", F.lit(1_700_000_000))
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("records"))


def wire_bronze(spark, d):
    raw = table(spark, d, "raw_records").select(F.col("payload").alias("value"), F.col("landed_at").alias("timestamp"))
    out = wire.bronze(raw)
    return out.groupBy("icao24", "date").agg(F.count(F.lit(1)).alias("rows"))


def wire_dead_letters(spark, d):
    return wire.dead_letters(table(spark, d, "raw_records"), "payload").select("rec_id")


def json_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


def json_emit(spark, d):
    from ..sources.kafka import messages

    return messages(table(spark, d, "region"), "r_regionkey")


# --- streams, over what is there


def _stream(spark, d, name):
    t = table(spark, d, name)
    return spark.readStream.schema(t.schema).parquet(f"{d}/{name}.parquet*")


def _place(spark, name):
    return shared(spark, name)


def stream_dedupe(spark, d):
    s = _stream(spark, d, "aircraft_positions").select("icao24", F.timestamp_seconds(instant_seconds("timestamp")).alias("timestamp"))
    at = _place(spark, "dedupe")
    rows = flows.deduplicated(s.where("icao24 IS NOT NULL AND timestamp IS NOT NULL"), ["icao24", "timestamp"])
    rows = rows.select("icao24", F.unix_seconds("timestamp").alias("second"))
    flows.to_parquet(rows, f"{at}/out", f"{at}/checkpoint", every=None).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def stream_score(spark, d):
    s = _stream(spark, d, "aircraft_positions").select(
        entity_key("icao24").alias("icao24"), instant_seconds("timestamp").alias("evt_ts"), F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"), F.col("log_seq").alias("tie"),
    )
    at = _place(spark, "score")
    flows.score_stream(in_bounds(s), f"{at}/out", f"{at}/checkpoint", every=None).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.select("icao24", "evt_ts", "delta_t", r6("movement_score"), r6("risk_probability"), "predicted_risk")


def stream_late(spark, d):
    """Batches of a stream in order of time, then one with rows a day late: they are behind the watermark and go."""
    t, at = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), _place(spark, "late")
    day = F.dayofmonth("ts")
    late = t.where(day <= 2).withColumn("user_id", F.col("user_id") + 1_000_000)
    for part in (t.where(day <= 10), t.where(day.between(11, 20)), t.where(day.between(21, 25)), t.where(day.between(26, 28)), late.unionByName(t.where(day > 28)), t.where(day <= 1)):
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
    s = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    rows = flows.deduplicated(s, ["user_id", "ts"], "ts").select("user_id", F.unix_micros("ts").alias("us"))
    flows.to_parquet(rows, f"{at}/out", f"{at}/checkpoint", every=None).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def stream_two_sinks(spark, d):
    """What the second sink of the scorer got: the same rows as JSON messages."""
    s = _stream(spark, d, "aircraft_positions").select(
        entity_key("icao24").alias("icao24"), instant_seconds("timestamp").alias("evt_ts"), F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"), F.col("log_seq").alias("tie"),
    )
    at = _place(spark, "two")
    flows.score_stream(in_bounds(s), f"{at}/out", f"{at}/checkpoint", lambda m: m.write.mode("append").parquet(f"{at}/topic"), every=None).start().awaitTermination()
    got = spark.read.parquet(f"{at}/topic").select(F.from_json("value", "icao24 string, evt_ts bigint, predicted_risk int").alias("m")).select("m.*")
    return got.groupBy("icao24").agg(F.count(F.lit(1)).alias("messages"), F.sum("evt_ts").alias("seconds"), F.sum("predicted_risk").alias("risky"))


# --- the chain: topic, bronze stream, files, daily run


def _chain(spark, d, stages):
    """Messages of the topic as JSON through the bronze stream into files, which the stages of the daily run read."""
    at = _place(spark, "chain")
    fields = ["icao24", "lat", "lon", "flight", "reg", instant_seconds("timestamp").alias("timestamp")]
    s = _stream(spark, d, "aircraft_positions").select(F.to_json(F.struct(*fields)).alias("value"), F.col("kafka_ts").alias("timestamp"))
    flows.to_parquet(wire.bronze(s), f"{at}/bronze", f"{at}/checkpoint", ["date"], every=None).start().awaitTermination()
    where = pipeline.folders(at, f"{at}/bronze", "20240101T000000Z")
    pipeline.run(spark, [x for x in pipeline.DAILY if x.name in stages], where, wait_s=0)
    return where


def chain_silver(spark, d):
    return spark.read.parquet(_chain(spark, d, ["clean"])["silver"]).drop("pos_id")


def chain_accounts(spark, d):
    """What became of every row: kept, copies and rejected are all of them; and what lies in quarantine."""
    w = _chain(spark, d, ["clean", "validate"])
    m = spark.read.parquet(w["metrics"])
    names = ["total_rows", "null_count", "range_count", "silver_rows", "copies", "rejected_rows", "files_skipped"]
    rows = m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("bigint").alias("rows")) for n in names])).alias("x")).select("x.*")
    for rule in ("nulls", "range", "duplicates"):
        part = spark.read.parquet(f"{w['quarantine']}/{rule}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f"quarantine_{rule}").alias("name"), "rows")
        rows = rows.unionByName(part)
    latest = spark.read.option("multiLine", True).json(f"{w['metrics']}_latest.json").select(F.lit("latest_total").alias("name"), F.col("total_rows").alias("rows"))
    return rows.unionByName(latest)


def _daily(spark, d, stages):
    w = pipeline.folders(_place(spark, "daily"), f"{d}/bronze_positions.parquet", "20240101T000000Z")
    pipeline.run(spark, [x for x in pipeline.DAILY if x.name in stages], w, wait_s=0)
    return w


def daily_gold(spark, d):
    """The gold Parquet by day, and one of the CSV previews beside it, read back."""
    w = _daily(spark, d, ["clean", "gold"])
    top = spark.read.option("header", True).schema("icao24 string, sightings bigint").csv(f"{w['gold']}/sql/top_aircraft_csv")
    return spark.read.parquet(f"{w['gold']}/rows_per_day").select(F.col("date").cast("string").alias("what"), F.col("total_flights").alias("n")).unionByName(
        top.select(F.col("icao24").alias("what"), F.col("sightings").alias("n"))
    )


def daily_scores(spark, d):
    """Batch scores of the saved and loaded model against the same weights as an expression: rows, and rows that agree."""
    w = _daily(spark, d, ["clean", "features", "train", "score"])
    scores, model = spark.read.parquet(w["scores"]), risk_model.load(w["model"])
    native = risk_model.score_native(spark.read.parquet(w["features"]), *risk_model.weights_of(model))
    keys = ["icao24", "second"]
    both = scores.select(*keys, F.col("risk_probability").alias("p"), F.col("predicted_risk").alias("r")).join(native, keys)
    same = (F.abs(F.col("p") - F.col("risk_probability")) < 1e-9) & ((F.col("r") == F.col("predicted_risk")) | (F.abs(F.col("p") - 0.5) < 1e-9))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("agree"))


def auc(spark, d):
    f = motion.features(silver(spark, d), "l1_degrees")
    return spark.createDataFrame([(round(risk_model.auc(f, "delta_t", "risk_label"), 9),)], "auc double")


# --- files


def _drifted(spark, d):
    """The bronze positions as four groups of files of different schemas, and one that can't be read."""
    at, t = _place(spark, "drifted"), table(spark, d, "bronze_positions")
    part = lambda i: t.where(F.pmod("pos_id", F.lit(4)) == i)
    part(0).write.parquet(f"{at}/a")
    part(1).withColumnsRenamed({"latitude": "lat", "longitude": "lon"}).write.parquet(f"{at}/b")
    part(2).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).drop("flight").write.parquet(f"{at}/c")
    part(3).withColumn("timestamp", F.unix_seconds("timestamp")).drop("reg").write.parquet(f"{at}/d")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/e/broken.parquet")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(b"PAR1 no"))
    out.close()
    return at


def source_by_schema(spark, d):
    got = parquet.by_schema(spark, _drifted(spark, d), {"pos_id": "bigint"})
    return got.frame.select("pos_id", "icao24", "latitude", "longitude", "flight", "reg", "second", F.lit(len(got.skipped)).alias("skipped"))


def source_with_columns(spark, d):
    """Only the files that have both columns; the others and the unreadable one are skipped."""
    at = _drifted(spark, d)
    got = parquet.with_columns(spark, at, ["pos_id", "latitude", "flight"])
    folders = {p.rsplit("/", 2)[-2] for p in parquet.listed(spark, at)}
    return got.frame.withColumns({"skipped": F.lit(len({p.rsplit("/", 2)[-2] for p in got.skipped})), "folders": F.lit(len(folders))})


def source_bulk(spark, d):
    """One scan over files of two schemas that fit each other."""
    at, t = _place(spark, "bulk"), table(spark, d, "bronze_positions").select("pos_id", "icao24", "latitude", "reg")
    t.where("pos_id % 2 = 0").drop("reg").write.parquet(f"{at}/part=0")
    t.where("pos_id % 2 = 1").drop("latitude").write.parquet(f"{at}/part=1")
    return parquet.bulk(spark, at).select("pos_id", "icao24", "latitude", "reg", F.col("part").cast("int").alias("part"))


def sink_flights_csv(spark, d):
    """The flight list as a CSV file, read back."""
    at = _place(spark, "flights")
    files.one_csv(report.exported(report.flight_stats(_prepared(spark, d)).select("flight_id", "points", "first_s", "last_s")), at)
    # an empty text is written in quotes, a null without: another mark for null keeps them apart
    return spark.read.option("header", True).option("nullValue", "\\N").schema("flight_id string, points bigint, first string, last string").csv(at)


def sink_track_csv(spark, d):
    """One track as a CSV file, read back."""
    at = _place(spark, "track")
    files.one_csv(report.exported(report.selected(_prepared(spark, d), ["561230"]).select("second", "lat", "lon")), at)
    return spark.read.option("header", True).schema("second string, lat double, lon double").csv(at)


def _gold(name, *columns):
    def q(spark, d):
        silver(spark, d).createOrReplaceTempView("aircraft_cleaned")
        out = aggregates.gold_sql(spark)[name]
        return out.selectExpr(*columns) if columns else out

    return q


QUERIES = {
    "stream_late": stream_late, "stream_two_sinks": stream_two_sinks, "chain_silver": chain_silver, "chain_accounts": chain_accounts,
    "daily_gold": daily_gold, "daily_scores": daily_scores, "auc": auc, "source_by_schema": source_by_schema,
    "source_with_columns": source_with_columns, "source_bulk": source_bulk, "sink_flights_csv": sink_flights_csv, "sink_track_csv": sink_track_csv,
    "gold_sql_days": _gold("flights_per_day"), "gold_sql_unique": _gold("unique_aircraft_per_day"), "gold_sql_top": _gold("top_aircraft"),
    "gold_sql_cells": _gold("busiest_cells"),
    "gold_sql_speeds": _gold("speed_stats", "icao24", "intervals", "round(avg_speed_kts, 4) AS avg_speed_kts", "round(median_speed_kts, 4) AS median_speed_kts"),
    "identity_rules": identity_rules, "event_times": event_times, "event_times_from_text": event_times_from_text,
    "silver_clean": silver_clean, "silver_clean_injected_now": silver_clean_injected_now, "dedupe_first": dedupe_first,
    "union_by_name_drift": union_by_name_drift,
    "rows_per_day": rows_per_day, "entities_per_day": entities_per_day, "rows_per_hour": rows_per_hour, "top_entities": top_entities,
    "busiest_grid": busiest_grid, "speed_stats": speed_stats, "gold_sql_hours": gold_sql_hours,
    "orders_per_day": orders_per_day, "customers_per_day": customers_per_day, "top_parts": top_parts,
    "dq_metrics": dq_metrics, "dq_nulls": dq_nulls, "dq_range": dq_range, "dq_duplicates": dq_duplicates,
    "dq_duplicates_window": dq_duplicates_window, "dq_duplicate_groups": dq_duplicate_groups, "dq_quarantine": dq_quarantine,
    "movement_l1": _motion("l1_degrees"), "movement_km_per_s": _motion("km_per_s"), "movement_ma3": _motion("km_per_s_ma3"),
    "movement_with_first": _motion("km_per_s", first=True), "label_gap_or_still": _motion("l1_degrees", "gap_or_still"),
    "score_native": score_native, "hash_split": hash_split, "train_and_score": train_and_score,
    "flight_stats": flight_stats, "key_figures": key_figures, "top_flights": top_flights, "median_centre": median_centre,
    "report_dropped": report_dropped, "selected_track": selected_track, "run_stamps": run_stamps,
    "track_thinned": track_thinned, "track_ends": track_ends, "normalised_risk": normalised_risk, "risk_colours": risk_colours,
    "local_time_range": local_time_range,
    "wire_normalised": wire_normalised, "wire_bronze": wire_bronze, "wire_dead_letters": wire_dead_letters,
    "json_parse": json_parse, "json_emit": json_emit, "stream_dedupe": stream_dedupe, "stream_score": stream_score,
}


# --- SQL


def _strip(c):
    return rf"nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')"


_CANON = f"lower(coalesce({_strip('icao24')}, {_strip('flight')}, {_strip('reg')}, 'unknown'))"
_SILVER_RULE = "lower(coalesce(trim(icao24), trim(flight), trim(reg), 'unknown'))"
_DAY = "(DATE '1970-01-01' + CAST(floor(second / 86400.0) AS INTEGER))"
_BOUNDS = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"
_SEC = 'CAST(floor(epoch_us("timestamp") / 1000000.0) AS BIGINT)'


def _silver_sql(rule=_CANON, second=_SEC, more=""):
    return f"""
        raw AS (SELECT pos_id, {rule} AS icao24, latitude, longitude, flight, reg, {second} AS second FROM bronze_positions WHERE {_BOUNDS}),
        silver AS (SELECT icao24, latitude, longitude, flight, reg, second, {_DAY} AS date, pos_id FROM raw WHERE second IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY icao24, second ORDER BY pos_id) = 1){more}"""


def _km(a, o, b, p):
    return f"(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({p} - {o}) / 2), 2)))))"


def _motion_sql(source="silver", key="icao24", t="second"):
    return f"""
        lagged AS (SELECT *, lag(latitude) OVER w AS a, lag(longitude) OVER w AS o, lag({t}) OVER w AS s FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY {t})),
        moved AS (SELECT *, {t} - s AS delta_t, abs(latitude - a) + abs(longitude - o) AS l1,
            CASE WHEN s IS NULL OR {t} - s <= 0 THEN 0.0 ELSE {_km('a', 'o', 'latitude', 'longitude')} / greatest(1, {t} - s) END AS v FROM lagged),
        smooth AS (SELECT *, avg(v) OVER (PARTITION BY {key} ORDER BY {t} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ma3 FROM moved)"""


def _motion_query(score, hit, first=False):
    where = "" if first else "WHERE delta_t IS NOT NULL"
    return f"""WITH {_silver_sql()}, {_motion_sql()}
        SELECT icao24, second, date AS flight_date, delta_t, round({score}, 6) AS movement_score, CASE WHEN {hit} THEN 1 ELSE 0 END AS risk_label FROM smooth {where}"""


_PREPARED = """prep AS (
        SELECT icao24 AS flight_id, evt_ts AS second, latitude AS lat, longitude AS lon,
               greatest(0.0, least(1.0, CASE WHEN risk_probability IS NULL OR isnan(risk_probability) THEN 0 ELSE risk_probability END
                   / (SELECT CASE WHEN quantile_cont(risk_probability, 0.99) > 1 THEN 100.0 ELSE 1.0 END FROM stream_scores))) AS risk
        FROM stream_scores WHERE evt_ts IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL)"""

_COLOUR = "'#' || format('{{:02x}}{{:02x}}', CAST(trunc({r} * 255) AS INTEGER), CAST(trunc((1 - {r}) * 255) AS INTEGER)) || '00'"
_STATS = """stats AS (SELECT flight_id, count(second) AS points, min(second) AS first_s, max(second) AS last_s, avg(risk) AS avg_risk, max(risk) AS max_risk FROM prep GROUP BY flight_id)"""
_DUPES = 'SELECT icao24, "timestamp" FROM bronze_positions GROUP BY ALL HAVING count(*) > 1'
_NULLS = 'latitude IS NULL OR longitude IS NULL OR "timestamp" IS NULL'
_RANGE = "coalesce(latitude < -90 OR latitude > 90 OR longitude < -180 OR longitude > 180, false)"
_MS = 'CASE WHEN abs("timestamp") >= 100000000000 THEN CAST(floor("timestamp" / 1000.0) AS BIGINT) ELSE "timestamp" END'
_OBJ = "CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END"


def _pick(*names):
    return "coalesce(" + ", ".join(f"nullif(p->>'$.{n}', '')" for n in names) + ")"


_BRONZE = f"""bronze AS (SELECT coalesce(lower(nullif(icao24, '')), lower(nullif(flight, '')), lower(nullif(reg, '')), 'unknown') AS icao24, lat AS latitude,
            lon AS longitude, flight, reg, coalesce({_MS}, CAST(floor(epoch_us(kafka_ts) / 1000000.0) AS BIGINT)) AS second FROM aircraft_positions),
        norm AS (SELECT {_CANON} AS icao24, latitude, longitude, flight, reg, second,
            coalesce({_BOUNDS}, false) AND second IS NOT NULL AS good FROM bronze)"""
_SCORED = f"""src AS (SELECT {KEY_SQL} AS icao24, {_MS} AS second, lat AS latitude, lon AS longitude, log_seq FROM aircraft_positions
            WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND "timestamp" IS NOT NULL),
        one AS (SELECT * FROM src WHERE icao24 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY icao24, second ORDER BY log_seq) = 1), {_motion_sql('one')}"""
_ISO = "strftime(make_timestamp(({c} + 19800) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+05:30'"


ORACLES = {
    "stream_late": "SELECT user_id, epoch_us(ts) AS us FROM events",
    "stream_two_sinks": f"""WITH {_SCORED} SELECT icao24, count(*) AS messages, CAST(sum(second) AS BIGINT) AS seconds, CAST(sum(CAST(ma3 > 0.7 AS INTEGER)) AS BIGINT) AS risky
        FROM smooth WHERE delta_t IS NOT NULL GROUP BY icao24""",
    "chain_silver": f"""WITH {_BRONZE} SELECT icao24, latitude, longitude, flight, reg, second, {_DAY} AS date FROM norm WHERE good QUALIFY row_number() OVER
        (PARTITION BY icao24, second ORDER BY latitude, longitude, flight NULLS FIRST, reg NULLS FIRST) = 1""",
    "chain_accounts": f"""WITH {_BRONZE}, g AS (SELECT icao24, second, good, count(*) AS n FROM norm GROUP BY ALL),
        nulls AS (SELECT count(*) AS n FROM norm WHERE latitude IS NULL OR longitude IS NULL OR second IS NULL), ranges AS (SELECT count(*) AS n FROM norm WHERE {_RANGE}),
        dupes AS (SELECT count(*) AS n FROM (SELECT 1 FROM norm QUALIFY count(*) OVER (PARTITION BY icao24, second) > 1))
        SELECT 'total_rows' AS name, count(*) AS rows FROM norm UNION ALL SELECT 'latest_total', count(*) FROM norm
        UNION ALL SELECT 'null_count', n FROM nulls UNION ALL SELECT 'quarantine_nulls', n FROM nulls
        UNION ALL SELECT 'range_count', n FROM ranges UNION ALL SELECT 'quarantine_range', n FROM ranges
        UNION ALL SELECT 'quarantine_duplicates', n FROM dupes UNION ALL SELECT 'files_skipped', 0
        UNION ALL SELECT 'silver_rows', count(*) FILTER (good) FROM g UNION ALL SELECT 'copies', CAST(coalesce(sum(n - 1) FILTER (good), 0) AS BIGINT) FROM g
        UNION ALL SELECT 'rejected_rows', CAST(coalesce(sum(n) FILTER (NOT good), 0) AS BIGINT) FROM g""",
    "daily_gold": f"""WITH {_silver_sql()} SELECT CAST(date AS VARCHAR) AS what, count(*) AS n FROM silver GROUP BY date
        UNION ALL (SELECT icao24, count(*) AS n FROM silver GROUP BY icao24 ORDER BY n DESC, icao24 LIMIT 100)""",
    "daily_scores": f"WITH {_silver_sql()}, {_motion_sql()} SELECT count(*) AS rows, count(*) AS agree FROM smooth WHERE delta_t IS NOT NULL",
    "auc": f"""WITH {_silver_sql()}, {_motion_sql()}, f AS (SELECT delta_t, CAST(l1 >= 0.7 AS INTEGER) AS y FROM smooth WHERE delta_t IS NOT NULL),
        r AS (SELECT y, rank() OVER (ORDER BY delta_t) + (count(*) OVER (PARTITION BY delta_t) - 1) / 2.0 AS r FROM f)
        SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auc FROM r""",
    "source_by_schema": f"""SELECT pos_id, icao24, latitude, longitude, CASE WHEN pos_id % 4 <> 2 THEN flight END AS flight, CASE WHEN pos_id % 4 <> 3 THEN reg END AS reg,
        {_SEC} AS second, 1 AS skipped FROM bronze_positions""",
    "source_with_columns": "SELECT pos_id, latitude, flight, 3 AS skipped, 5 AS folders FROM bronze_positions WHERE pos_id % 4 IN (0, 3)",
    "source_bulk": """SELECT pos_id, icao24, CASE WHEN pos_id % 2 = 0 THEN latitude END AS latitude, CASE WHEN pos_id % 2 = 1 THEN reg END AS reg,
        CAST(pos_id % 2 AS INTEGER) AS part FROM bronze_positions""",
    "sink_flights_csv": f"""WITH {_PREPARED}, {_STATS} SELECT flight_id, points, {_ISO.format(c='first_s')} AS first, {_ISO.format(c='last_s')} AS last FROM stats""",
    "sink_track_csv": f"WITH {_PREPARED} SELECT {_ISO.format(c='second')} AS second, lat, lon FROM prep WHERE flight_id = '561230'",
    "gold_sql_days": f"WITH {_silver_sql()} SELECT date, count(*) AS total_flights FROM silver GROUP BY date",
    "gold_sql_unique": f"WITH {_silver_sql()} SELECT date, count(DISTINCT icao24) AS unique_aircraft FROM silver GROUP BY date",
    "gold_sql_top": f"WITH {_silver_sql()} SELECT icao24, count(*) AS sightings FROM silver GROUP BY icao24 ORDER BY sightings DESC, icao24 LIMIT 100",
    "gold_sql_cells": f"""WITH {_silver_sql()} SELECT floor(latitude * 10) / 10 AS lat_cell, floor(longitude * 10) / 10 AS lon_cell, count(*) AS records
        FROM silver GROUP BY ALL""",
    "gold_sql_speeds": f"""WITH {_silver_sql()}, {_motion_sql()}, k AS (SELECT icao24, {_km('a', 'o', 'latitude', 'longitude')} / 1.852 / (delta_t / 3600.0) AS kts FROM smooth WHERE delta_t > 0)
        SELECT icao24, count(*) AS intervals, round(avg(kts), 4) AS avg_speed_kts, round(quantile_disc(kts, 0.5), 4) AS median_speed_kts FROM k GROUP BY icao24""",
    "wire_bronze": r"""WITH r AS (SELECT CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END AS p, landed_at FROM raw_records),
        b AS (SELECT coalesce(lower(nullif(p->>'$.icao24', '')), lower(nullif(p->>'$.flight', '')), lower(nullif(p->>'$.reg', '')), 'unknown') AS icao24,
            coalesce(CASE WHEN regexp_full_match(p->>'$.timestamp', '-?\d+') AND json_type(p, '$.timestamp') IN ('UBIGINT', 'BIGINT') THEN CAST(p->>'$.timestamp' AS BIGINT) END,
                CAST(floor(epoch_us(landed_at) / 1000000.0) AS BIGINT)) AS second FROM r)
        SELECT icao24, (DATE '1970-01-01' + CAST(floor(second / 86400.0) AS INTEGER)) AS date, count(*) AS rows FROM b GROUP BY ALL""",
    "identity_rules": f"""SELECT pos_id, {_CANON} AS canonical,
        coalesce(lower(nullif(icao24, '')), lower(nullif(flight, '')), lower(nullif(reg, '')), 'unknown') AS bronze,
        {_SILVER_RULE} AS silver, lower(coalesce(trim(icao24), '')) AS stream, {KEY_SQL} AS producer FROM bronze_positions""",
    "event_times": """SELECT log_seq, coalesce("timestamp", CAST(floor(epoch_us(kafka_ts) / 1000000.0) AS BIGINT), 1700000000) AS bronze,
        coalesce("timestamp", CAST(floor(epoch_us(kafka_ts) / 1000000.0) AS BIGINT)) AS stream_score FROM aircraft_positions""",
    "event_times_from_text": """SELECT event_id, CASE WHEN event_id % 37 = 0 THEN NULL ELSE CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) END AS second,
        CASE WHEN event_id % 37 = 0 THEN 1700000000 ELSE CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) END AS second_or_now FROM events""",
    "silver_clean": f"WITH {_silver_sql()} SELECT * FROM silver",
    "silver_clean_injected_now": f"WITH {_silver_sql(_SILVER_RULE, f'coalesce({_SEC}, 1700000000)')} SELECT * FROM silver",
    "dedupe_first": f"""SELECT pos_id, icao24, epoch_us("timestamp") AS us FROM bronze_positions WHERE {_BOUNDS}
        QUALIFY row_number() OVER (PARTITION BY icao24, "timestamp" ORDER BY pos_id) = 1""",
    "union_by_name_drift": """SELECT pos_id, CASE WHEN pos_id % 2 = 1 THEN icao24 END AS icao24, latitude, longitude,
        CASE WHEN pos_id % 2 = 1 THEN reg END AS reg FROM bronze_positions""",
    "rows_per_day": f"WITH {_silver_sql()} SELECT date, count(*) AS total_flights FROM silver GROUP BY date",
    "entities_per_day": f"WITH {_silver_sql()} SELECT date, count(DISTINCT icao24) AS unique_aircraft FROM silver GROUP BY date",
    "rows_per_hour": f"WITH {_silver_sql()} SELECT date, CAST((second // 3600) % 24 AS INTEGER) AS hour, count(*) AS flights FROM silver GROUP BY ALL",
    "gold_sql_hours": f"WITH {_silver_sql()} SELECT date, CAST((second // 3600) % 24 AS INTEGER) AS hour, count(*) AS total_flights FROM silver GROUP BY ALL",
    "top_entities": f"WITH {_silver_sql()} SELECT icao24, count(*) AS sightings FROM silver GROUP BY icao24 ORDER BY sightings DESC, icao24 LIMIT 100",
    "busiest_grid": f"""WITH {_silver_sql()} SELECT floor(latitude * 10) / 10 AS lat_cell, floor(longitude * 10) / 10 AS lon_cell, count(*) AS records
        FROM silver GROUP BY ALL""",
    "speed_stats": f"""WITH {_silver_sql()}, {_motion_sql()}, k AS (SELECT icao24, {_km('a', 'o', 'latitude', 'longitude')} / 1.852 / (delta_t / 3600.0) AS kts FROM smooth WHERE delta_t > 0)
        SELECT icao24, count(*) AS intervals, round(avg(kts), 4) AS avg_speed_kts, round(quantile_disc(kts, 0.5), 4) AS median_speed_kts FROM k GROUP BY icao24""",
    "orders_per_day": "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders FROM orders GROUP BY 1",
    "customers_per_day": "SELECT CAST(o_orderdate AS DATE) AS date, count(DISTINCT o_custkey) AS unique_aircraft FROM orders GROUP BY 1",
    "top_parts": "SELECT l_partkey, count(*) AS sightings FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "dq_metrics": f"""WITH g AS (SELECT icao24, "timestamp", count(*) AS n, count(*) FILTER ({_NULLS}) AS nulls, count(*) FILTER ({_RANGE}) AS bad
            FROM bronze_positions GROUP BY icao24, "timestamp"),
        m AS (SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(nulls) AS BIGINT) AS null_count, CAST(sum(bad) AS BIGINT) AS range_count,
            count(*) FILTER (n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows FROM g),
        x AS (SELECT *, null_count / total_rows AS null_ratio FROM m),
        y AS (SELECT *, concat_ws(' | ', CASE WHEN null_ratio > 0.05 THEN 'null ratio above threshold' END,
            CASE WHEN range_count > 0 THEN range_count || ' rows out of range' END,
            CASE WHEN duplicate_groups > 0 THEN duplicate_groups || ' duplicate groups' END) AS messages FROM x)
        SELECT *, CASE WHEN messages <> '' THEN 'WARNING' ELSE 'PASS' END AS status FROM y""",
    "dq_nulls": f"SELECT pos_id FROM bronze_positions WHERE {_NULLS}",
    "dq_range": f"SELECT pos_id FROM bronze_positions WHERE {_RANGE}",
    "dq_duplicates": f'SELECT b.pos_id FROM bronze_positions b JOIN ({_DUPES}) g ON b.icao24 = g.icao24 AND b."timestamp" = g."timestamp"',
    "dq_duplicates_window": """SELECT pos_id FROM bronze_positions QUALIFY count(*) OVER (PARTITION BY icao24, "timestamp") > 1""",
    "dq_duplicate_groups": 'SELECT icao24, epoch_us("timestamp") AS us, count(*) AS copies FROM bronze_positions GROUP BY icao24, us HAVING count(*) > 1',
    "dq_quarantine": f"""SELECT pos_id, '20240101T000000Z' AS run_id, 'nulls' AS rule FROM bronze_positions WHERE {_NULLS}
        UNION ALL SELECT pos_id, '20240101T000000Z', 'range' FROM bronze_positions WHERE {_RANGE}
        UNION ALL SELECT pos_id, '20240101T000000Z', 'duplicates' FROM (SELECT pos_id FROM bronze_positions QUALIFY count(*) OVER (PARTITION BY icao24, "timestamp") > 1)""",
    "movement_l1": _motion_query("l1", "l1 >= 0.7"),
    "movement_km_per_s": _motion_query("v", "v >= 0.7"),
    "movement_ma3": _motion_query("ma3", "ma3 >= 0.7"),
    "movement_with_first": _motion_query("v", "v >= 0.7", first=True),
    "label_gap_or_still": _motion_query("l1", "delta_t > 600 OR l1 < 0.001"),
    "score_native": f"""WITH {_silver_sql()}, {_motion_sql()}, p AS (SELECT icao24, second, 1 / (1 + exp(-(4.0 * ma3 - 2.8))) AS p FROM smooth WHERE delta_t IS NOT NULL)
        SELECT icao24, second, round(p, 6) AS risk_probability, CAST(p > 0.5 AS INTEGER) AS predicted_risk FROM p""",
    "hash_split": f"WITH {_silver_sql()}, {_motion_sql()} SELECT icao24, second, ((second * 2654435761) % 1000003) % 10 < 2 AS is_test FROM smooth WHERE delta_t IS NOT NULL",
    "flight_stats": f"""WITH {_PREPARED}, {_STATS} SELECT flight_id, points, first_s, last_s, round(avg_risk, 12) AS avg_risk, round(max_risk, 12) AS max_risk,
        {_COLOUR.format(r='avg_risk')} AS colour, round(2 + 6 * avg_risk, 12) AS weight FROM stats""",
    "key_figures": f"""WITH {_PREPARED} SELECT count(DISTINCT flight_id) AS flights, count(*) AS points, round(coalesce(avg(risk), 0), 12) AS avg_risk,
        round(coalesce(max(risk), 0), 12) AS max_risk FROM prep""",
    "top_flights": f"""WITH {_PREPARED}, {_STATS} SELECT flight_id, points, round(avg_risk, 12) AS avg_risk, round(max_risk, 12) AS max_risk FROM stats
        ORDER BY stats.avg_risk DESC, points DESC, flight_id NULLS FIRST LIMIT 15""",
    "report_dropped": """SELECT count(*) FILTER (evt_ts IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL) AS kept,
        count(*) FILTER (evt_ts IS NULL OR latitude IS NULL OR longitude IS NULL) AS dropped FROM stream_scores""",
    "selected_track": f"WITH {_PREPARED} SELECT flight_id, second, lat, lon FROM prep WHERE flight_id IN ('561230', '47CDF8')",
    "run_stamps": "SELECT score_id, strftime(make_timestamp(evt_ts * 1000000), '%Y%m%dT%H%M%SZ') AS stamp FROM stream_scores",
    "median_centre": f"WITH {_PREPARED} SELECT round(median(lat), 6) AS lat, round(median(lon), 6) AS lon FROM prep",
    "track_thinned": """WITH t AS (SELECT icao24 AS flight_id, score_id, row_number() OVER (PARTITION BY icao24 ORDER BY evt_ts, score_id) - 1 AS r,
            count(*) OVER (PARTITION BY icao24) AS n FROM stream_scores WHERE icao24 IS NOT NULL)
        SELECT flight_id, score_id, r AS point FROM t WHERE n >= 2 AND (n <= 50 OR ((r * 49 + n - 2) // (n - 1)) * (n - 1) < (r + 1) * 49)""",
    "track_ends": f"""WITH {_PREPARED}, o AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY second, lat, lon) AS i,
            row_number() OVER (PARTITION BY flight_id ORDER BY second DESC, lat DESC, lon DESC) AS j FROM prep WHERE flight_id IS NOT NULL)
        SELECT a.flight_id, a.lat AS lat_from, a.lon AS lon_from, b.lat AS lat_to, b.lon AS lon_to FROM o a JOIN o b ON a.flight_id = b.flight_id WHERE a.i = 1 AND b.j = 1""",
    "normalised_risk": """SELECT event_id, round(greatest(0.0, least(1.0, coalesce(value, 0) / (SELECT CASE WHEN quantile_cont(value, 0.99) > 1 THEN 100.0 ELSE 1.0 END FROM events))), 9) AS risk FROM events""",
    "risk_colours": f"""WITH s AS (SELECT score_id, greatest(0.0, least(1.0, coalesce(risk_probability, 0) / (SELECT CASE WHEN quantile_cont(risk_probability, 0.99) > 1 THEN 100.0 ELSE 1.0 END FROM stream_scores))) AS r FROM stream_scores)
        SELECT score_id, {_COLOUR.format(r='r')} AS colour FROM s""",
    "local_time_range": """SELECT score_id, strftime(make_timestamp((evt_ts + 19800) * 1000000), '%Y-%m-%d %H:%M:%S') AS local FROM stream_scores
        WHERE evt_ts BETWEEN ((1672900000 + 19800) // 86400 - 1) * 86400 - 19800 AND ((1672900000 + 19800) // 86400) * 86400 - 19800 - 1""",
    "wire_normalised": f"""WITH r AS (SELECT {_OBJ} AS p FROM raw_records),
        x AS (SELECT lower(trim({_pick('hex', 'icao24', 'icao')})) AS icao24, TRY_CAST(p->>'$.lat' AS DOUBLE) AS lat, TRY_CAST(p->>'$.lon' AS DOUBLE) AS lon,
            coalesce(nullif(TRY_CAST(p->>'$.alt_baro' AS DOUBLE), 0), nullif(TRY_CAST(p->>'$.alt' AS DOUBLE), 0)) AS alt_baro,
            TRY_CAST(p->>'$.gs' AS DOUBLE) AS gs, TRY_CAST(p->>'$.track' AS DOUBLE) AS track, nullif(trim({_pick('flight', 'callsign')}), '') AS flight,
            p->>'$.reg' AS reg, p->>'$.src' AS src, CAST(1700000000 AS BIGINT) AS "timestamp" FROM r)
        SELECT *, count(*) AS records FROM x WHERE icao24 IS NOT NULL AND icao24 <> '' GROUP BY ALL""",
    "wire_dead_letters": f"SELECT rec_id FROM raw_records WHERE {_OBJ} IS NULL",
    "json_parse": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "json_emit": """SELECT CAST(r_regionkey AS VARCHAR) AS key, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region""",
    "stream_dedupe": f'SELECT DISTINCT icao24, {_MS} AS second FROM aircraft_positions WHERE icao24 IS NOT NULL AND "timestamp" IS NOT NULL',
    "stream_score": f"""WITH src AS (SELECT {KEY_SQL} AS icao24, {_MS} AS second, lat AS latitude, lon AS longitude, log_seq FROM aircraft_positions
            WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND "timestamp" IS NOT NULL),
        one AS (SELECT * FROM src WHERE icao24 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY icao24, second ORDER BY log_seq) = 1), {_motion_sql('one')}
        SELECT icao24, second AS evt_ts, delta_t, round(ma3, 6) AS movement_score, round(1 / (1 + exp(-(4.0 * ma3 - 2.8))), 6) AS risk_probability,
            CAST(ma3 > 0.7 AS INTEGER) AS predicted_risk FROM smooth WHERE delta_t IS NOT NULL""",
}
