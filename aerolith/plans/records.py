"""Queries of the data-processing operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive, drift
from ..operators.exactly_once import exactly_once, instant_seconds, later_copies
from ..functions.identity import entity_key
from ..operators.regions import Grid, near_pairs, points_in_regions
from ..operators.spikes import implausible, judged, scatter
from ..operators.trips import StopRule, clean_pings, stops_and_trips
from ..session import materialise, shared
from .tables import table

#: DuckDB text of the key of an aircraft.
KEY_SQL = r"nullif(lower(regexp_replace(icao24, '^\s+|\s+$', '', 'g')), '')"


def p1_stops_and_trips(spark: SparkSession, d: str) -> DataFrame:
    pings = table(spark, d, "bronze_positions")
    return stops_and_trips(clean_pings(pings, "icao24", "latitude", "longitude", F.unix_seconds("timestamp"), "pos_id"), StopRule())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_stops_and_trips(spark, d).select("icao24", "kind", "start_s", "end_s")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return later_copies(table(spark, d, "aircraft_positions"), "icao24", instant_seconds("timestamp"), "log_seq")


def p2_exactly_once(spark: SparkSession, d: str) -> DataFrame:
    """The topic with one copy of each message."""
    kept = exactly_once(table(spark, d, "aircraft_positions"), "icao24", instant_seconds("timestamp"), "log_seq")
    return kept.withColumn("kafka_ts", F.unix_micros("kafka_ts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_pairs(table(spark, d, "stream_scores"), "score_id", entity_key("icao24"), "latitude", "longitude", "evt_ts", 1.0, 120)
    return pairs.withColumnsRenamed({"id_a": "score_id_a", "id_b": "score_id_b"})


#: Corners of an arrowhead, in degrees from the corner of its cell; it reaches over the cell and is not convex.
ARROW = [(1.0, 0.5), (5.0, 11.5), (9.0, 0.5), (5.0, 4.0)]


def p3_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """Scored places by the regions that contain them: an arrowhead for every cell of ten degrees in use, also over the
    date line."""
    t = table(spark, d, "stream_scores")
    cell = lambda c: (F.floor(F.col(c) / 10) * 10).cast("int")
    cells = t.where("abs(latitude) <= 90 AND abs(longitude) <= 180").select(cell("latitude").alias("a"), cell("longitude").alias("o")).distinct()
    ring = F.array(*[F.struct((F.col("a") + x).alias("lat"), (F.col("o") + y).alias("lon")) for x, y in ARROW])
    regions = cells.select(F.format_string("%d:%d", "a", "o").alias("region"), ring.alias("ring"))
    grid = Grid(400.0, 400.0)  # about as wide as the regions
    return points_in_regions(t, regions, "score_id", "latitude", "longitude", "region", "ring", grid).withColumnRenamed("point", "score_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = implausible(table(spark, d, "aircraft_positions"), "icao24", instant_seconds("timestamp"), "log_seq")
    return found.select("log_seq", "field").distinct()


def p4_usual_scatter(spark: SparkSession, d: str) -> DataFrame:
    """How each aircraft's readings usually scatter around its course, by field and hour of the day."""
    passed = judged(table(spark, d, "aircraft_positions"), "icao24", instant_seconds("timestamp"), "log_seq")
    return scatter(passed, ["k", "field", "hour"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = drift.ingest(table(spark, d, "raw_records"), ["raw_file_id", "lane", "file_seq"])
    return drift.changes(drift.ledger(t, "raw_file_id", "lane", "file_seq")).withColumnRenamed("file", "raw_file_id").distinct()


def p5_one_table(spark: SparkSession, d: str) -> DataFrame:
    """All raw records in the schema of bronze_positions, with what didn't fit and the squawk replayed from it."""
    t = drift.ingest(table(spark, d, "raw_records"), ["rec_id", "raw_file_id"]).drop("_seen")
    return drift.replay(t, {"squawk": "string"}).withColumn("timestamp", F.unix_micros("timestamp"))


def p5_typed(spark: SparkSession, d: str) -> DataFrame:
    """The typed columns of every record, and how many of its fields are in the rescue column."""
    t = p5_one_table(spark, d)
    left = F.when(F.get_json_object("_rescued", "$._payload").isNull(), F.size(F.coalesce(F.json_object_keys("_rescued"), F.array().cast("array<string>"))))
    return t.select("rec_id", "icao24", "latitude", "longitude", "flight", "reg", "timestamp", "squawk", left.alias("rescued"))


_CONTENT = ["icao24", "latitude", "longitude", "flight", "reg", "timestamp", "date"]


def p6_plan(spark: SparkSession, d: str) -> DataFrame:
    return archive.plan(
        table(spark, d, "bronze_positions"), table(spark, d, "bronze_files"), "file_id", "file_path", "n_bytes", _CONTENT
    ).withColumnRenamed("file", "file_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_plan(spark, d).where("action <> 'keep'").select("file_id", "action")


def p6_archive(spark: SparkSession, d: str) -> DataFrame:
    """The small files packed into block files by directory: the index, each member read back by its range."""
    rows = table(spark, d, "bronze_positions")
    merge = p6_plan(spark, d).where("action = 'merge'").select(F.col("file_id").alias("file"), "path")
    content = archive.row_bytes(rows, "file_id", "pos_id").join(merge, "file")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    content = materialise(content.withColumn("folder", folder))  # the index and the blocks both read it
    index, at = materialise(archive.offsets(content, "folder")), shared(spark, "blocks")
    archive.store(content, index, at)
    back = archive.lookup(index, at).select("file", "intact")
    return index.join(back, "file").withColumnRenamed("file", "file_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The raw files, whose bytes are their payloads one to a line, packed by lane into blocks of 64 KiB; what comes back
    by its range, and the digest of it."""
    rec = table(spark, d, "raw_records").groupBy(F.col("raw_file_id").alias("file"), F.col("lane"), F.col("file_name").alias("path"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("payload").isNotNull(), F.struct("rec_id", "payload")))), lambda x: x["payload"])
    files = materialise(rec.agg(F.encode(F.array_join(lines, "\n"), "UTF-8").alias("content")))
    index, at = materialise(archive.offsets(files, "lane", 64 << 10, 64)), shared(spark, "blocks")
    archive.store(files, index, at)
    back = archive.lookup(index, at)
    number = F.regexp_extract("block", "/(\\d+)$", 1).cast("bigint")
    return index.join(back.select("file", "content", "intact"), "file").select(
        F.col("file").alias("raw_file_id"), number.alias("block"), "offset", "length", F.md5("content").alias("digest"), "intact"
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_stops_and_trips": p1_stops_and_trips,
    "p2_found": p2_found,
    "p2_exactly_once": p2_exactly_once,
    "p3_found": p3_found,
    "p3_in_regions": p3_in_regions,
    "p4_found": p4_found,
    "p4_usual_scatter": p4_usual_scatter,
    "p5_found": p5_found,
    "p5_one_table": p5_one_table,
    "p5_typed": p5_typed,
    "p6_found": p6_found,
    "p6_plan": p6_plan,
    "p6_archive": p6_archive,
    "p6_containers": p6_containers,
}

_P2 = f"""
    SELECT *, {KEY_SQL} AS k,
           CASE WHEN abs("timestamp") >= 100000000000 THEN CAST(floor("timestamp" / 1000.0) AS BIGINT) ELSE "timestamp" END AS s
    FROM aircraft_positions"""



def _first(*names: str) -> str:
    """The first non-null value under the names, in order."""
    return "coalesce(" + ", ".join(f"p->>'$.{n}'" for n in names) + ")"


ORACLES = {
    "p2_found": f"""
        WITH m AS ({_P2})
        SELECT log_seq FROM m WHERE k IS NOT NULL AND s IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY k, s ORDER BY log_seq) > 1""",
    "p2_exactly_once": f"""
        WITH m AS ({_P2})
        SELECT log_seq, batch_id, icao24, lat, lon, alt_baro, gs, track, flight, reg, src, "timestamp", epoch_us(kafka_ts) AS kafka_ts
        FROM m
        QUALIFY k IS NULL OR s IS NULL OR row_number() OVER (PARTITION BY k, s ORDER BY log_seq) = 1""",
    "p3_found": f"""
        WITH r AS (
            SELECT score_id AS id, {KEY_SQL} AS k, radians(latitude) AS a, radians(longitude) AS o, evt_ts AS s, evt_ts // 120 AS t
            FROM stream_scores WHERE abs(latitude) <= 90 AND abs(longitude) <= 180 AND evt_ts IS NOT NULL
        ), b AS (SELECT *, unnest([t - 1, t, t + 1]) AS u FROM r WHERE k IS NOT NULL)
        SELECT x.id AS score_id_a, y.id AS score_id_b
        FROM r x JOIN b y ON x.t = y.u AND x.id < y.id AND x.k <> y.k AND abs(x.s - y.s) <= 120
        WHERE 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((y.a - x.a) / 2), 2) + cos(x.a) * cos(y.a) * pow(sin((y.o - x.o) / 2), 2)))) <= 1.0""",
    "p3_in_regions": """
        WITH p AS (SELECT score_id, latitude AS y, unnest([longitude, longitude - 360, longitude + 360]) AS x FROM stream_scores
            WHERE abs(latitude) <= 90 AND abs(longitude) <= 180),
        c AS (SELECT DISTINCT CAST(floor(latitude / 10) * 10 AS INTEGER) AS a, CAST(floor(longitude / 10) * 10 AS INTEGER) AS o FROM stream_scores
            WHERE abs(latitude) <= 90 AND abs(longitude) <= 180),
        v AS (SELECT a || ':' || o AS region, a, o, [{'y': a + 1.0::DOUBLE, 'x': o + 0.5::DOUBLE}, {'y': a + 5.0::DOUBLE, 'x': o + 11.5::DOUBLE},
            {'y': a + 9.0::DOUBLE, 'x': o + 0.5::DOUBLE}, {'y': a + 5.0::DOUBLE, 'x': o + 4.0::DOUBLE}] AS r FROM c),
        e AS (SELECT region, a, o, r[i].y AS y1, r[i].x AS x1, r[i % 4 + 1].y AS y2, r[i % 4 + 1].x AS x2 FROM v, range(1, 5) g(i)),
        j AS (SELECT score_id, region, p.x AS x, p.y AS y, x1, y1, x2, y2, x1 + (p.y - y1) / (y2 - y1) * (x2 - x1) AS hit FROM p JOIN e
            ON p.y BETWEEN e.a + 1 AND e.a + 9 AND p.x BETWEEN e.o AND e.o + 12 AND p.y BETWEEN least(y1, y2) AND greatest(y1, y2))
        SELECT DISTINCT score_id, region FROM j GROUP BY score_id, region, x
        HAVING count(*) FILTER (y >= least(y1, y2) AND y < greatest(y1, y2) AND hit > x) % 2 = 1 OR bool_or(hit = x)""",
    "p5_found": """
        WITH rec AS (
            SELECT raw_file_id AS f, lane, file_seq, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM raw_records
        ), ok AS (SELECT * FROM rec WHERE json_type(j) = 'OBJECT'),
        files AS (SELECT f, lane, row_number() OVER (PARTITION BY lane ORDER BY file_seq) AS i FROM (SELECT DISTINCT f, lane, file_seq FROM ok)),
        e AS (SELECT f, unnest(json_keys(j)) AS name, j FROM ok),
        t AS (
            SELECT f, name, CASE json_type(json_extract(j, '$."' || name || '"'))
                WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind
            FROM e
        ), n AS (
            SELECT f, name, max(kind) AS kind, CASE
                WHEN name IN ('icao24', 'icao', 'hex') THEN 'icao24'
                WHEN lower(name) IN ('latitude', 'lat') THEN 'latitude'
                WHEN lower(name) IN ('longitude', 'lon', 'lng') THEN 'longitude'
                WHEN name IN ('flight', 'flightId', 'callsign') THEN 'flight'
                WHEN name IN ('reg', 'registration') THEN 'reg'
                WHEN name IN ('timestamp', 'ts', 'seen_at') THEN 'timestamp'
                WHEN name IN ('alt_baro', 'altBaro', 'alt') THEN 'alt_baro'
                WHEN name IN ('gs', 'ground_speed') THEN 'gs'
                WHEN name IN ('track', 'heading') THEN 'track'
                WHEN name IN ('src', 'feed') THEN 'src'
                ELSE name END AS field
            FROM t GROUP BY f, name
        ), a AS (SELECT lane, i, n.f, field, name, kind FROM n JOIN files USING (f)),
        pairs AS (SELECT b.f AS f, b.lane, b.i FROM files b WHERE b.i > 1),
        now_ AS (SELECT p.f AS raw_file_id, p.lane, p.i, a.field, a.name, a.kind FROM pairs p JOIN a ON a.f = p.f),
        was AS (SELECT p.f AS raw_file_id, a.field, a.name, a.kind FROM pairs p JOIN a ON a.lane = p.lane AND a.i = p.i - 1),
        both_ AS (
            SELECT coalesce(x.raw_file_id, y.raw_file_id) AS raw_file_id, coalesce(x.field, y.field) AS field,
                   x.name AS n1, y.name AS n0, x.kind AS k1, y.kind AS k0
            FROM now_ x FULL JOIN was y ON x.raw_file_id = y.raw_file_id AND x.field = y.field
        )
        SELECT raw_file_id, field, 'added' AS change FROM both_ WHERE n0 IS NULL
        UNION ALL SELECT raw_file_id, field, 'removed' FROM both_ WHERE n1 IS NULL
        UNION ALL SELECT raw_file_id, field, 'renamed' FROM both_ WHERE n0 <> n1
        UNION ALL SELECT raw_file_id, field, 'retyped' FROM both_ WHERE k0 <> k1""",
    "p5_typed": f"""
        WITH r AS (SELECT rec_id, payload, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END AS p FROM raw_records),
        v AS (SELECT rec_id, payload, p, {_first('hex', 'icao', 'icao24')} AS icao24, {_first('Latitude', 'lat', 'latitude')} AS la,
            {_first('lng', 'lon', 'longitude')} AS lo, {_first('callsign', 'flight', 'flightId')} AS flight, {_first('reg', 'registration')} AS reg,
            {_first('seen_at', 'timestamp', 'ts')} AS ts, p->>'$.squawk' AS squawk FROM r),
        t AS (SELECT *, TRY_CAST(la AS DOUBLE) AS latitude, TRY_CAST(lo AS DOUBLE) AS longitude, TRY_CAST(ts AS DOUBLE) AS num FROM v),
        u AS (SELECT *, CASE WHEN num IS NOT NULL THEN CAST(round(CASE WHEN abs(num) >= 1e11 THEN num / 1000 ELSE num END * 1000000) AS BIGINT)
            ELSE epoch_us(TRY_CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP)) END AS "timestamp",
            len(list_filter(json_keys(p), lambda k: k NOT IN ('hex', 'icao', 'icao24', 'Latitude', 'lat', 'latitude', 'lng', 'lon', 'longitude',
                'callsign', 'flight', 'flightId', 'reg', 'registration', 'seen_at', 'timestamp', 'ts'))) AS other FROM t)
        SELECT rec_id, icao24, latitude, longitude, flight, reg, "timestamp", squawk,
            CASE WHEN p IS NULL THEN CASE WHEN payload IS NULL THEN 0 END ELSE CAST(other - CAST(squawk IS NOT NULL AS INTEGER)
                + CASE WHEN la IS NOT NULL AND latitude IS NULL THEN 1 ELSE 0 END + CASE WHEN lo IS NOT NULL AND longitude IS NULL THEN 1 ELSE 0 END
                + CASE WHEN ts IS NOT NULL AND "timestamp" IS NULL THEN 1 ELSE 0 END AS INTEGER) END AS rescued FROM u""",
    "p6_containers": """
        WITH f AS (SELECT raw_file_id, lane, coalesce(string_agg(payload, chr(10) ORDER BY rec_id), '') AS content FROM raw_records GROUP BY raw_file_id, lane, file_name),
        n AS (SELECT *, strlen(content) AS length FROM f),
        b AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY lane ORDER BY raw_file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM n)
        SELECT raw_file_id, before // 65536 AS block, before - min(before) OVER (PARTITION BY lane, before // 65536) AS "offset", CAST(length AS INTEGER) AS length,
            md5(content) AS digest, true AS intact FROM b""",
    "p6_found": """
        WITH live AS (
            SELECT file_id, n_bytes FROM bronze_files
            WHERE len(list_filter(string_split(file_path, '/'), lambda p: starts_with(p, '_') OR starts_with(p, '.'))) = 0
        ), r AS (
            SELECT DISTINCT file_id AS f, icao24, latitude, longitude, flight, reg, "timestamp" AS t, "date" AS d,
                   md5(concat_ws('|', coalesce('v' || icao24, 'n'), coalesce('v' || latitude, 'n'), coalesce('v' || longitude, 'n'),
                       coalesce('v' || flight, 'n'), coalesce('v' || reg, 'n'), coalesce('v' || epoch_us("timestamp"), 'n'),
                       coalesce('v' || "date", 'n'))) AS h
            FROM bronze_positions WHERE file_id IN (SELECT file_id FROM live)
        ), n AS (SELECT f, count(*) AS n FROM r GROUP BY f),
        held AS (SELECT a.f, b.f AS g, count(*) AS m FROM r a JOIN r b ON a.h = b.h AND b.f < a.f GROUP BY a.f, b.f),
        gone AS (SELECT DISTINCT held.f FROM held JOIN n ON held.f = n.f AND held.m = n.n)
        SELECT file_id, CASE WHEN file_id IN (SELECT f FROM gone) THEN 'drop' ELSE 'merge' END AS action
        FROM live WHERE file_id IN (SELECT f FROM n) AND (file_id IN (SELECT f FROM gone) OR n_bytes < 16384)""",
}
