import random

import brute
from aerolith.operators.exactly_once import exactly_once, first_copies, insert, instant_seconds, later_copies, shards

SCHEMA = "log_seq bigint, icao24 string, timestamp bigint, _q string, first double"


def made(n, seed):
    rnd = random.Random(seed)
    keys = ["abc123", "ABC123", "\tabc123 ", "0abc12", "zzzz", "longer-key-than-six", "", "  ", None, "é", "ffffff"]
    times = [0, 1, 5, 1_700_000_000, 1_700_000_000_000, 1_700_000_000_999, -5, None]
    return [(i, rnd.choice(keys), rnd.choice(times), "x", 0.5) for i in range(n)]


def want(rows):
    seen, later = set(), set()
    for i, k, t, *_ in sorted(rows, key=lambda r: r[0]):
        k = brute.key_of(k)
        if k is None or t is None:
            continue
        s = t // 1000 if abs(t) >= 100_000_000_000 else t
        (later.add(i) if (k, s) in seen else seen.add((k, s)))
    return later


def test_against_a_plain_set(spark):
    rows = made(800, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    for bits in (1, 12, 20):
        assert {r[0] for r in later_copies(df, "icao24", instant_seconds("timestamp"), "log_seq", bits).collect()} == want(rows)
    kept = exactly_once(df, "icao24", instant_seconds("timestamp"), "log_seq")
    assert kept.columns == df.columns
    got = sorted(r.log_seq for r in kept.collect())
    assert got == sorted({r[0] for r in rows} - want(rows))


def test_empty_ties_and_a_hot_identifier(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert later_copies(none, "icao24", instant_seconds("timestamp"), "log_seq").count() == 0
    assert exactly_once(none, "icao24", instant_seconds("timestamp"), "log_seq").count() == 0
    same = spark.createDataFrame([(1, "aa", 5, "x", 1.0)] * 3, SCHEMA)
    assert exactly_once(same, "icao24", instant_seconds("timestamp"), "log_seq").count() == 1
    hot = spark.range(5000).selectExpr("id AS log_seq", "'abcdef' AS icao24", "7L AS timestamp")
    assert later_copies(hot, "icao24", instant_seconds("timestamp"), "log_seq").count() == 4999


def test_shards_are_partitioned_by_the_quotient(spark):
    df = spark.createDataFrame(made(800, 5), SCHEMA)
    t = shards(df, "icao24", instant_seconds("timestamp"), "log_seq", 6)
    where = {}
    for part, q in t.selectExpr("spark_partition_id() AS p", "_q").distinct().collect():
        where.setdefault(q, set()).add(part)
    assert len(where) > 3 and all(len(p) == 1 for p in where.values())
    assert "hashpartitioning(_q" in t._jdf.queryExecution().executedPlan().toString()


def test_batches_are_inserted_into_kept_tables(spark, tmp_path):
    rows = made(600, 7)
    path = f"{tmp_path}/seen"
    got = []
    for part in (rows[:250], rows[250:400], rows[250:400], rows[400:]):  # one batch is tried again
        df = spark.createDataFrame(part, SCHEMA)
        got.append({r[0] for r in insert(df, path, "icao24", instant_seconds("timestamp"), "log_seq", 4).collect()})
    whole = {r[0] for r in first_copies(spark.createDataFrame(rows, SCHEMA), "icao24", instant_seconds("timestamp"), "log_seq").collect()}
    assert got[1] == got[2] and got[0] | got[1] | got[3] == whole and not got[0] & got[1] and not got[1] & got[3]
