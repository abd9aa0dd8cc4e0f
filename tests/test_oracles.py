"""Every query with SQL against DuckDB, over the smallest tables."""

from collections import Counter

import pytest
from aerolith.plans import records, telemetry

QUERIES = {**telemetry.QUERIES, **records.QUERIES}
ORACLES = {**telemetry.ORACLES, **records.ORACLES}


def text(v):
    return "null" if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = Counter(tuple(map(text, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    expected = Counter(tuple(map(text, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    QUERIES[name](spark, data).collect()


def test_found_columns(spark, data):
    want = {
        "p1_found": ["icao24 string", "kind string", "start_s bigint", "end_s bigint"], "p2_found": ["log_seq bigint"],
        "p3_found": ["score_id_a bigint", "score_id_b bigint"], "p4_found": ["log_seq bigint", "field string"],
        "p5_found": ["raw_file_id bigint", "field string", "change string"], "p6_found": ["file_id bigint", "action string"],
    }
    for name, cols in want.items():
        df = QUERIES[name](spark, data)
        assert sorted(f"{n} {t}" for n, t in df.dtypes) == sorted(cols), name
        assert df.count() == df.distinct().count(), name
