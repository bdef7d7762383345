import math

import duckdb
import pytest

from sparkwarden.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = ("pages", "events", "labels")


def value(x):
    return round(x, 5) + 0.0 if isinstance(x, float) and not math.isnan(x) else (int(x) if isinstance(x, bool) else x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(value(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["whitelist_split", "visit_scores"])
@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_both_sides_of_the_bypass_have_rows(spark, name, folder):
    assert {r.whitelisted for r in QUERIES[name](spark, f"/root/testdata/{folder}").select("whitelisted").distinct().collect()} == {True, False}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0
