"""Every registered query agrees with its SQL on the small tables."""

import math

import duckdb
import pytest

from logweir.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_codec_query_round_trips(spark, sf):
    rows = catalogue.QUERIES["codec_roundtrip"](spark, sf)
    assert rows.where("status <> 'ok' OR NOT same").count() == 0


@pytest.mark.parametrize("name", ["replication_lag", "health"])
def test_halves_round_to_even(spark, tmp_path, name):
    """Balances that lie halfway between two whole numbers, as large tables have them."""
    balances = [i + 0.5 for i in range(-20, 400)] + [i + 0.125 for i in range(20)]
    spark.createDataFrame([(k % 50, x) for k, x in enumerate(balances)], "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    got = c.execute(catalogue.ORACLES[name])
    columns = [x[0] for x in got.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, got.fetchall())
