"""Every query that has SQL gives the rows that DuckDB computes from it."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from quarry import queries as base

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    return float(f"{v:.12g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(norm(row[i]) for i in at) for row in r.fetchall())
    assert Counter(tuple(norm(row[c]) for c in cols) for row in df.collect()) == want


@pytest.mark.parametrize("name", ["ewma_rate", "weight_pool"])
def test_values_of_zero_are_observations(spark, tmp_path, name):
    """First of a user's or pair's, several in a row, in the middle, at the end and of failures."""
    zero = [(1, "view", 0.0), (1, "view", 0.0), (1, "view", 8.0), (1, "click", 5.0), (1, "click", 0.0), (1, "click", 3.0), (1, "error", 0.0), (1, "error", 2.0), (2, "signup", 4.0), (2, "purchase", 0.0), (2, "signup", 0.0), (2, "purchase", 6.0), (3, "view", 0.0)]
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, timestamp '2024-01-01' + to_hours(?), ?, ?, ?, '{}')", [(i, i, *e) for i, e in enumerate(zero)])
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    df = QUERIES[name](spark, str(tmp_path))
    r = con.execute(f"select {', '.join(f'"{c}"' for c in df.columns)} from ({ORACLE[name]})").fetchall()
    assert Counter(tuple(map(norm, row)) for row in df.collect()) == Counter(tuple(map(norm, row)) for row in r)


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLE)))
def test_folds_do_not_depend_on_partitions(spark, name):
    rows = lambda: sorted(map(str, base.QUERIES[name](spark, SF).collect()))
    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert first and rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
