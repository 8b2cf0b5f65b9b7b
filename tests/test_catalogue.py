"""Every catalogue query against its DuckDB SQL on the smallest tables, and the driver's entry."""

import decimal

import duckdb
import pytest
from siltstone.plans import catalogue, library  # noqa: F401

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) and len(catalogue.QUERIES) >= 110


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert mine == theirs


def test_size_labels_beyond_a_terabyte(spark, tmp_path):
    """Keys of a larger part table, on both sides of 2**40 bytes."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (k AS p_partkey) FROM (FROM '{DATA}/part.parquet' LIMIT 1), unnest([46114::BIGINT, 46115, 46116, 119999, 1199999]) u(k)) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    mine = sorted(tuple(r) for r in catalogue.QUERIES["size_labels"](spark, str(tmp_path)).select("p_partkey", "human", "mib").collect())
    assert mine == sorted(con.execute(catalogue.ORACLES["size_labels"]).fetchall())
    assert mine[2][1] == "1024.0G"


def test_no_nested_loop_where_an_equi_join_is_meant(spark):
    for name in ("substring_theta", "chunk_to_block", "asof_prefix", "legacy_unique_match"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
