"""Each registered query against its DuckDB form, on the smallest tables."""

import os

import duckdb
import pytest
from palimpsest.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    sql = db.execute(ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(x) for x in r) for r in sql.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_whole_table_paths_reach_every_order(spark, db):
    """Each order of a customer with several, the last one's keys too."""
    several = "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)"
    want = {r[0] for r in db.execute(several).fetchall()}
    for name in ("path_opt_all", "path_star_all", "path_zero_graph_all"):
        assert {r.x for r in QUERIES[name](spark, DATA).collect()} == want, name


def test_theta_join_takes_all_rows_and_no_ties(spark, tmp_path):
    """Keys that theta_join's filters leave out; equal balances don't count."""
    spark.createDataFrame([(1, 3, 5.0), (2, 3, 7.0), (3, 4, 1.0), (4, 3, float("nan"))], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(2, 3, 7.0), (3, 3, 9.0), (4, 4, 0.5), (5, 3, float("nan"))], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in QUERIES["theta_join_all"](spark, str(tmp_path)).collect()] == [(3, 3)]
