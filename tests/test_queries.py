"""Every registered query of the frame layer against its SQL in DuckDB."""

import math

import duckdb
import pytest

from skiff import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return [plain(x) for x in v] if isinstance(v, list) else repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in queries.oracle_sql():
        assert rows
        return
    want = con.sql(queries.oracle_sql()[name])
    assert table(df.columns, rows) == table([d[0] for d in want.description], want.fetchall())


def test_float_ops_on_odd_rows(spark, tmp_path):
    of = "unnest(['7', '-7', '0', '-0', NULL, 'nan', 'inf']::DOUBLE[])"
    odd = f"SELECT 1::BIGINT AS l_orderkey, 1::INTEGER AS l_linenumber, a AS l_quantity, b AS l_discount, b AS l_tax FROM (SELECT {of} AS a), (SELECT {of} AS b) WHERE a IS NULL OR abs(a) < 8"
    c = duckdb.connect()
    c.sql(f"COPY ({odd}) TO '{tmp_path}/lineitem.parquet'")
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    df, want = queries.queries()["float_ops"](spark, str(tmp_path)), c.sql(queries.oracle_sql()["float_ops"])
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())


def test_plans(spark):
    q = queries.queries()

    def plan(name):
        return q[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()

    for name in ("groupby_sum_min_mean", "wl_clean_listings", "wl_logs", "kmeans_assign", "url_split", "wl_iban"):
        assert "Python" not in plan(name), name
    assert "TakeOrderedAndProject" in plan("topk")
    scan = plan("groupby_sum_min_mean")
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,24.0)" in scan and "l_partkey" not in scan
