"""Queries on cameras that all stand in one spot, as those of a scan do where customers are 60 times as many."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def spot(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("spot"))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CAST(s_suppkey AS BIGINT) AS s_suppkey) FROM '/root/testdata/sf0.001/supplier.parquet' LIMIT 1) TO '{d}/supplier.parquet'")
    # one supplier, and customers whose keys agree modulo 40, 32 and 5
    con.execute(f"COPY (SELECT * REPLACE (CAST(c_custkey * 160 AS BIGINT) AS c_custkey) FROM '/root/testdata/sf0.001/customer.parquet' ORDER BY c_custkey LIMIT 15) TO '{d}/customer.parquet'")
    for t in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return d, con


@pytest.mark.parametrize("name", ["register_windows", "compose_windows", "resample_paths"])
def test_cameras_in_one_spot_agree_with_sql(spark, spot, name):
    d, con = spot
    df = entry.queries()[name](spark, d)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]}) ORDER BY ALL").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)
