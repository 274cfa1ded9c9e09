"""Queries over keys of more than 16 bits, against their oracles in DuckDB."""

import duckdb
import pytest

from lumenloom.plans import registry

SF = "/root/testdata/sf0.001"
SHIFTS = (0, 65_535 - 40, 65_536 * 3 - 40, 4_000_000_000)


def shifted(con, folder, table, keys):
    """The table once for each shift of its keys, as a file and as a view."""
    moved = ", ".join(f"{k} + s AS {k}" for k in keys)
    con.execute(f"COPY (SELECT t.* REPLACE ({moved}) FROM '{SF}/{table}.parquet' t, (SELECT unnest({list(SHIFTS)}) AS s)) TO '{folder}/{table}.parquet'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")


@pytest.mark.parametrize(("name", "table", "keys"), [("nvme_health", "lineitem", ("l_orderkey", "l_partkey", "l_suppkey")), ("ipv6_text", "orders", ("o_orderkey", "o_custkey"))])
def test_large_keys(spark, tmp_path, name, table, keys):
    con = duckdb.connect()
    shifted(con, tmp_path, table, keys)
    df = registry.QUERIES[name](spark, str(tmp_path))
    want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall(), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want
