"""Queries over tables in which one user and one nation have all rows: same results, and no group gathered in one row."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenloom.plans import registry
from lumenloom.sources import aws, devices
from tests.test_queries import plain

SF = "/root/testdata/sf0.01"
READERS = {
    "pool_tables": (devices, ["newest_txg", "kstat_table"]),
    "picked_counters": (devices, ["picked_statistics"]),
    "subscriptions": (aws, ["subscription_events"]),
    "openvpn": (devices, ["openvpn_rows"]),
    "process_lifetime": (devices, []),
    "steady": (devices, []),
}


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("hot"))
    spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.lit(5).cast("long")).withColumn("ts", F.expr("CASE WHEN event_id % 3 = 0 THEN ts ELSE date_trunc('month', ts) + make_interval(0, 0, 0, 0, pmod(event_id, 30)) END").cast(spark.read.parquet(f"{SF}/events.parquet").schema["ts"].dataType)).write.parquet(f"{d}/events.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").withColumn("c_nationkey", F.lit(2).cast("int")).write.parquet(f"{d}/customer.parquet")
    return d


@pytest.mark.parametrize("name", READERS)
def test_one_key_with_all_rows(spark, hot, monkeypatch, name):
    module, readers = READERS[name]
    most = []
    for r in readers:

        def watched(df, *a, f=getattr(module, r), **b):
            c = df.columns[-1]
            size = F.size(c) if dict(df.dtypes)[c].startswith("map") else F.size(F.split(c, "\n|[{]\"id\""))
            most.append(df.agg(F.max(size)).first()[0])
            return f(df, *a, **b)

        monkeypatch.setattr(module, r, watched)
    df = registry.QUERIES[name](spark, hot)
    assert len(most) == len(readers) and all(0 < n < 2100 for n in most)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert (name != "process_lifetime" or "collect_list" not in plan) and not re.search(r"Window \[min.*\], \[user_id#\d+L?\], ", plan)
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{hot}/{t}.parquet/*.parquet'")
    cols = sorted(df.columns)
    found = con.execute(registry.ORACLES[name])
    names = [x[0] for x in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want
