"""Documents that link to others, built from orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.plans.common import table
from lumenloom.sources import storage


def storage_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hosts, orders as storages, lines as drives, a volume for each order; some are linked but not there, some absent, some held in the list."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("host"), F.col("o_orderkey").alias("k"), "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")).repartition("k").groupBy("k", "n").agg(F.max("part").alias("part"))
    link = lambda path: f"concat('{{\"@odata.id\":\"', {path}, '\"}}')"
    roots = o.groupBy("host").agg(F.expr(f"array_join(collect_list({link('concat(\'/s/\', k)')}), ',')").alias("m")).selectExpr("host", "'/s' AS path", "concat('{\"Members\":[', m, ']}') AS value")
    held = "concat('{\"Id\":\"', n, '\",\"Status\":{\"Health\":\"OK\"},\"CapacityBytes\":', part, '}')"
    drives = lines.groupBy("k").agg(F.expr(f"array_join(collect_list(if(n = 2, {held}, {link('concat(\'/s/\', k, \'/Drives/\', n)')})), ',')").alias("d"))
    body = f"concat('{{\"Id\":\"', k, '\",', if(o_orderstatus = 'P', '', '\"Status\":{{\"Health\":\"OK\"}},'), '\"Drives\":[', coalesce(d, ''), '],\"Volumes\":', {link('concat(\'/s/\', k, \'/V\')')}, '}}')"
    storages = o.join(drives, "k", "left").where("k % 7 <> 0").selectExpr("host", "concat('/s/', k) AS path", f"{body} AS value")
    drive = "concat('{\"Status\":{\"Health\":\"', CASE n WHEN 5 THEN 'Warning' WHEN 6 THEN 'Critical' ELSE 'OK' END, if(n = 4, '\",\"State\":\"Absent', ''), '\"},\"CapacityBytes\":', part, '}')"
    own = lines.where("n NOT IN (2, 3)").join(o, "k").selectExpr("host", "concat('/s/', k, '/Drives/', n) AS path", f"{drive} AS value")
    volumes = o.selectExpr("host", "concat('/s/', k, '/V') AS path", f"concat('{{\"Members\":[', {link('concat(\'/s/\', k, \'/V/1?x=1\')')}, ']}}') AS value")
    volume = o.selectExpr("host", "concat('/s/', k, '/V/1') AS path", "'{\"Id\":\"1\",\"RAIDType\":\"RAID1\",\"Status\":{\"Health\":\"OK\"},\"CapacityBytes\":1000}' AS value")
    documents = roots.unionByName(storages).unionByName(own).unionByName(volumes).unionByName(volume)
    return storage.storage_health(storage.storage_parts(documents, "/s"))


STORAGE_DOCUMENTS = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
d AS (SELECT k, count(*) FILTER (n NOT IN (3, 4)) AS parts, count(*) FILTER (n = 3) AS missing, sum(part) FILTER (n NOT IN (3, 4)) AS bytes, max(CASE n WHEN 6 THEN 2 WHEN 5 THEN 1 ELSE 0 END) AS rank FROM l GROUP BY 1)
SELECT o_custkey::VARCHAR AS host, o_orderkey::VARCHAR AS storage, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 + coalesce(parts, 0) END AS n_parts, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE coalesce(missing, 0) END AS n_missing,
CASE WHEN o_orderkey % 7 <> 0 THEN bytes::DOUBLE END AS drive_bytes, CASE WHEN o_orderkey % 7 <> 0 THEN CASE rank WHEN 2 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'ok' END END AS worst
FROM orders LEFT JOIN d ON k = o_orderkey
"""

QUERIES = {"storage_documents": storage_documents}
ORACLES = {"storage_documents": STORAGE_DOCUMENTS}
