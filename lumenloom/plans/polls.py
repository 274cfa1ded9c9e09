"""Polled services and nested bodies: written responses read back window by window, addresses in documents of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import maps
from lumenloom.operators import enrich
from lumenloom.plans.common import DAY, EVENTS, events, table
from lumenloom.sources import devices, polled
from lumenloom.sources.tables import scratch

#: From when to when the events are polled, in days from 2024-01-01.
SINCE_US, UNTIL_US, SETTLE_S = 1_704_412_800_000_000, 1_705_276_800_000_000, 3600


def write_responses(ev: DataFrame, path: str) -> None:
    """The events as pages of responses, one per user, kind and day: some events twice, some without an id."""
    event = F.struct((F.col("at_us") / 1000).cast("long").alias("timestamp"), F.when(F.col("event_id") % 17 != 0, F.col("event_id").cast("string")).alias("eventId"), F.concat(F.lit("s"), "user_id").alias("logStreamName"), F.concat(F.lit("said "), "event_type").alias("message"))
    again = ev.withColumn("twice", F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 5 == 0, 1).otherwise(0))))
    target = {"account": F.concat(F.lit("a"), F.col("user_id") % 2), "region": F.lit("eu-1"), "log_group": F.concat(F.lit("/aws/g"), F.col("user_id") % 3)}
    page = again.groupBy(*[c.alias(k) for k, c in target.items()], F.floor(F.col("at_us") / DAY), "event_type", "user_id").agg(F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("value"))
    page.select("value", *target).write.partitionBy(*target).text(path)


def polled_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the table polled from written responses in windows of a day: ten days and the hours of the first."""
    path = scratch(spark)
    write_responses(events(spark, sf_dir), path)
    polled.register(spark)
    read = spark.read.format("polled").options(path=path, since_us=SINCE_US + DAY // 4, until_us=UNTIL_US + SETTLE_S * 1_000_000, delay_s=SETTLE_S, period_s=DAY // 1_000_000, catchup_s=100 * DAY // 1_000_000)
    return read.load().select("account", "region", "log_group", "log_stream", F.col("event_id").cast("long").alias("event_id"), "ts_us", "message")


POLLED_LOGS = f"""
SELECT 'a' || user_id % 2 AS account, 'eu-1' AS region, '/aws/g' || user_id % 3 AS log_group, 's' || user_id AS log_stream, event_id, at_us // 1000 * 1000 AS ts_us, 'said ' || event_type AS message
FROM {EVENTS} WHERE event_id % 17 <> 0 AND at_us // 1000 * 1000 >= {SINCE_US + DAY // 4} AND at_us // 1000 * 1000 < {UNTIL_US}
"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: texts, objects and lists mixed and nested three deep; keys, numbers and local addresses do not count."""
    k = F.col("o_orderkey")
    ip = lambda a, n: F.concat(F.lit(f"10.{a}."), k % 7, F.lit("."), k % n)
    deep = F.to_json(F.struct(
        F.concat(F.lit('from "'), ip(1, 250), F.lit('"\n')).alias("first"),
        F.struct(F.array(F.struct(ip(2, 3).alias("in"), F.array(ip(1, 250), F.lit("127.0.0.1")).alias("list")), F.struct(F.concat(F.lit("to "), ip(3, 5)).alias("in"), F.array(F.lit("a:b")).alias("list"))).alias("hops"), k.alias("10.8.8.8")).alias("route"),
        F.lit(True).alias("ok"), F.lit("é \\ end").alias("note"),
    ))
    listed = F.concat(F.lit(' ["'), ip(4, 9), F.lit('", ["x", {"y" : "'), ip(5, 2), F.lit('"}], null, 7]'))
    body = F.when(k % 4 == 0, deep).when(k % 4 == 1, listed).when(k % 4 == 2, F.concat(F.lit("{peer "), ip(6, 9))).otherwise(F.lit("none here"))
    attributes = maps.of({"peer": F.concat(F.lit('{"a":{"b":"'), ip(7, 4), F.lit('"}}')), "other": ip(8, 4), "mac": F.when(k % 3 == 0, F.lit('["AA-BB-CC-DD-EE-0F",{"m":"aabb.ccdd.ee0f"},"00:11:22:33:44:55"]'))})
    return table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"), attributes.alias("attributes"))


def nested_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All addresses of bodies and one attribute, the first of the body alone, and hardware addresses of another attribute."""
    df = enrich.address_attribute(_orders(spark, sf_dir), "ips", attributes=["peer"])
    df = enrich.address_attribute(df, "first_ip", first_only=True)
    df = enrich.address_attribute(df, "macs", enrich.macs_in, body=False, attributes=["mac", "missing"])
    return df.select("o_orderkey", *[F.col("attributes")[c].alias(c) for c in ("ips", "first_ip", "macs")])


NESTED_ADDRESSES = """
WITH k AS (SELECT o_orderkey, '.' || o_orderkey % 7 || '.' AS m, o_orderkey AS o FROM orders), f AS (
  SELECT o_orderkey, o, CASE o % 4
    WHEN 0 THEN ['10.1' || m || o % 250, '10.2' || m || o % 3, '10.3' || m || o % 5]
    WHEN 1 THEN ['10.4' || m || o % 9, '10.5' || m || o % 2]
    WHEN 2 THEN ['10.6' || m || o % 9] ELSE []::VARCHAR[] END AS body, '10.7' || m || o % 4 AS peer FROM k)
SELECT o_orderkey, array_to_string(list_append(body, peer), ',') AS ips, body[1] AS first_ip, CASE WHEN o % 3 = 0 THEN 'aa:bb:cc:dd:ee:0f,00:11:22:33:44:55' END AS macs FROM f
"""

def flow_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of all versions, of which some have both fields of milliseconds, one, one out of the calendar, or no field of time at all."""
    e = events(spark, sf_dir)
    k, ms = F.col("event_id") % 6, (F.col("at_us") / 1000).cast("long")
    flows = e.select(
        "event_id", (F.col("event_id") % 5).cast("int").alias("flow_type"), (F.col("at_us") * 1000).alias("start_ns"), (F.col("at_us") * 1000 + 7).alias("end_ns"),
        F.when(k.isin(0, 1), ms).when(k == 2, F.lit(5).cast("long")).alias("start_ms"), F.when(k.isin(0, 3), ms + 250).alias("end_ms"),
        F.when(k == 4, F.col("user_id")).alias("first_switched"), F.lit(None).cast("long").alias("last_switched"),
    )
    return devices.absolute_times(flows).select("event_id", "flow_type", "start_ns", "end_ns")


FLOW_TIMES = f"""
SELECT event_id, CAST(event_id % 5 AS INTEGER) AS flow_type,
       CASE WHEN event_id % 5 <> 3 THEN at_us * 1000 WHEN event_id % 6 IN (0, 1) THEN at_us // 1000 * 1000000 WHEN event_id % 6 IN (2, 5) THEN 0 ELSE at_us * 1000 END AS start_ns,
       CASE WHEN event_id % 5 <> 3 THEN at_us * 1000 + 7 WHEN event_id % 6 IN (0, 3) THEN (at_us // 1000 + 250) * 1000000 WHEN event_id % 6 = 5 THEN 0 ELSE at_us * 1000 + 7 END AS end_ns
FROM {EVENTS}
"""

QUERIES = {"flow_times": flow_times, "polled_logs": polled_logs, "nested_addresses": nested_addresses}
ORACLES = {"flow_times": FLOW_TIMES, "polled_logs": POLLED_LOGS, "nested_addresses": NESTED_ADDRESSES}
