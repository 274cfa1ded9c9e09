"""Operators of smaller parts: routing by the catalogue, late points, tags, digests, snapshots, decoders, metric calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators import enrich, filters, hardware, timeseries, windowhist
from lumenloom.plans.common import DAY, EVENTS, events, table
from lumenloom.plans.records import _flows, _maps
from lumenloom.sinks import flowlog
from lumenloom.sources import aws, cloud, devices

HOUR = DAY // 24
_NAMES = ("system.cpu.utilization", "system.disk.io", "process.threads", "my.own.metric")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a gauge, a counter, a plain value and a metric of no group, per event type."""
    e = events(spark, sf_dir).withColumn("metric", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 4 + 1).cast("int")))
    return e.select("event_id", "event_type", "at_us", "metric", F.when(F.col("metric") == "system.disk.io", F.col("event_id")).otherwise(F.col("cents")).alias("v"))


_NAMED = f"(SELECT event_id, event_type, at_us, ['{"', '".join(_NAMES)}'][event_id % 4 + 1] AS metric, CASE WHEN event_id % 4 = 1 THEN event_id ELSE cents END AS v FROM {EVENTS})"


def catalogue_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point with its group and mode."""
    return windowhist.routed(_named(spark, sf_dir)).select("event_id", "metric", "group", "mode")


CATALOGUE_ROUTES = f"SELECT event_id, metric, CASE event_id % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'disk_io_rate' WHEN 2 THEN 'process' END AS \"group\", CASE event_id % 4 WHEN 0 THEN 'histogram' WHEN 1 THEN 'histogram' WHEN 2 THEN 'last' END AS mode FROM {_NAMED}"


def catalogue_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of point becomes: histograms (of rates for the counter), last values, kept counters, points that pass."""
    out = windowhist.summaries(_named(spark, sf_dir), ["event_type"], "at_us", "event_id", "v", keep_counter=True)
    one = lambda kind, n, v: out[kind].select(F.lit(kind).alias("kind"), "metric", "event_type", F.col("window_us" if kind != "rest" else "at_us").alias("us"), n.cast("long").alias("n"), F.round(v.cast("double"), 6).alias("v"))
    return one("histogram", F.col("count"), F.col("sum")).unionByName(one("last", F.lit(1), F.col("v"))).unionByName(one("counter", F.lit(1), F.col("v"))).unionByName(one("rest", F.lit(1), F.col("v")))


CATALOGUE_WINDOWS = f"""
WITH p AS (SELECT *, at_us // {DAY} * {DAY} AS w, CASE WHEN metric = 'system.disk.io' THEN CASE WHEN v >= lag(v) OVER o AND at_us > lag(at_us) OVER o THEN (v - lag(v) OVER o) / ((at_us - lag(at_us) OVER o) / 1e6) END ELSE v END AS x FROM {_NAMED} WINDOW o AS (PARTITION BY metric, event_type ORDER BY at_us, event_id))
SELECT 'histogram' AS kind, metric, event_type, w AS us, count(x) AS n, round(CAST(sum(x) AS DOUBLE), 6) AS v FROM p WHERE metric IN ('system.cpu.utilization', 'system.disk.io') AND x IS NOT NULL GROUP BY 2, 3, 4
UNION ALL SELECT CASE WHEN metric = 'process.threads' THEN 'last' ELSE 'counter' END, metric, event_type, w, 1, CAST(arg_max(v, (at_us, event_id)) AS DOUBLE) FROM p WHERE metric IN ('process.threads', 'system.disk.io') GROUP BY 2, 3, 4
UNION ALL SELECT 'rest', metric, event_type, at_us, 1, CAST(v AS DOUBLE) FROM p WHERE metric = 'my.own.metric'
"""


def late_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points seen up to three hours after their time, without those older than the window before."""
    e = events(spark, sf_dir).withColumn("seen_us", F.col("at_us") + F.col("event_id") % 4 * HOUR)
    return windowhist.drop_late(e, "at_us", "seen_us", HOUR).select("event_id", "seen_us")


LATE_POINTS = f"SELECT event_id, at_us + event_id % 4 * {HOUR} AS seen_us FROM {EVENTS} WHERE at_us >= (at_us + event_id % 4 * {HOUR}) // {HOUR} * {HOUR} - {HOUR}"


def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 rows with the largest values of all, a cap in order."""
    return timeseries.sorted_cap(events(spark, sf_dir), [F.desc("cents"), "event_id"], 40).select("event_id", "cents")


TOP_ROWS = f"SELECT event_id, cents FROM {EVENTS} ORDER BY cents DESC, event_id LIMIT 40"


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version on each resource, and the tags of activity logs."""
    e = _maps(events(spark, sf_dir).select("event_id", "user_id"), {"log.source": "if(event_id % 2 = 0, 'x', null)"}, {"collector.version": "if(event_id % 3 = 0, 'old', null)", "host.name": "concat('h', user_id)"})
    out = enrich.azure_source_tags(enrich.stamped(e, "1.2"))
    a, r = F.col("attributes"), F.col("resource")
    return out.select("event_id", a["log.source"].alias("source"), a["event.category"].alias("category"), r["cloud.provider"].alias("provider"), r["collector.version"].alias("version"), r["host.name"].alias("host"))


STAMPS = f"SELECT event_id, 'azure.activity' AS source, 'audit' AS category, 'azure' AS provider, '1.2' AS version, 'h' || user_id AS host FROM {EVENTS}"


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two kinds dropped, unless they tell of a failure."""
    line = F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 5 == 0, "FAILED"), F.col("event_id").cast("string"))
    return filters.drop_noise(events(spark, sf_dir).select("event_id", line.alias("body")), ["view", "click "]).select("event_id", "body")


NOISE = f"SELECT event_id, event_type || CASE WHEN event_id % 5 = 0 THEN ' FAILED ' ELSE ' ' END || event_id AS body FROM {EVENTS} WHERE event_type NOT IN ('view', 'click') OR event_id % 5 = 0"


def filled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the flow table that these flows fill."""
    flows = devices.folded(_flows(spark, sf_dir))
    found = flowlog.used_columns(flowlog.flow_rows(flows, fields=devices.flow_fields(flows)))
    return spark.createDataFrame([(c,) for c in found], "name string")


FILLED_COLUMNS = """
SELECT unnest(['cloud', 'exporter', 'input_interface', 'output_interface', 'srcaddr', 'dstaddr', 'srcport', 'dstport', 'protocol', 'packets', 'bytes', 'sampling_rate', 'dscp', 'src_asn', 'start_time', 'end_time', 'action', 'flow_type', 'received_at', 'ip_version']) AS name
"""


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest documents of two files each, exploded; one of three lists none."""
    file = lambda k: f"'{{\"s3Bucket\":\"b', user_id, '\",\"s3Object\":\"o{k}-', event_id, '\",\"hashValue\":\"h{k}\"}}'"
    doc = f"concat('{{\"awsAccountId\":\"', user_id, '\",\"digestS3Object\":\"d', event_id, '\",\"logFiles\":[', if(event_id % 3 = 0, '', concat({file(1)}, ',', {file(2)})), ']}}')"
    out = aws.trail_digests(events(spark, sf_dir).select(F.expr(doc).alias("value")))
    return out.select("account_id", "digest", F.col("n_files").cast("long").alias("n_files"), F.col("s3Object").alias("object"), F.col("hashValue").alias("hash"))


DIGESTS = f"""
SELECT user_id::VARCHAR AS account_id, 'd' || event_id AS digest, CAST(0 AS BIGINT) AS n_files, NULL AS object, NULL AS hash FROM {EVENTS} WHERE event_id % 3 = 0
UNION ALL SELECT user_id::VARCHAR, 'd' || event_id, 2, 'o' || k || '-' || event_id, 'h' || k FROM {EVENTS}, (VALUES (1), (2)) f(k) WHERE event_id % 3 <> 0
"""


def guest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of guests where they change; the value is a sorted list of addresses."""
    e = events(spark, sf_dir)
    value = cloud.address_list(F.array(F.concat(F.lit("10.0.0."), F.col("event_id") % 3), F.concat(F.lit("10.0.0."), F.col("event_id") % 2), F.lit("10.0.0.1")))
    facts = e.select((F.col("user_id") % 50).alias("vmid"), F.lit("ips").alias("fact"), F.col("at_us").alias("ts_us"), F.col("event_id").alias("seq"), value.alias("value"))
    return cloud.guest_changes(facts).select("vmid", "seq", "value", "previous_value")


GUEST_FACTS = f"""
WITH f AS (SELECT user_id % 50 AS vmid, event_id AS seq, at_us, array_to_string(list_sort(list_distinct(['10.0.0.' || event_id % 3, '10.0.0.' || event_id % 2, '10.0.0.1'])), ',') AS value FROM {EVENTS}),
l AS (SELECT vmid, seq, value, lag(value) OVER (PARTITION BY vmid ORDER BY at_us, seq) AS previous_value FROM f)
SELECT * FROM l WHERE previous_value IS DISTINCT FROM value
"""


def fresh_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status files read twice: only rows of snapshots not seen before."""
    c = table(spark, sf_dir, "customer")
    row = F.concat_ws(",", F.lit("CLIENT_LIST"), F.concat(F.lit("u"), "c_custkey"), F.lit("10.0.0.1:5"), F.lit("v"), F.lit("1"), F.lit("2"), F.lit("2026-06-18 08:12:15"), F.lit("1"), F.lit("UNDEF"))
    text = F.concat(F.lit("TITLE,V\nTIME,"), F.concat(F.lit("t"), F.col("c_custkey") % 7), F.lit(",1\nHEADER,CLIENT_LIST,x\n"), row, F.lit("\nEND"))
    rows = devices.openvpn_rows(c.select(F.concat(F.lit("f"), F.col("c_custkey") % 5).alias("path"), text.alias("value")))
    seen = rows.where("snapshot IN ('t0', 't3')").select("path", "snapshot")
    return devices.new_snapshots(rows, seen).select("name", "path", "snapshot", "since_us")


FRESH_SNAPSHOTS = "SELECT 'u' || c_custkey AS name, 'f' || c_custkey % 5 AS path, 't' || c_custkey % 7 AS snapshot, 1781770335000000 AS since_us FROM customer WHERE c_custkey % 7 NOT IN (0, 3)"


def pool_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a pool's leaf devices; a mirror's own counts are not added again."""
    li = table(spark, sf_dir, "lineitem")
    v = li.select(F.col("l_suppkey").alias("pool"), (F.col("l_linenumber") != 1).alias("is_leaf"), F.col("l_linenumber").alias("read_errors"), (F.col("l_orderkey") % 3).alias("write_errors"), F.lit(1).alias("checksum_errors"))
    return devices.leaf_errors(v, ["pool"])


POOL_ERRORS = "SELECT l_suppkey AS pool, CAST(sum(l_linenumber) AS BIGINT) AS read_errors, CAST(sum(l_orderkey % 3) AS BIGINT) AS write_errors, count(*) AS checksum_errors FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1"


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit, linear and exponential buckets; those of a width or growth that makes no sense are left out."""
    buckets = "elt(cast(event_id % 5 as int) + 1, '{\"explicitBuckets\":{\"bounds\":[1,2.5]}}', '{\"linearBuckets\":{\"numFiniteBuckets\":2,\"offset\":1,\"width\":2}}', '{\"exponentialBuckets\":{\"numFiniteBuckets\":2,\"scale\":1,\"growthFactor\":3}}', '{\"linearBuckets\":{\"numFiniteBuckets\":2,\"offset\":1,\"width\":0}}', '{\"exponentialBuckets\":{\"numFiniteBuckets\":2,\"scale\":1,\"growthFactor\":1}}')"
    doc = f"concat('{{\"metric\":{{\"type\":\"m\",\"labels\":{{\"l\":\"', event_id, '\"}}}},\"points\":[{{\"interval\":{{\"endTime\":\"2026-01-01T00:00:00Z\"}},\"value\":{{\"distributionValue\":{{\"count\":\"', user_id, '\",\"mean\":1.5,\"bucketOptions\":', {buckets}, ',\"bucketCounts\":[\"', user_id, '\"]}}}}}}]}}')"
    out = cloud.distribution_points(events(spark, sf_dir).select(F.expr(doc).alias("value")))
    return out.select(F.col("attributes")["l"].cast("long").alias("event_id"), "count", "sum", F.array_join(F.transform("bounds", lambda b: F.round(b, 3).cast("string")), " ").alias("bounds"), F.array_join(F.col("counts").cast("array<string>"), " ").alias("counts"), "ts_us")


DISTRIBUTIONS = f"""
SELECT event_id, user_id AS count, user_id * 1.5::DOUBLE AS sum, CASE event_id % 5 WHEN 0 THEN '1.0 2.5' WHEN 1 THEN '1.0 3.0 5.0' ELSE '1.0 3.0 9.0' END AS bounds,
user_id || CASE event_id % 5 WHEN 0 THEN ' 0 0' ELSE ' 0 0 0' END AS counts, 1767225600000000 AS ts_us FROM {EVENTS} WHERE event_id % 5 < 3
"""


def metric_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of series and statistics dealt over calls of at most 40; how many calls and queries each group has."""
    s = events(spark, sf_dir).select((F.col("user_id") % 3).alias("account"), F.col("event_type").alias("region"), F.lit("slow").alias("tier"), F.lit("AWS/X").alias("namespace"), F.concat(F.lit("m"), F.col("event_id") % 90).alias("name"), F.col("user_id").cast("string").alias("dimensions")).distinct()
    calls = cloud.query_calls(s, ["Average", "Sum", "p90"], per_call=40, at_once=1_000_000)
    each = calls.groupBy("account", "region", "call").agg(F.count("*").alias("n"))
    return each.groupBy("account", "region").agg(F.count("*").alias("calls"), F.sum("n").alias("queries"), F.max("n").alias("most"))


METRIC_CALLS = f"""
SELECT account, region, CAST(ceil(q / 40.0) AS BIGINT) AS calls, q AS queries, least(q, 40) AS most FROM (SELECT user_id % 3 AS account, event_type AS region, 3 * count(DISTINCT (event_id % 90, user_id)) AS q FROM {EVENTS} GROUP BY 1, 2)
"""


def metric_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points read by two overlapping windows, once each."""
    e = events(spark, sf_dir)
    p = lambda shift: e.select(F.lit("a").alias("account"), F.lit("r").alias("region"), F.lit("AWS/X").alias("namespace"), F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("dimensions"), F.lit("Sum").alias("stat"), F.col("at_us").alias("ts_us"), (F.col("at_us") + shift).alias("read_us"), (F.col("cents") + shift).cast("double").alias("value"))
    return cloud.metric_gauges(p(1).unionByName(p(2).where("dimensions LIKE '%7'"))).groupBy("metric", "dimensions").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


METRIC_GAUGES = f"""
WITH p AS (SELECT event_type, user_id, at_us, max(cents) + CASE WHEN user_id % 10 = 7 THEN 2 ELSE 1 END AS v FROM {EVENTS} GROUP BY 1, 2, 3)
SELECT 'amazonaws.com/AWS/X/' || event_type AS metric, user_id::VARCHAR AS dimensions, count(*) AS n, CAST(sum(v) AS DOUBLE) AS value FROM p GROUP BY 1, 2
"""


def _byte(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))


def _zeros(n: int) -> Column:
    return F.unhex(F.lit("00" * n))


def smart_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute tables with two used entries, of which one has a threshold."""
    e = events(spark, sf_dir).select("event_id", (F.col("user_id") % 256).alias("u"))
    raw = F.unhex(F.concat(*[F.substr(F.lpad(F.hex("event_id"), 12, "0"), F.lit(11 - 2 * i), F.lit(2)) for i in range(6)]))
    entry = lambda i, u: F.concat(_byte(F.lit(i)), F.unhex(F.lit("0300")), _byte(u), _byte(F.lit(90)), raw, _zeros(1))
    data = F.concat(_zeros(2), entry(5, F.col("u")), _zeros(12), entry(194, F.lit(7)), _zeros(512 - 38))
    limits = F.concat(_zeros(2), _byte(F.lit(5)), _byte(F.lit(36)), _zeros(508))
    pages = e.select("event_id", F.when(F.col("event_id") % 9 == 0, _zeros(10)).otherwise(data).alias("data"), limits.alias("thresholds"))
    return hardware.smart_attributes(pages, ["event_id"])


SMART_TABLE = f"""
SELECT event_id, CAST(id AS BIGINT) AS id, CAST(3 AS BIGINT) AS flags, CASE WHEN id = 5 THEN user_id % 256 ELSE 7 END AS value, CAST(90 AS BIGINT) AS worst, CASE WHEN id = 5 THEN CAST(36 AS BIGINT) END AS threshold, event_id AS raw
FROM {EVENTS}, (VALUES (5), (194)) i(id) WHERE event_id % 9 <> 0
"""


def log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log pages built from events: error counters of several widths, one page cut in reading, temperature, cycles, exceptions, and a page that says too little of its length."""
    e = events(spark, sf_dir).select("event_id", "user_id")
    wide = lambda c, n: F.unhex(F.lpad(F.hex(F.col(c)), 2 * n, "0"))
    parameter = lambda code, data: F.concat(F.unhex(F.lit(f"{code:04X}02")), _byte(F.octet_length(data)), data)
    paged = lambda code, body, less=0: F.concat(F.unhex(F.lit(f"{code:02X}00")), F.unhex(F.lpad(F.hex(F.octet_length(body) - less), 4, "0")), body)
    width = F.when(F.col("event_id") % 5 == 0, wide("event_id", 4)).otherwise(wide("event_id", 8))
    errors = paged(3, F.concat(parameter(0, F.unhex(F.lit("0A0B0C"))), parameter(3, width), parameter(6, wide("user_id", 4))))
    kinds = [
        errors,
        F.substr(errors, F.lit(1), F.octet_length(errors) - 3),
        paged(13, F.concat(parameter(0, F.concat(_zeros(1), _byte(F.col("user_id") % 256))), parameter(1, F.unhex(F.lit("0041"))))),
        paged(14, F.concat(parameter(1, _zeros(6)), parameter(4, wide("event_id", 4)))),
        paged(47, parameter(0, F.concat(_byte(F.when(F.col("user_id") % 2 == 0, 93).otherwise(11)), _byte(F.col("user_id") % 100), _byte(F.lit(255))))),
        paged(14, parameter(4, wide("event_id", 4)), 2),
    ]
    page = F.get(F.array(*kinds), (F.col("event_id") % 6).cast("int"))
    out = hardware.log_pages(e.select("event_id", page.alias("page"))).drop("page")
    return out.select("event_id", *[F.col(c).cast("string").alias(c) for c in out.columns if c != "event_id"])


LOG_PAGES = f"""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN '3' WHEN 1 THEN '3' WHEN 2 THEN '13' WHEN 3 THEN '14' WHEN 4 THEN '47' END AS page_code,
CASE WHEN event_id % 6 < 2 THEN 'read' END AS operation, CASE WHEN event_id % 6 < 2 THEN event_id::VARCHAR END AS corrected, CASE WHEN event_id % 6 = 0 THEN user_id::VARCHAR END AS uncorrected,
CASE WHEN event_id % 6 = 2 AND user_id % 256 <> 255 THEN (user_id % 256)::VARCHAR END AS celsius, CASE WHEN event_id % 6 = 3 THEN event_id::VARCHAR END AS cycles,
CASE WHEN event_id % 6 = 4 THEN CASE WHEN user_id % 2 = 0 THEN '93' ELSE '11' END END AS sense, CASE WHEN event_id % 6 = 4 THEN (user_id % 100)::VARCHAR END AS qualifier,
CASE WHEN event_id % 6 = 4 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END END AS predicted_failure FROM {EVENTS}
"""


def disk_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDENTIFY pages built from keys: texts with swapped bytes, sizes of 48 bits, names."""
    e = events(spark, sf_dir).select("event_id", F.rpad(F.concat(F.lit("M"), "event_id"), 40, " ").alias("m"), F.rpad(F.concat(F.lit("S"), "user_id"), 20, " ").alias("s"))
    swapped = lambda c, n: F.concat(*[F.substring(c, i + k, 1) for i in range(1, n, 2) for k in (1, 0)]).cast("binary")
    le = lambda c, n: F.unhex(F.concat(*[F.substr(F.lpad(F.hex(c), 2 * n, "0"), F.lit(2 * n - 1 - 2 * i), F.lit(2)) for i in range(n)]))
    at: dict[int, tuple[int, Column]] = {20: (20, swapped("s", 20)), 46: (8, F.lit("1F.w    ").cast("binary")), 54: (40, swapped("m", 40)), 120: (4, F.unhex(F.lit("01000000"))), 166: (2, F.unhex(F.lit("0004"))), 174: (2, F.unhex(F.lit("0041"))), 200: (8, le(F.col("event_id"), 8)), 216: (8, F.unhex(F.lit("0050010002000300"))), 434: (2, F.unhex(F.lit("201C")))}
    parts, here = [], 0
    for start, (size, value) in sorted(at.items()):
        parts += [_zeros(start - here), value]
        here = start + size
    out = hardware.ata_identity(e.select("event_id", F.concat(*parts, _zeros(512 - here)).alias("page")))
    return out.select("event_id", "model", "serial", "firmware", "rotation_rate", "size_bytes", "wwn")


DISK_IDENTITIES = f"SELECT event_id, 'M' || event_id AS model, 'S' || user_id AS serial, 'F1w.' AS firmware, CAST(7200 AS BIGINT) AS rotation_rate, event_id * 512 AS size_bytes, '5000000100020003' AS wwn FROM {EVENTS}"


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of power supplies by their sensors' asserted offsets."""
    offsets = F.filter(F.array(F.when(F.col("event_id") % 2 == 0, 0), F.when(F.col("event_id") % 3 == 0, 1), F.when(F.col("event_id") % 5 == 0, 2), F.when(F.col("event_id") % 7 == 0, 6)), lambda x: x.isNotNull())
    return events(spark, sf_dir).select("event_id", hardware.power_supply_state(offsets).alias("state"))


SUPPLIES = f"SELECT event_id, CASE WHEN event_id % 2 = 1 THEN NULL WHEN event_id % 3 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'predicted_failure' WHEN event_id % 7 = 0 THEN 'degraded' ELSE 'ok' END AS state FROM {EVENTS}"


def unit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with a product area: text, digits and six-bit fields; areas with a bad checksum give nothing."""
    e = events(spark, sf_dir).select("event_id", F.lpad(F.col("event_id").cast("string"), 10, "0").alias("t"))
    field = lambda kind, raw, n: F.concat(F.unhex(F.lit(f"{kind << 6 | n:02X}")), raw)
    # "IPMI" in six-bit characters is 29 DC A6 by the format's own example.
    body = F.concat(F.unhex(F.lit("010600")), field(3, F.col("t").cast("binary"), 10), field(2, F.unhex(F.lit("29DCA6")), 3), field(1, F.unhex(F.col("t")), 5), field(0, F.unhex(F.lit("0AFF")), 2), F.unhex(F.lit("C1")), _zeros(19))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.octet_length(body)), lambda i: F.conv(F.hex(F.substr(body, i, F.lit(1))), 16, 10).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    check = F.pmod(F.lit(256) - F.pmod(total, F.lit(256)) + F.when(F.col("event_id") % 4 == 0, 1).otherwise(0), F.lit(256))
    image = F.concat(F.unhex(F.lit("01000000010000FE")), body, _byte(check))
    return hardware.unit_records(e.select("event_id", image.alias("image")), ["event_id"])


UNIT_RECORDS = f"""
SELECT event_id, 'product' AS area, k AS key, CASE k WHEN 'vendor' THEN lpad(event_id::VARCHAR, 10, '0') WHEN 'model' THEN 'IPMI' WHEN 'part_number' THEN lpad(event_id::VARCHAR, 10, '0') ELSE '0aff' END AS value
FROM {EVENTS}, (VALUES ('vendor'), ('model'), ('part_number'), ('version')) f(k) WHERE event_id % 4 <> 0
"""


def firmware_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory facts without placeholders; those that say nothing but their id are left out."""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % len(v) + 1).cast("int"))
    a = F.create_map(F.lit("hw.id"), F.col("event_id").cast("string"), F.lit("vendor"), pick("Acme \x01", "To Be Filled By O.E.M.", "XXXX", "0000"), F.lit("serial"), pick("N/A", "S1", "-----", "Default string", "  "))
    out = hardware.inventory_points(events(spark, sf_dir).select("event_id", a.alias("attributes")), ["event_id"])
    return out.select("event_id", F.col("attributes")["vendor"].alias("vendor"), F.col("attributes")["serial"].alias("serial"), "value")


FIRMWARE_FACTS = f"""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Acme' END AS vendor, CASE WHEN event_id % 5 = 1 THEN 'S1' END AS serial, CAST(1 AS BIGINT) AS value FROM {EVENTS} WHERE event_id % 4 = 0 OR event_id % 5 = 1
"""

_ALL = {
    "catalogue_routes": CATALOGUE_ROUTES, "catalogue_windows": CATALOGUE_WINDOWS, "late_points": LATE_POINTS, "top_rows": TOP_ROWS, "stamps": STAMPS, "noise": NOISE, "filled_columns": FILLED_COLUMNS, "digests": DIGESTS,
    "guest_facts": GUEST_FACTS, "fresh_snapshots": FRESH_SNAPSHOTS, "pool_errors": POOL_ERRORS, "distributions": DISTRIBUTIONS, "metric_calls": METRIC_CALLS, "metric_gauges": METRIC_GAUGES, "smart_table": SMART_TABLE, "log_pages": LOG_PAGES,
    "disk_identities": DISK_IDENTITIES, "supplies": SUPPLIES, "unit_records": UNIT_RECORDS, "firmware_facts": FIRMWARE_FACTS,
}
QUERIES = {n: globals()[n] for n in _ALL}
ORACLES = dict(_ALL)
