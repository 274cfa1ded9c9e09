"""File formats and status texts, built from table columns and read back; polls and sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.plans.common import DAY, EVENTS, events, table
from lumenloom.sources import aws, cloud, devices

HOUR = DAY // 24
#: Rows of one file at most, also of a user or nation that has most of them.
_FILE = 1000
_S = "at_us // 1000000 * 1000000"
_MS = "at_us // 1000 * 1000"
_ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"


def _lines(spark: SparkSession, sf_dir: str, expr: str, *keep: str) -> DataFrame:
    return events(spark, sf_dir).select(*keep, F.expr(expr).alias("value"))


def _file_of(key: str, most: int = _FILE) -> Column:
    """A bounded number of rows with one ``key``, a whole number, belong to one file."""
    return F.floor(F.col(key) / most).alias("file")


def vpc_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["version", "account-id", "interface-id", "srcaddr", "dstaddr", "pkt-srcaddr", "srcport", "dstport", "protocol", "packets", "bytes", "start", "end", "action", "log-status", "flow-direction"]
    line = "concat_ws(' ', '5', user_id, concat('eni-', event_id), '10.0.0.1', '10.0.0.2', if(event_id % 2 = 0, '-', '10.0.0.9'), '443', event_id, if(event_id % 3 = 0, '6', '99'), '-', cast(value * 100 as bigint), at_us div 1000000, at_us div 1000000 + 60, 'ACCEPT', 'OK', if(event_id % 5 = 0, 'ingress', 'egress'))"
    out = aws.vpc_lines(_lines(spark, sf_dir, line), "value", fields)
    names = {"network.interface.name": "nic", "cloud.account.id": "account", "source.address": "src", "network.local.address": "local", "destination.port": "port", "network.transport": "transport", "aws.vpc.flow.packets": "packets", "aws.vpc.flow.start": "start", "network.io.direction": "direction"}
    return out.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


VPC_FLOW = f"""
SELECT 'eni-' || event_id AS nic, user_id::VARCHAR AS account, CASE WHEN event_id % 2 = 0 THEN '10.0.0.1' ELSE '10.0.0.9' END AS src, CASE WHEN event_id % 2 = 1 THEN '10.0.0.1' END AS local, event_id AS port,
CASE WHEN event_id % 3 = 0 THEN 'tcp' ELSE '99' END AS transport, CAST(NULL AS BIGINT) AS packets, at_us // 1000000 AS start, CASE WHEN event_id % 5 = 0 THEN 'receive' ELSE 'transmit' END AS direction FROM {EVENTS}
"""


def s3_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat('owner b', user_id, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] 10.0.0.1 - R', event_id, ' REST.GET.OBJECT k/', event_type, ' \"GET /k/', event_type, '?x=1 HTTP/1.1\" 200 - ', event_id, ' 100 7 - \"-\" \"agent x\" - host= SigV4 ECDHE AuthHeader h.org TLSv1.2')"
    return aws.s3_access(_lines(spark, sf_dir, line)).select("request_id", "bucket", "key", "requester", "status", "bytes_sent", "turnaround_ms", "user_agent", "tls_version", "method", "target", "ts_us")


S3_ACCESS = f"SELECT 'R' || event_id AS request_id, 'b' || user_id AS bucket, 'k/' || event_type AS key, NULL AS requester, CAST(200 AS BIGINT) AS status, event_id AS bytes_sent, CAST(NULL AS BIGINT) AS turnaround_ms, 'agent x' AS user_agent, 'TLSv1.2' AS tls_version, 'GET' AS method, '/k/' || event_type || '?x=1' AS target, {_S} AS ts_us FROM {EVENTS}"


def elb_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    alb = f"concat('https ', {_ISO}, ' app/lb', user_id, '/1 10.0.0.1:', user_id, ' 10.0.0.2:80 0.001 0.5 0.0 200 200 34 ', event_id, ' \"GET https://h.org:443/', event_type, ' HTTP/1.1\" \"curl/8\" TLS12 TLSv1.2 arn:tg \"Root=1\" \"h.org\" \"arn:c\" 0 ', {_ISO}, ' \"forward\" \"-\" \"-\"')"
    clb = f"concat({_ISO}, ' lb', user_id, ' 10.0.0.1:', user_id, ' - -1 -1 -1 503 0 0 ', event_id, ' \"GET http://h.org:80/', event_type, ' HTTP/1.1\" \"-\" - -')"
    nlb = f"concat('tls 2.0 ', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), ' net/lb', user_id, '/1 L1 10.0.0.1:', user_id, ' 10.0.0.2:80 5 2 98 ', event_id, ' - arn:c - ECDHE tlsv12 - h.org')"
    out = aws.elb_access(_lines(spark, sf_dir, f"CASE event_id % 3 WHEN 0 THEN {alb} WHEN 1 THEN {clb} ELSE {nlb} END"))
    return out.select("sent_bytes", "kind", "lb", "client_port", "status", "target_secs", "method", "url", "domain", "protocol", "ts_us")


ELB_ACCESS = f"""
SELECT event_id AS sent_bytes, CASE event_id % 3 WHEN 0 THEN 'alb' WHEN 1 THEN 'clb' ELSE 'nlb' END AS kind, CASE event_id % 3 WHEN 0 THEN 'app/lb' || user_id || '/1' WHEN 1 THEN 'lb' || user_id ELSE 'net/lb' || user_id || '/1' END AS lb, CAST(user_id AS INTEGER) AS client_port,
CAST(CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 503 END AS BIGINT) AS status, CASE event_id % 3 WHEN 0 THEN 0.5::DOUBLE END AS target_secs, CASE WHEN event_id % 3 < 2 THEN 'GET' END AS method,
CASE event_id % 3 WHEN 0 THEN 'https://h.org:443/' || event_type WHEN 1 THEN 'http://h.org:80/' || event_type END AS url, CASE WHEN event_id % 3 <> 1 THEN 'h.org' END AS domain, CASE event_id % 3 WHEN 0 THEN 'TLSv1.2' WHEN 2 THEN 'tlsv12' END AS protocol,
CASE WHEN event_id % 3 < 2 THEN at_us ELSE {_S} END AS ts_us FROM {EVENTS}
"""


def trail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of up to 50 events each, exploded."""
    one = f"concat('{{\"eventTime\":\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '\",\"eventSource\":\"ssm.amazonaws.com\",\"eventName\":\"Get', event_type, '\",\"awsRegion\":\"eu\",\"eventID\":\"', event_id, '\",\"recipientAccountId\":\"', user_id, '\",\"userIdentity\":{{\"type\":\"IAMUser\",\"userName\":\"u', user_id, '\"}},\"tlsDetails\":{{\"tlsVersion\":\"TLSv1.3\"}},\"requestParameters\":{{\"name\":\"n\"}}}}')"
    docs = events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 50).alias("g")).agg(F.concat(F.lit('{"Records":['), F.array_join(F.collect_list(F.expr(one)), ","), F.lit("]}")).alias("value"))
    return aws.trail_events(docs).select(F.col("event_id").cast("long").alias("event_id"), "rpc_method", "account_id", "principal", "tls_version", "parameters", "error_code", "ts_us")


TRAIL_EVENTS = f"SELECT event_id, 'ssm.amazonaws.com/Get' || event_type AS rpc_method, user_id::VARCHAR AS account_id, 'u' || user_id AS principal, '1.3' AS tls_version, '{{\"name\":\"n\"}}' AS parameters, NULL AS error_code, {_S} AS ts_us FROM {EVENTS}"


def waf_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    waf = "concat('{\"timestamp\":', at_us div 1000, ',\"action\":\"BLOCK\",\"terminatingRuleId\":\"r', event_id, '\",\"httpRequest\":{\"clientIp\":\"10.0.0.1\",\"uri\":\"/', event_type, '\",\"args\":\"\",\"httpVersion\":\"HTTP/2.0\",\"httpMethod\":\"GET\"}}')"
    fw = "concat('{\"firewall_name\":\"f', event_id, '\",\"event_timestamp\":\"', at_us div 1000000, '\",\"event\":{\"event_type\":\"netflow\",\"src_ip\":\"10.0.0.1\",\"src_port\":', user_id, ',\"proto\":\"TCP\",\"netflow\":{\"bytes\":', event_id, '}}}')"
    a = aws.waf_events(_lines(spark, sf_dir, waf)).select(F.col("rule").alias("name"), "path", "http_version", "query", F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("int").alias("port"), "ts_us")
    b = aws.firewall_events(_lines(spark, sf_dir, fw)).select(F.col("firewall").alias("name"), F.col("transport").alias("path"), F.lit(None).cast("string").alias("http_version"), F.lit(None).cast("string").alias("query"), "bytes", F.col("source_port").alias("port"), "ts_us")
    return a.unionByName(b)


WAF_FIREWALL = f"""
SELECT 'r' || event_id AS name, '/' || event_type AS path, '2.0' AS http_version, NULL AS query, CAST(NULL AS BIGINT) AS bytes, CAST(NULL AS INTEGER) AS port, {_MS} AS ts_us FROM {EVENTS}
UNION ALL SELECT 'f' || event_id, 'tcp', NULL, NULL, event_id, user_id, {_S} FROM {EVENTS}
"""


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription documents of one user and day each, several if there are many events, exploded and routed by group and stream."""
    one = "concat('{\"id\":\"', event_id, '\",\"timestamp\":', at_us div 1000, ',\"message\":\"m ', event_type, '\"', if(event_id % 2 = 0, ',\"extractedFields\":{\"@aws.account\":\"42\"}', ''), '}')"
    docs = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("at_us") / DAY).alias("d"), _file_of("event_id")).agg(F.array_join(F.collect_list(F.expr(one)), ",").alias("x"))
    head = F.when(F.col("user_id") % 9 == 0, "CONTROL_MESSAGE").otherwise("DATA_MESSAGE")
    docs = docs.select(F.concat(F.lit('{"messageType":"'), head, F.lit('","owner":"o'), F.col("user_id"), F.lit('","logGroup":"/aws/g'), F.col("user_id") % 4, F.lit('","logStream":"s'), F.col("user_id"), F.lit('","logEvents":['), F.col("x"), F.lit("]}")).alias("value"))
    patterns = spark.createDataFrame([("*", "*", "any"), ("/aws/g1", "*", "one"), ("/aws/*", "s2*", "two"), ("/aws/g*", "*", "g")], "group_pattern string, stream_pattern string, target string").where("target <> 'any' OR group_pattern = '*'")
    out = aws.route_streams(aws.subscription_events(docs), patterns)
    return out.select(F.col("event_id").cast("long").alias("event_id"), "account_id", "log_group", "log_stream", "body", "target", "ts_us")


SUBSCRIPTIONS = f"""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '42' ELSE 'o' || user_id END AS account_id, '/aws/g' || user_id % 4 AS log_group, 's' || user_id AS log_stream, 'm ' || event_type AS body,
CASE WHEN user_id % 4 = 1 THEN 'one' ELSE 'g' END AS target, {_MS} AS ts_us FROM {EVENTS} WHERE user_id % 9 <> 0
"""


def openvpn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status files in both forms built from customers, read back, joined with routes and summed up."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("f"), "c_custkey", F.concat(F.lit("u"), F.col("c_custkey") % 40).alias("name"), F.concat(F.lit("10.0.0."), F.col("c_nationkey"), F.lit(":"), F.col("c_custkey")).alias("addr"))
    new = F.col("f") % 2 == 0
    at = F.timestamp_seconds(F.lit(1_780_272_000) + F.col("c_custkey") * 5_003)
    since = F.when(F.col("c_custkey") % 3 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at, "EEE MMM d HH:mm:ss yyyy"))
    row = F.when(new, F.concat_ws(",", F.lit("CLIENT_LIST"), "name", "addr", F.lit("v"), F.col("c_custkey").cast("string"), F.lit("7"), since, F.lit("1"), F.lit("UNDEF"))).otherwise(F.concat_ws(",", "name", "addr", F.col("c_custkey").cast("string"), F.lit("7"), since))
    # Two routes each, of which the second is the smaller text.
    one = lambda letter: F.when(new, F.concat_ws(",", F.lit("ROUTING_TABLE"), F.concat(F.lit(letter), "c_custkey"), "name", "addr", F.lit("t"))).otherwise(F.concat_ws(",", F.concat(F.lit(letter), "c_custkey"), "name", "addr", F.lit("t")))
    route = F.concat(one("r"), F.lit("\n"), one("a"))
    g = c.groupBy("f", _file_of("c_custkey", _FILE // 2)).agg(F.array_join(F.collect_list(row), "\n").alias("rows"), F.array_join(F.collect_list(route), "\n").alias("routes"))
    text = F.when(new, F.concat(F.lit("TITLE,V\nTIME,2026,1\nHEADER,CLIENT_LIST,x\n"), "rows", F.lit("\n"), "routes", F.lit("\nEND"))).otherwise(F.concat(F.lit("OpenVPN CLIENT LIST\nUpdated,2026\nCommon Name,x\n"), "rows", F.lit("\nROUTING TABLE\nVirtual Address,x\n"), "routes", F.lit("\nGLOBAL STATS\nq,0\n"), F.when(F.col("f") % 5 == 0, "cut").otherwise("END")))
    rows = devices.openvpn_rows(g.select(F.concat_ws("-", "f", "file").alias("path"), text.alias("value")))
    clients = rows.where("kind = 'client'").drop("virtual_address").withColumn("virtual_address", F.lit(None).cast("string"))
    joined = devices.openvpn_routes(clients, rows.where("kind = 'route'"))
    totals = devices.openvpn_totals(joined).select("name", "address", "bytes_received", "bytes_sent", "sessions", "since_us")
    firsts = joined.groupBy("name").agg(F.min("virtual_address").alias("first_route"))
    return totals.join(firsts, "name")


OPENVPN = """
WITH c AS (SELECT 'u' || c_custkey % 40 AS name, '10.0.0.' || c_nationkey AS address, c_custkey FROM customer WHERE c_nationkey % 2 = 0 OR c_nationkey % 5 <> 0)
SELECT name, address, CAST(sum(c_custkey) AS BIGINT) AS bytes_received, 7 * count(*) AS bytes_sent, count(*) AS sessions, (1780272000 + min(c_custkey) * 5003) * 1000000 AS since_us, (SELECT min('r' || d.c_custkey) FROM c d WHERE d.name = c.name) AS first_route FROM c GROUP BY 1, 2
"""


def pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat(if(event_id % 2 = 0, 'some', 'full'), ' avg10=', event_id % 100, '.5 avg60=1.25 avg300=0.00 total=', event_id, if(event_id % 7 = 0, ' extra', ''))"
    return devices.pressure(_lines(spark, sf_dir, line, "event_id"), ["event_id"])


PRESSURE = f"""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'some' ELSE 'full' END AS kind, stat, CAST(CASE stat WHEN 'avg10' THEN event_id % 100 + 0.5 WHEN 'avg60' THEN 1.25 WHEN 'avg300' THEN 0 ELSE event_id END AS DOUBLE) AS value
FROM {EVENTS}, (VALUES ('avg10'), ('avg60'), ('avg300'), ('total')) s(stat) WHERE event_id % 7 <> 0
"""


def pool_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest closed group of a user's tables with a row per event, and sums of named figures."""
    row = "concat(event_id, ' 1 ', if(event_id % 3 = 0, 'O', 'C'), '  ', event_id * 2, ' ', event_id * 3, ' ', event_id * 4)"
    t = events(spark, sf_dir).groupBy("user_id", _file_of("event_id")).agg(F.concat(F.lit("12 1 0x01\ntxg  birth state ndirty nwritten stime\n"), F.array_join(F.collect_list(F.expr(row)), "\n")).alias("value"))
    k = events(spark, sf_dir).groupBy("user_id", _file_of("event_id")).agg(F.concat(F.lit("head\nname type data\n"), F.array_join(F.collect_list(F.concat(F.lit("hits  4 "), "event_id")), "\n"), F.lit("\nbad line")).alias("value"))
    sums = devices.kstat_table(k, ["user_id"]).groupBy("user_id", "name").agg(F.sum("value").cast("long").alias("total")).select("user_id", "total")
    return devices.newest_txg(t, ["user_id"]).join(sums, "user_id", "left")


POOL_TABLES = f"""
SELECT user_id, max(event_id) FILTER (event_id % 3 <> 0) AS txg, 2 * max(event_id) FILTER (event_id % 3 <> 0) AS dirty, 3 * max(event_id) FILTER (event_id % 3 <> 0) AS written, 4 * max(event_id) FILTER (event_id % 3 <> 0) AS sync_ns, CAST(sum(event_id) AS BIGINT) AS total
FROM {EVENTS} GROUP BY 1 HAVING txg IS NOT NULL
"""


def picked_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy("user_id", _file_of("event_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("event_type", F.lit("_"), "event_id"), "cents"))).alias("counters"))
    return devices.picked_statistics(e, ["user_id"], [("^view_", "v"), ("_[0-9]*1$", "one")], 5)


PICKED_COUNTERS = f"""
SELECT user_id, event_type || '_' || event_id AS name, cents AS value, CASE WHEN event_type = 'view' THEN 'v' ELSE 'one' END AS metric FROM {EVENTS} WHERE event_type = 'view' OR event_id % 10 = 1
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type || '_' || event_id) <= 5
"""


def auth0(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = f"concat('{{\"account\":\"', user_id, '\",\"time\":\"2026-01-01T00:00:00Z\",\"detail\":{{\"log_id\":\"', event_id, '\",\"data\":{{\"type\":\"', elt(cast(event_id % 3 as int) + 1, 'fp', 'w', 's'), '\",\"description\":\"', if(event_id % 2 = 0, event_type, ''), '\"', if(event_id % 5 = 0, '', concat(',\"date\":\"', {_ISO}, '\"')), ',\"user_id\":\"u', user_id, '\"}}}}}}')"
    return cloud.auth0_records(_lines(spark, sf_dir, doc)).select("log_id", "body", "severity_text", "event_type", "user_id", "account_id", "ts_us")


AUTH0 = f"""
SELECT event_id::VARCHAR AS log_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'auth0 ' || CASE event_id % 3 WHEN 0 THEN 'fp' WHEN 1 THEN 'w' ELSE 's' END END AS body, CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' ELSE 'INFO' END AS severity_text,
CASE event_id % 3 WHEN 0 THEN 'fp' WHEN 1 THEN 'w' ELSE 's' END AS event_type, 'u' || user_id AS user_id, user_id::VARCHAR AS account_id, CASE WHEN event_id % 5 = 0 THEN 1767225600000000 ELSE at_us END AS ts_us FROM {EVENTS}
"""


def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = f"concat('{{\"metric\":{{\"type\":\"m/', event_type, '\",\"labels\":{{\"l\":\"', event_id, '\"}}}},\"resource\":{{\"type\":\"gce\",\"labels\":{{\"zone\":\"z', user_id, '\"}}}},\"metricKind\":\"', if(event_id % 2 = 0, 'GAUGE', 'DELTA'), '\",\"points\":[{{\"interval\":{{\"startTime\":\"2026-01-01T00:00:00Z\",\"endTime\":\"', {_ISO}, '\"}},\"value\":{{', if(event_id % 3 = 0, concat('\"int64Value\":\"', event_id, '\"'), '\"doubleValue\":1.5'), '}}}}]}}')"
    out = cloud.series_points(_lines(spark, sf_dir, doc))
    return out.select(F.col("attributes")["l"].cast("long").alias("event_id"), "metric", "kind", "temporality", F.col("resource")["gcp.label.zone"].alias("zone"), F.col("resource")["gcp.resource_type"].alias("resource_type"), "value", "start_us", "ts_us")


SERIES_POINTS = f"""
SELECT event_id, 'm/' || event_type AS metric, CASE WHEN event_id % 2 = 0 THEN 'gauge' ELSE 'sum' END AS kind, CASE WHEN event_id % 2 = 1 THEN 'delta' END AS temporality, 'z' || user_id AS zone, 'gce' AS resource_type,
CAST(CASE WHEN event_id % 3 = 0 THEN event_id ELSE 1.5 END AS DOUBLE) AS value, 1767225600000000 AS start_us, at_us AS ts_us FROM {EVENTS}
"""


def histogram_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", (F.col("event_id") % 4).cast("double").alias("a"), (F.col("user_id") % 3).cast("double").alias("b"), (F.col("event_id") % 5).cast("int").alias("n"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 3).cast("string")), " ")
    return e.select("event_id", text(cloud.linear_bounds(F.col("a"), F.col("b"), F.col("n"))).alias("linear"), text(cloud.exponential_bounds(F.col("a"), F.col("b"), F.col("n"))).alias("exponential"))


HISTOGRAM_BOUNDS = f"""
WITH e AS (SELECT event_id, (event_id % 4)::DOUBLE AS a, (user_id % 3)::DOUBLE AS b, event_id % 5 AS n FROM {EVENTS})
SELECT event_id, CASE WHEN b > 0 THEN array_to_string(list_transform(range(0, n + 1), lambda i: round(a + b * i, 3)::VARCHAR), ' ') END AS linear,
CASE WHEN a > 0 AND b > 1 THEN array_to_string(list_transform(range(0, n + 1), lambda i: round(a * pow(b, i), 3)::VARCHAR), ' ') END AS exponential FROM e
"""


def guests(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = "concat('{\"id\":\"qemu/', event_id, '\",\"type\":\"qemu\",\"node\":\"n', user_id, '\",\"status\":\"', if(event_id % 2 = 0, 'running', 'stopped'), '\",\"mem\":', event_id, ',\"cpu\":0.25}')"
    docs = events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 40).alias("g")).agg(F.concat(F.lit('{"data":['), F.array_join(F.collect_list(F.expr(one)), ","), F.lit("]}")).alias("value"))
    return cloud.guest_points(docs).select("id", "node", "metric", "value")


GUESTS = f"""
SELECT 'qemu/' || event_id AS id, 'n' || user_id AS node, metric, CAST(CASE metric WHEN 'up' THEN 1 - event_id % 2 WHEN 'mem' THEN event_id ELSE 0.25 END AS DOUBLE) AS value FROM {EVENTS}, (VALUES ('up'), ('mem'), ('cpu')) m(metric)
"""


def poll_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a poll takes per group, and where the next one goes on."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("log_group"), F.col("at_us").alias("ts_us"), F.when(F.col("event_id") % 13 != 0, F.col("event_id")).alias("event_id"), F.lit("m").alias("message"))
    half = F.lit(1_704_067_200_000_000 + 20 * DAY)
    state = spark.createDataFrame([("view", 1_704_067_200_000_000 + 5 * DAY), ("click", 1_704_067_200_000_000 + 25 * DAY)], "log_group string, next_us long")
    got = cloud.poll_logs(e, state, half)
    nexts = cloud.next_state(got, e, half)
    return nexts.join(got.groupBy("log_group").agg(F.count("*").alias("taken")), "log_group", "left").select("log_group", "next_us", F.coalesce("taken", F.lit(0)).alias("taken"))


_T0 = 1_704_067_200_000_000
POLL_LOGS = f"""
WITH g AS (SELECT event_type AS log_group, at_us, CASE event_type WHEN 'view' THEN {_T0 + 5 * DAY} WHEN 'click' THEN {_T0 + 25 * DAY} ELSE 0 END AS s, event_id % 13 <> 0 AS ok FROM {EVENTS})
SELECT log_group, coalesce(max(at_us) FILTER (ok AND at_us >= s AND at_us < {_T0 + 20 * DAY}) + 1000, {_T0 + 20 * DAY}) AS next_us, count(*) FILTER (ok AND at_us >= s AND at_us < {_T0 + 20 * DAY}) AS taken FROM g GROUP BY 1
"""


def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.concat(F.when(F.col("event_id") % 2 == 0, "/A/").otherwise("/a/"), F.col("event_id")).alias("path"), F.col("at_us").alias("created_us"), "event_id")
    seen = e.where("event_id % 3 = 0 AND created_us < 1704067200000000 + 15 * 86400000000").select(F.lower("path").alias("path"), "created_us")
    return cloud.not_seen(e, seen, F.lit(_T0 + 20 * DAY), overlap_us=5 * DAY, skew_us=HOUR).select("event_id", "path")


NEW_FILES = f"""
WITH s AS (SELECT max(at_us) AS m FROM {EVENTS} WHERE event_id % 3 = 0 AND at_us < {_T0 + 15 * DAY})
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/A/' ELSE '/a/' END || event_id AS path FROM {EVENTS}, s WHERE at_us >= m - {5 * DAY} AND at_us <= {_T0 + 20 * DAY + HOUR} AND NOT (event_id % 3 = 0 AND at_us < {_T0 + 15 * DAY})
"""

QUERIES = {
    "vpc_flow": vpc_flow, "s3_access": s3_access, "elb_access": elb_access, "trail_events": trail_events, "waf_firewall": waf_firewall, "subscriptions": subscriptions, "openvpn": openvpn, "pressure": pressure, "pool_tables": pool_tables,
    "picked_counters": picked_counters, "auth0": auth0, "series_points": series_points, "histogram_bounds": histogram_bounds, "guests": guests, "poll_logs": poll_logs, "new_files": new_files,
}
ORACLES = {
    "vpc_flow": VPC_FLOW, "s3_access": S3_ACCESS, "elb_access": ELB_ACCESS, "trail_events": TRAIL_EVENTS, "waf_firewall": WAF_FIREWALL, "subscriptions": SUBSCRIPTIONS, "openvpn": OPENVPN, "pressure": PRESSURE, "pool_tables": POOL_TABLES,
    "picked_counters": PICKED_COUNTERS, "auth0": AUTH0, "series_points": SERIES_POINTS, "histogram_bounds": HISTOGRAM_BOUNDS, "guests": GUESTS, "poll_logs": POLL_LOGS, "new_files": NEW_FILES,
}
