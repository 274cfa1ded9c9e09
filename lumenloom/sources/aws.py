"""Log files that AWS services write: flow, access, trail, firewall and subscription formats.

Readers return rows whose columns carry the official names' last parts as plain
columns; reading is Spark's own, so files are split and columns are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import times
from lumenloom.functions.patterns import captures, group
from lumenloom.operators.enrich import small

#: Flow log fields that are whole numbers, and the attribute of each field.
VPC_INT = ("version", "srcport", "dstport", "protocol", "packets", "bytes", "start", "end")
VPC_NAMES = {
    "account-id": "cloud.account.id", "region": "cloud.region", "srcaddr": "source.address", "dstaddr": "destination.address", "srcport": "source.port", "dstport": "destination.port",
    "vpc-id": "aws.vpc.id", "subnet-id": "aws.vpc.subnet.id", "instance-id": "host.id", "az-id": "aws.az.id", "interface-id": "network.interface.name", "tgw-id": "aws.tgw.id",
    "tgw-attachment-id": "aws.tgw.attachment.id", "tgw-src-vpc-id": "aws.tgw.source.vpc.id", "tgw-dst-vpc-id": "aws.tgw.destination.vpc.id", "tgw-src-subnet-id": "aws.tgw.source.vpc.subnet.id",
    "tgw-dst-subnet-id": "aws.tgw.destination.vpc.subnet.id", "tgw-src-eni": "aws.tgw.source.eni.id", "tgw-dst-eni": "aws.tgw.destination.eni.id", "tgw-src-az-id": "aws.tgw.source.az.id",
    "tgw-dst-az-id": "aws.tgw.destination.az.id", "tgw-pair-attachment-id": "aws.tgw.attachment.pair.id", "type": "network.type", "flow-direction": "network.io.direction",
    "action": "aws.vpc.flow.action", "log-status": "aws.vpc.flow.status", "tcp-flags": "network.tcp.flags", "sublocation-type": "aws.sublocation.type", "sublocation-id": "aws.sublocation.id",
    "pkt-src-aws-service": "aws.vpc.flow.source.service", "pkt-dst-aws-service": "aws.vpc.flow.destination.service", "traffic-path": "aws.vpc.flow.traffic_path",
    "ecs-cluster-arn": "aws.ecs.cluster.arn", "ecs-cluster-name": "aws.ecs.cluster.name", "ecs-container-instance-arn": "aws.ecs.container.instance.arn",
    "ecs-container-instance-id": "aws.ecs.container.instance.id", "ecs-container-id": "aws.ecs.container.id", "ecs-second-container-id": "aws.ecs.second.container.id",
    "ecs-service-name": "aws.ecs.service.name", "ecs-task-definition-arn": "aws.ecs.task.definition.arn", "ecs-task-arn": "aws.ecs.task.arn", "ecs-task-id": "aws.ecs.task.id",
    "reject-reason": "aws.vpc.flow.reject_reason", "version": "aws.vpc.flow.log.version", "packets": "aws.vpc.flow.packets", "bytes": "aws.vpc.flow.bytes", "start": "aws.vpc.flow.start",
    "end": "aws.vpc.flow.end", "protocol": "network.transport",
}
TRANSPORTS = {1: "icmp", 6: "tcp", 17: "udp", 58: "ipv6-icmp"}


def _vpc_value(field: str, c: Column) -> Column:
    c = F.nullif(c.cast("string"), F.lit("-"))
    if field == "flow-direction":
        return F.when(c == "ingress", "receive").when(c == "egress", "transmit").otherwise("unknown")
    if field == "type":
        return F.lower(c)
    if field == "protocol":
        out = c
        for n, name in TRANSPORTS.items():
            out = F.when(c == str(n), name).otherwise(out)
        return out
    return c.try_cast("long") if field in VPC_INT else c


def vpc_records(flows: DataFrame) -> DataFrame:
    """Columns named as in the flow log's header, ``-`` for missing, as attributes; unknown columns keep their name.

    Packet addresses go before interface addresses as source and destination,
    which then stand in network.local.address and network.peer.address.
    """
    have = {c.replace("_", "-"): c for c in flows.columns}
    out = {}
    for field, column in have.items():
        if field not in ("pkt-srcaddr", "pkt-dstaddr", "srcaddr", "dstaddr"):
            out[VPC_NAMES.get(field, field)] = _vpc_value(field, F.col(f"`{column}`"))
    for own, packet, name, middle in (("srcaddr", "pkt-srcaddr", "source.address", "network.local.address"), ("dstaddr", "pkt-dstaddr", "destination.address", "network.peer.address")):
        a = _vpc_value(own, F.col(f"`{have[own]}`")) if own in have else None
        p = _vpc_value(packet, F.col(f"`{have[packet]}`")) if packet in have else None
        if a is not None or p is not None:
            out[name] = F.coalesce(*[x for x in (p, a) if x is not None])
        if a is not None and p is not None:
            out[middle] = F.when(a != p, a)
    return flows.select(*[v.alias(k) for k, v in out.items()])


def read_vpc_text(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated files whose first line names the columns."""
    return vpc_records(spark.read.csv(path, sep=" ", header=True, nullValue="-"))


def read_vpc_parquet(spark: SparkSession, path: str) -> DataFrame:
    return vpc_records(spark.read.parquet(path))


def vpc_lines(df: DataFrame, line: str, fields: list[str]) -> DataFrame:
    """Flow log lines inside other records, as subscription filters send them; fields: the format's names in order."""
    parts = F.split(F.trim(F.col(line)), " +")
    return vpc_records(df.where(F.size(parts) == len(fields)).select(*[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(fields)]))


# -- access logs

S3 = (
    r'^(\S+) (\S+) \[([^\]]+)\] (\S+) (\S+) (\S+) (\S+) (\S+) ("(?:[^"]*)"|-) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) ("(?:[^"]*)"|-) ("(?:[^"]*)"|-) (\S+)(?: (\S+) (\S+) (\S+) (\S+) (\S+) (\S+)(?: .*)?)?$'
)
S3_FIELDS = (
    "bucket_owner", "bucket", "time", "source_address", "requester", "request_id", "operation", "key", "request", "status", "error_code", "bytes_sent", "object_size", "total_ms",
    "turnaround_ms", "referer", "user_agent", "version_id", "host_id", "signature_version", "cipher_suite", "authentication", "host_header", "tls_version",
)
_S3_NUMBERS = ("status", "bytes_sent", "object_size", "total_ms", "turnaround_ms")


def s3_access(df: DataFrame, line: str = "value") -> DataFrame:
    """Columns of S3 access lines and ts_us; lines of another form are left out."""
    caps = df.withColumn("_c", captures(F.col(line), S3)).where(F.size("_c") > 1)
    value = lambda i: F.nullif(F.regexp_replace(group(F.col("_c"), i), '^"|"$', ""), F.lit("-"))
    cols = {n: value(i + 1) for i, n in enumerate(S3_FIELDS)}
    cols = {n: c.try_cast("long") if n in _S3_NUMBERS else c for n, c in cols.items()}
    request = cols.pop("request")
    return caps.select(
        *[c.alias(n) for n, c in cols.items() if n != "time"],
        times.micros(cols["time"], "dd/MMM/yyyy:HH:mm:ss Z").alias("ts_us"),
        F.substring_index(request, " ", 1).alias("method"),
        F.nullif(F.regexp_extract(request, r"^\S+ (\S+)", 1), F.lit("")).alias("target"),
    )


ALB = (
    r'^(https?|h2|grpcs|wss?) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) "([^"]*)" "([^"]*)" (\S+) (\S+) (\S+) "([^"]*)" "([^"]*)" "([^"]*)" (\S+) (\S+) "([^"]*)" "([^"]*)" "([^"]*)"(?: .*)?$'
)
ALB_FIELDS = (
    "type", "time", "lb", "client", "target", "request_secs", "target_secs", "response_secs", "status", "target_status", "received_bytes", "sent_bytes", "request", "user_agent", "cipher", "protocol",
    "target_group_arn", "trace_id", "domain", "certificate_arn", "rule_priority", "created", "actions", "redirect_url", "error_reason",
)
CLB = r'^(\d{4}-\d{2}-\d{2}T\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+|-) (\d+|-) (\d+) (\d+) "([^"]*)" "([^"]*)" (\S+) (\S+)$'
CLB_FIELDS = ("time", "lb", "client", "target", "request_secs", "target_secs", "response_secs", "status", "target_status", "received_bytes", "sent_bytes", "request", "user_agent", "cipher", "protocol")
NLB = r"^(tls) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+|-) (\d+|-) (\d+|-) (\d+|-) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+)(?: .*)?$"
NLB_FIELDS = (
    "type", "version", "time", "lb", "listener", "client", "target", "connection_ms", "handshake_ms", "received_bytes", "sent_bytes", "alert", "certificate_arn", "certificate_serial", "cipher", "protocol",
    "named_group", "domain",
)
ELB_COLUMNS = ("kind", "lb", "client_address", "client_port", "status", "target_status", "received_bytes", "sent_bytes", "target_secs", "method", "url", "user_agent", "domain", "cipher", "protocol", "target_group_arn", "ts_us")


def elb_access(df: DataFrame, line: str = "value") -> DataFrame:
    """Columns of load balancer lines; the first field tells application (alb), network (nlb) and classic (clb) ones apart."""
    text = F.col(line)
    kind = F.when(text.rlike("^(?:https?|h2|grpcs|wss?) "), "alb").when(text.startswith("tls "), "nlb").when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), "clb")
    caps = F.when(F.col("kind") == "alb", captures(text, ALB)).when(F.col("kind") == "nlb", captures(text, NLB)).when(F.col("kind") == "clb", captures(text, CLB))
    rows = df.withColumn("kind", kind).withColumn("_c", caps).where(F.size("_c") > 1)
    forms = {"alb": ALB_FIELDS, "nlb": NLB_FIELDS, "clb": CLB_FIELDS}

    def value(name: str) -> Column:
        out = F.lit(None).cast("string")
        for k, fields in forms.items():
            if name in fields:
                out = F.when(F.col("kind") == k, group(F.col("_c"), fields.index(name) + 1)).otherwise(out)
        return F.nullif(out, F.lit("-"))

    request, secs = value("request"), value("target_secs").try_cast("double")
    made = {
        "kind": F.col("kind"), "lb": value("lb"),
        "client_address": F.regexp_replace(F.regexp_replace(value("client"), r":\d+$", ""), r"^\[|\]$", ""), "client_port": F.regexp_extract(value("client"), r":(\d+)$", 1).try_cast("int"),
        **{n: value(n).try_cast("long") for n in ("status", "target_status", "received_bytes", "sent_bytes")}, "target_secs": F.when(secs >= 0, secs),
        "method": F.nullif(F.nullif(F.substring_index(request, " ", 1), F.lit("-")), F.lit("")), "url": F.nullif(F.regexp_extract(request, r"^\S+ (\S+)", 1), F.lit("")),
        **{n: value(n) for n in ("user_agent", "domain", "cipher", "protocol", "target_group_arn")},
        "ts_us": times.rfc3339_micros(value("time")),
    }
    return rows.select(*[made[c].alias(c) for c in ELB_COLUMNS])


# -- JSON logs

TRAIL = """struct<eventVersion:string,eventTime:string,eventSource:string,eventName:string,awsRegion:string,sourceIPAddress:string,userAgent:string,eventID:string,
eventType:string,recipientAccountId:string,errorCode:string,errorMessage:string,readOnly:boolean,requestParameters:map<string,string>,
userIdentity:struct<type:string,principalId:string,arn:string,accountId:string,accessKeyId:string,userName:string,invokedBy:string>,
tlsDetails:struct<tlsVersion:string,cipherSuite:string,clientProvidedHostHeader:string>>"""


def trail_events(df: DataFrame, document: str = "value") -> DataFrame:
    """One row per event of trail files: ``{"Records": [...]}``, or an event alone; times in microseconds."""
    many = F.from_json(F.col(document), f"struct<Records:array<{TRAIL}>>")["Records"]
    one = F.from_json(F.col(document), TRAIL)
    rows = df.select(F.explode(F.coalesce(many, F.array(one))).alias("e")).where("e.eventName IS NOT NULL")
    who = F.col("e.userIdentity")
    return rows.select(
        F.concat(F.col("e.eventSource"), F.lit("/"), F.col("e.eventName")).alias("rpc_method"),
        F.col("e.awsRegion").alias("region"), F.coalesce("e.recipientAccountId", who["accountId"]).alias("account_id"), F.col("e.sourceIPAddress").alias("source_address"),
        F.col("e.userAgent").alias("user_agent"), F.col("e.eventID").alias("event_id"), who["type"].alias("identity_type"), who["arn"].alias("principal_arn"),
        F.coalesce(who["userName"], who["invokedBy"], who["principalId"]).alias("principal"), F.col("e.errorCode").alias("error_code"),
        F.regexp_replace("e.tlsDetails.tlsVersion", "^TLSv", "").alias("tls_version"), F.to_json("e.requestParameters").alias("parameters"),
        times.rfc3339_micros(F.col("e.eventTime")).alias("ts_us"),
    )


def trail_digests(df: DataFrame, document: str = "value") -> DataFrame:
    """account_id, bucket, object and the listed log files of digest documents."""
    d = F.from_json(F.col(document), "struct<awsAccountId:string,digestStartTime:string,digestEndTime:string,digestS3Bucket:string,digestS3Object:string,logFiles:array<struct<s3Bucket:string,s3Object:string,hashValue:string>>>")
    return df.select(d.alias("d")).where("d.digestS3Object IS NOT NULL").select(F.col("d.awsAccountId").alias("account_id"), F.col("d.digestS3Object").alias("digest"), F.size("d.logFiles").alias("n_files"), F.explode_outer("d.logFiles").alias("f")).select("account_id", "digest", "n_files", "f.s3Bucket", "f.s3Object", "f.hashValue")


def waf_events(df: DataFrame, document: str = "value") -> DataFrame:
    """Web firewall records: action, rule, request fields."""
    d = F.from_json(F.col(document), "struct<timestamp:bigint,webaclId:string,terminatingRuleId:string,terminatingRuleType:string,action:string,httpSourceName:string,httpRequest:struct<clientIp:string,country:string,uri:string,args:string,httpVersion:string,httpMethod:string,requestId:string>>")
    return df.select(d.alias("d")).where("d.action IS NOT NULL").select(
        F.col("d.action").alias("action"), F.col("d.terminatingRuleId").alias("rule"), F.col("d.terminatingRuleType").alias("rule_type"), F.col("d.webaclId").alias("acl"),
        F.col("d.httpRequest.clientIp").alias("client_address"), F.col("d.httpRequest.country").alias("country"), F.col("d.httpRequest.httpMethod").alias("method"),
        F.col("d.httpRequest.uri").alias("path"), F.nullif("d.httpRequest.args", F.lit("")).alias("query"), F.regexp_replace("d.httpRequest.httpVersion", "^HTTP/", "").alias("http_version"),
        (F.col("d.timestamp") * 1000).alias("ts_us"),
    )


def firewall_events(df: DataFrame, document: str = "value") -> DataFrame:
    """Network firewall records: alerts and flows."""
    d = F.from_json(F.col(document), "struct<firewall_name:string,availability_zone:string,event_timestamp:string,event:struct<event_type:string,src_ip:string,src_port:int,dest_ip:string,dest_port:int,proto:string,flow_id:bigint,alert:struct<action:string,signature_id:bigint,signature:string,severity:int>,netflow:struct<pkts:bigint,bytes:bigint>>>")
    e = "d.event."
    return df.select(d.alias("d")).where("d.event IS NOT NULL").select(
        F.col("d.firewall_name").alias("firewall"), F.col("d.availability_zone").alias("zone"), F.col(e + "event_type").alias("event_type"), F.col(e + "src_ip").alias("source_address"),
        F.col(e + "src_port").alias("source_port"), F.col(e + "dest_ip").alias("destination_address"), F.col(e + "dest_port").alias("destination_port"), F.lower(e + "proto").alias("transport"),
        F.col(e + "alert.action").alias("action"), F.col(e + "alert.signature").alias("signature"), F.col(e + "netflow.bytes").alias("bytes"), F.col(e + "netflow.pkts").alias("packets"),
        (F.col("d.event_timestamp").try_cast("long") * 1_000_000).alias("ts_us"),
    )


def subscription_events(df: DataFrame, document: str = "value") -> DataFrame:
    """One row per log event of subscription documents; control messages, and documents without owner or group, are left out.

    Account and region that the filter has extracted go before the document's owner.
    """
    d = F.from_json(F.col(document), "struct<messageType:string,owner:string,logGroup:string,logStream:string,logEvents:array<struct<id:string,timestamp:bigint,message:string,extractedFields:map<string,string>>>>")
    rows = df.select(d.alias("d")).where("d.messageType = 'DATA_MESSAGE' AND d.owner <> '' AND d.logGroup <> ''")
    rows = rows.select(F.col("d.owner").alias("owner"), F.col("d.logGroup").alias("log_group"), F.col("d.logStream").alias("log_stream"), F.explode("d.logEvents").alias("e"))
    x = F.col("e.extractedFields")
    return rows.select(
        F.coalesce(F.nullif(x["@aws.account"], F.lit("")), F.col("owner")).alias("account_id"), F.nullif(x["@aws.region"], F.lit("")).alias("region"),
        "log_group", "log_stream", F.col("e.id").alias("event_id"), F.col("e.message").alias("body"), (F.col("e.timestamp") * 1000).alias("ts_us"),
    )


def route_streams(df: DataFrame, patterns: DataFrame, group_col: str = "log_group", stream_col: str = "log_stream") -> DataFrame:
    """Adds target: of the patterns (group_pattern, stream_pattern, target; ``*`` for any run) that fit, the most specific one's.

    More specific is the longer pattern without its stars, group before stream;
    ties go to the smaller target. Distinct (group, stream) pairs are matched,
    not rows, and the winners are joined back.
    """
    def as_regex(c: Column) -> Column:
        return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(c, r"([.^$+?{}\[\]()|\\])", r"\\$1"), r"\*", ".*"), F.lit("$"))

    weigh = lambda c: F.length(F.replace(c, F.lit("*"), F.lit("")))
    p = patterns.select(as_regex(F.col("group_pattern")).alias("_g"), as_regex(F.col("stream_pattern")).alias("_s"), "target", weigh(F.col("group_pattern")).alias("_wg"), weigh(F.col("stream_pattern")).alias("_ws"))
    pairs = df.select(group_col, stream_col).distinct()
    fits = pairs.join(small(p), F.rlike(F.col(group_col), F.col("_g")) & F.rlike(F.col(stream_col), F.col("_s")))
    best = fits.groupBy(group_col, stream_col).agg(F.min(F.struct((-F.col("_wg")).alias("a"), (-F.col("_ws")).alias("b"), "target")).alias("_b"))
    best = best.select(F.col(group_col).alias("_gc"), F.col(stream_col).alias("_sc"), F.col("_b.target").alias("target"))
    return df.join(best, df[group_col].eqNullSafe(F.col("_gc")) & df[stream_col].eqNullSafe(F.col("_sc")), "left").drop("_gc", "_sc")
