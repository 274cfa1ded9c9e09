"""Records that services hand out: identity events, log polls, time series, guest lists, watched folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import levels, times
from lumenloom.operators.enrich import small
from lumenloom.operators.timeseries import changes

# -- identity provider events


def auth0_records(df: DataFrame, document: str = "value") -> DataFrame:
    """One log record per event envelope: failures ERROR, warnings WARN, others INFO; the event's date, else the envelope's."""
    d = F.from_json(F.col(document), "struct<account:string,region:string,time:string,detail:struct<log_id:string,data:struct<date:string,type:string,description:string,connection:string,client_name:string,ip:string,user_agent:string,user_id:string,user_name:string,log_id:string>>>")
    rows = df.select(d.alias("d")).where("d.detail.data.type IS NOT NULL")
    x = lambda k: F.nullif(F.col(f"d.detail.data.{k}"), F.lit(""))
    kind = F.col("d.detail.data.type")
    level = F.when(kind.startswith("f"), levels.ERROR).when(kind.startswith("w"), levels.WARN).otherwise(levels.INFO)
    return rows.select(
        F.coalesce(x("description"), F.concat(F.lit("auth0 "), kind)).alias("body"), level.alias("severity_number"), levels.text(level).alias("severity_text"),
        F.coalesce(times.rfc3339_micros(x("date")), times.rfc3339_micros(F.col("d.time"))).alias("ts_us"), kind.alias("event_type"),
        F.coalesce(F.nullif("d.detail.log_id", F.lit("")), x("log_id")).alias("log_id"), x("user_id").alias("user_id"), x("user_name").alias("user_name"), x("ip").alias("client_address"),
        x("connection").alias("connection"), x("client_name").alias("client_name"), x("user_agent").alias("user_agent"), F.col("d.account").alias("account_id"), F.col("d.region").alias("region"),
    )


# -- polls that go on where they stopped


def poll_logs(events: DataFrame, state: DataFrame, until_us: Column, group: str = "log_group") -> DataFrame:
    """Events from each group's next_us (0 where it has none) to before ``until_us``; those without time, id or message are left out."""
    good = events.where("ts_us IS NOT NULL AND event_id IS NOT NULL AND message IS NOT NULL").where(F.col("ts_us") < until_us)
    known = state.select(F.col(group).alias("_g"), "next_us")
    return good.join(known, good[group] == F.col("_g"), "left").where(F.col("ts_us") >= F.coalesce("next_us", F.lit(0))).drop("_g", "next_us")


def next_state(polled: DataFrame, groups: DataFrame, until_us: Column, group: str = "log_group") -> DataFrame:
    """group and next_us: a millisecond after its last event, or ``until_us`` where nothing came."""
    last = polled.groupBy(group).agg(F.max("ts_us").alias("_l"))
    return groups.select(group).distinct().join(last, group, "left").select(group, F.coalesce(F.col("_l") + 1000, until_us).alias("next_us"))


def not_seen(found: DataFrame, seen: DataFrame, now_us: Column, overlap_us: int = 2_000_000, skew_us: int = 60_000_000) -> DataFrame:
    """Files (path, created_us) that are new: not before the newest seen time less ``overlap_us``, not in ``seen`` by (lower-case path, time), not from the future.

    The newest time is one row, which every file is joined to.
    """
    high = seen.agg(F.max("created_us").alias("_high"))
    key = seen.select(F.lower("path").alias("_p"), F.col("created_us").alias("_c")).distinct()
    fresh = found.crossJoin(F.broadcast(high)).where((F.col("created_us") >= F.coalesce("_high", F.lit(0)) - overlap_us) & (F.col("created_us") <= now_us + skew_us))
    return fresh.join(key, (F.lower("path") == F.col("_p")) & (F.col("created_us") == F.col("_c")), "left_anti").drop("_high").dropDuplicates(["path", "created_us"])


# -- time series of a monitoring service


def series_points(df: DataFrame, document: str = "value") -> DataFrame:
    """A row per point: metric, resource (type, labels, system and user labels), attributes, kind, value and its interval."""
    d = F.from_json(F.col(document), """struct<metric:struct<type:string,labels:map<string,string>>,resource:struct<type:string,labels:map<string,string>>,metadata:struct<systemLabels:map<string,string>,userLabels:map<string,string>>,
    metricKind:string,valueType:string,unit:string,points:array<struct<interval:struct<startTime:string,endTime:string>,value:struct<int64Value:string,doubleValue:double,boolValue:boolean>>>>""")
    rows = df.select(d.alias("d")).where("d.metric.type IS NOT NULL").select("d", F.explode("d.points").alias("p"))
    none = F.create_map().cast("map<string,string>")
    label = lambda c, prefix: F.transform_keys(F.coalesce(F.col(c), none), lambda k, _: F.concat(F.lit(prefix), k))
    resource = F.map_concat(F.create_map(F.lit("gcp.resource_type"), F.col("d.resource.type")), label("d.resource.labels", "gcp.label."), label("d.metadata.systemLabels", "gcp.system."), label("d.metadata.userLabels", "gcp.user."))
    kind = F.when(F.col("d.metricKind") == "GAUGE", "gauge").otherwise("sum")
    temporality = F.when(F.col("d.metricKind") == "DELTA", "delta").when(F.col("d.metricKind") == "CUMULATIVE", "cumulative")
    value = F.coalesce(F.col("p.value.int64Value").try_cast("double"), F.col("p.value.doubleValue"), F.col("p.value.boolValue").cast("int").cast("double"))
    return rows.select(
        F.col("d.metric.type").alias("metric"), F.col("d.unit").alias("unit"), kind.alias("kind"), temporality.alias("temporality"), F.coalesce("d.metric.labels", none).alias("attributes"), resource.alias("resource"),
        value.alias("value"), times.rfc3339_micros(F.col("p.interval.startTime")).alias("start_us"), times.rfc3339_micros(F.col("p.interval.endTime")).alias("ts_us"),
    )


def linear_bounds(offset: Column, width: Column, n: Column) -> Column:
    """n + 1 bounds offset + width * i; null for a width that is not above 0, or a number or offset below 0."""
    return F.when((width > 0) & (n >= 0) & (offset >= 0), F.transform(F.sequence(F.lit(0), n), lambda i: offset + width * i))


def exponential_bounds(scale: Column, growth: Column, n: Column) -> Column:
    """n + 1 bounds scale * growth^i; null unless scale > 0, growth > 1 and n >= 0."""
    return F.when((scale > 0) & (growth > 1) & (n >= 0), F.transform(F.sequence(F.lit(0), n), lambda i: scale * F.pow(growth, i)))


_BUCKETS = "struct<explicitBuckets:struct<bounds:array<double>>,linearBuckets:struct<numFiniteBuckets:int,offset:double,width:double>,exponentialBuckets:struct<numFiniteBuckets:int,scale:double,growthFactor:double>>"


def distribution_points(df: DataFrame, document: str = "value") -> DataFrame:
    """metric, attributes, count, sum, bounds, counts, start_us and ts_us of the distributions in monitoring series.

    Bounds stay as they are, though the source counts a value at a bound above
    it. Counts are filled up with zeros to one more than there are bounds. Points
    without a distribution or without readable buckets are left out.
    """
    value = f"struct<distributionValue:struct<count:string,mean:double,bucketOptions:{_BUCKETS},bucketCounts:array<string>>>"
    d = F.from_json(F.col(document), f"struct<metric:struct<type:string,labels:map<string,string>>,points:array<struct<interval:struct<startTime:string,endTime:string>,value:{value}>>>")
    rows = df.select(d.alias("d")).select("d.metric", F.explode("d.points").alias("p")).select("metric", "p.interval", F.col("p.value.distributionValue").alias("v"))
    o = F.col("v.bucketOptions")
    linear, growing = o["linearBuckets"], o["exponentialBuckets"]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    bounds = F.coalesce(
        o["explicitBuckets"]["bounds"], linear_bounds(zero(linear["offset"]), linear["width"], linear["numFiniteBuckets"]),
        exponential_bounds(growing["scale"], growing["growthFactor"], growing["numFiniteBuckets"]),
    )
    rows = rows.select("metric", "interval", "v", bounds.alias("bounds")).where("bounds IS NOT NULL")
    counts = F.transform(F.coalesce("v.bucketCounts", F.array()), lambda c: c.cast("long"))
    counts = F.concat(counts, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.size("bounds") + 1 - F.size(counts), F.lit(0))))
    n = F.coalesce(F.col("v.count").cast("long"), F.lit(0))
    return rows.select(
        F.col("metric.type").alias("metric"), F.coalesce("metric.labels", F.create_map().cast("map<string,string>")).alias("attributes"), n.alias("count"), (n * zero(F.col("v.mean"))).alias("sum"), "bounds", counts.alias("counts"),
        times.rfc3339_micros(F.col("interval.startTime")).alias("start_us"), times.rfc3339_micros(F.col("interval.endTime")).alias("ts_us"),
    )


# -- metric queries

#: Queries of one call, and about how many series number their calls in one task.
PER_CALL, SERIES_AT_ONCE = 500, 50_000


def query_calls(series: DataFrame, stats: Sequence[str], keys: Sequence[str] = ("account", "region", "tier"), per_call: int = PER_CALL, at_once: int = SERIES_AT_ONCE) -> DataFrame:
    """A row per series and statistic, with the call (part and number) of its account, region and tier that asks for it.

    series: keys, namespace, name, dimensions (text). Calls hold ``per_call``
    queries but for the last of a part; a large group is numbered in parts.
    """
    keys = list(keys)
    n = series.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / at_once).alias("_parts"))
    rows = series.join(small(n), keys).withColumn("part", F.pmod(F.xxhash64("namespace", "name", "dimensions"), F.col("_parts"))).drop("_parts")
    w = Window.partitionBy(*keys, "part").orderBy("namespace", "name", "dimensions")
    rows = rows.withColumn("_n", F.row_number().over(w) - 1)
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, stats))).alias("_s", "stat"))
    return rows.withColumn("call", F.floor((F.col("_n") * len(stats) + F.col("_s")) / per_call)).drop("_n", "_s")


def metric_gauges(points: DataFrame, read_us: str = "read_us") -> DataFrame:
    """One gauge per series, statistic and time: of windows that overlap the value that was read last; the metric is amazonaws.com/<namespace>/<name>."""
    keys = ["account", "region", "namespace", "name", "dimensions", "stat", "ts_us"]
    best = points.groupBy(*keys).agg(F.max_by("value", F.struct(read_us, "value")).alias("value"))
    return best.select("account", "region", F.concat_ws("/", F.lit("amazonaws.com"), "namespace", "name").alias("metric"), "dimensions", "stat", "ts_us", "value")


# -- virtual machines


def guest_points(df: DataFrame, document: str = "value") -> DataFrame:
    """A row per resource and figure of cluster resource lists; up is 1 for running, online and available ones."""
    d = F.from_json(F.col(document), "struct<data:array<struct<id:string,type:string,node:string,name:string,status:string,vmid:bigint,cpu:double,maxcpu:bigint,mem:bigint,maxmem:bigint,disk:bigint,maxdisk:bigint,uptime:bigint,netin:bigint,netout:bigint>>>")
    rows = df.select(F.explode(d["data"]).alias("r")).select("r.*")
    wide = rows.withColumn("up", F.coalesce(F.col("status").isin("running", "online", "available"), F.lit(False)).cast("long"))
    names = ["up", "cpu", "maxcpu", "mem", "maxmem", "disk", "maxdisk", "uptime", "netin", "netout"]
    typed = wide.select("id", "type", "node", "name", *[F.col(n).cast("double").alias(n) for n in names])
    return typed.unpivot(["id", "type", "node", "name"], names, "metric", "value").where("value IS NOT NULL")


def guest_changes(facts: DataFrame, at_us: str = "ts_us", tie: str = "seq") -> DataFrame:
    """Facts (vmid, fact, value) where they first appear or change."""
    return changes(facts, ["vmid", "fact"], at_us, tie, "value")


def address_list(addresses: Column) -> Column:
    """Sorted, distinct, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(addresses)), ",")


def redfish_points(df: DataFrame, document: str = "value") -> DataFrame:
    """Temperatures, fans and power of chassis documents as hw.* points."""
    d = F.from_json(F.col(document), "struct<Id:string,Temperatures:array<struct<Name:string,ReadingCelsius:double,Status:struct<Health:string>>>,Fans:array<struct<Name:string,Reading:double,Status:struct<Health:string>>>,PowerControl:array<struct<Name:string,PowerConsumedWatts:double>>>")
    rows = df.select(d.alias("d"))
    cells = lambda c, metric, value: F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.struct(F.lit(metric).alias("metric"), x["Name"].alias("name"), x[value].cast("double").alias("value")))
    kind = "array<struct<metric:string,name:string,value:double>>"
    every = F.concat(cells("d.Temperatures", "hw.temperature", "ReadingCelsius").cast(kind), cells("d.Fans", "hw.fan.speed", "Reading").cast(kind), cells("d.PowerControl", "hw.power", "PowerConsumedWatts").cast(kind))
    return rows.select(F.col("d.Id").alias("id"), F.explode(every).alias("p")).select("id", "p.*").where("value IS NOT NULL")
