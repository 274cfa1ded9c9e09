"""Names, identities and lookups added to records; each is one projection, or one join with a small table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import bodies, maps, network
from lumenloom.functions.maps import first_of
from lumenloom.functions.patterns import re2

#: Bytes up to which a lookup table is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def small(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` marked for broadcast if the optimizer's estimate of its size is within ``most`` bytes, else as it is.

    Without access to the plan, as over Spark Connect, Spark decides.
    """
    if not hasattr(table, "_jdf"):
        return table
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= most else table


def container_name(df: DataFrame) -> DataFrame:
    """service.name := container.name where the resource has one."""
    return df.withColumn("resource", maps.overwrite(F.col("resource"), {"service.name": F.nullif(F.col("resource")["container.name"], F.lit(""))}))


def stamped(df: DataFrame, version: str, key: str = "collector.version") -> DataFrame:
    """A version on every resource."""
    return df.withColumn("resource", maps.overwrite(F.col("resource"), {key: F.lit(version)}))


def short_hosts(df: DataFrame) -> DataFrame:
    """host.name cut to its first label, the full name in host.fqdn; addresses, bare names and those with a leading dot stay."""
    name = F.col("resource")["host.name"]
    short = network.short_host(name)
    changed = short != name
    return df.withColumn("resource", maps.overwrite(F.col("resource"), {"host.name": F.when(changed, short), "host.fqdn": F.when(changed, name)}))


def look(key: str) -> Column:
    """The record's value, else its resource's."""
    return first_of(F.col("attributes")[key], F.col("resource")[key])


def identity_fill(df: DataFrame, host_sources: tuple[str, ...] = ("k8s.node.name", "host.id", "cloud.account.id"), services: dict[str, str] | None = None) -> DataFrame:
    """Missing host.name from the first source that has a value, missing service.name by the record's kind, empty audit bodies from method and resource."""
    names = {"event": "k8s-events", "pod": "k8s-pods", "audit": "gcp-audit"} | (services or {})
    audit = F.coalesce(look("cloud.resource_id").startswith("cloudaudit"), F.lit(False)) | look("gcp.audit.method.name").isNotNull()
    kind = F.when(look("k8s.event.reason").isNotNull(), names["event"]).when(look("k8s.pod.phase").isNotNull(), names["pod"]).when(audit, names["audit"])
    res = F.col("resource")
    missing = lambda key: F.coalesce(res[key], F.lit("")) == ""
    text = F.nullif(bodies.joined(look("gcp.audit.method.name"), look("gcp.audit.resource.name")), F.lit(""))
    body = F.when(audit & (F.coalesce(F.col("body"), F.lit("")) == "") & text.isNotNull(), text).otherwise(F.col("body"))
    host = F.coalesce(*[look(k) for k in host_sources])
    filled = maps.overwrite(res, {"host.name": F.when(missing("host.name"), host), "service.name": F.when(missing("service.name"), kind)})
    return df.withColumns({"body": body, "resource": filled})


def aws_source_tags(df: DataFrame, format_col: str = "encoding_format") -> DataFrame:
    """log.source, event.category, cloud.provider and cloud.region of AWS records, in order of the rules; error codes raise to WARN."""
    a, r = F.col("attributes"), F.col("resource")
    group, stream = r["cloudwatch.log.group.name"], r["cloudwatch.log.stream"]
    fmt = F.col(format_col)
    source = F.when(fmt == "aws.cloudtrail", "aws.cloudtrail").when(fmt == "aws.s3access", "aws.s3access").when(fmt == "aws.elbaccess", "aws.elb").otherwise(a["log.source"])
    source = F.coalesce(source, F.when(group.rlike(re2("^/aws/eks/")), "aws.eks"), F.when(F.coalesce(group, F.lit("")) != "", "aws.cloudwatch"))
    df = df.withColumn("_source", source)
    s = F.col("_source")
    category = (
        F.when(s == "aws.cloudtrail", "audit")
        .when(s.isin("aws.s3access", "aws.elb"), "access")
        .when((s == "aws.eks") & stream.startswith("kube-apiserver-audit"), "audit")
        .when(s == "aws.cloudwatch", "application")
        .when(s == "aws.eks", F.coalesce(F.nullif(a["event.category"], F.lit("")), F.lit("application")))
    )
    warn = (s == "aws.cloudtrail") & (F.coalesce(a["aws.error.code"], F.lit("")) != "")
    region = r["aws.region"]
    return df.withColumns({
        "attributes": maps.overwrite(a, {"log.source": s, "event.category": category}),
        "resource": maps.fill(r, {"cloud.provider": F.when(region.isNotNull(), "aws"), "cloud.region": region}),
        "severity_number": F.when(warn, 13).otherwise(F.col("severity_number")),
        "body": F.when(s == "aws.cloudtrail", F.replace(a["rpc.method"], F.lit("/"), F.lit(" "))).otherwise(F.col("body")),
    }).drop("_source")


def region_of_zone(zone: Column) -> Column:
    """europe-west1-b is in europe-west1."""
    return F.regexp_replace(zone, r"^(.+)-[^-]$", "$1")


def gcp_source_tags(df: DataFrame) -> DataFrame:
    a, r = F.col("attributes"), F.col("resource")
    source = F.when(r["cloud.resource_id"].startswith("cloudaudit"), "gcp.audit").otherwise(a["log.source"])
    kind = r["gcp.resource_type"]
    source = F.coalesce(source, F.when(kind == "cloud_run_revision", "gcp.cloudrun"), F.when(kind.isin("http_load_balancer", "l7_lb_rule", "https_lb_rule"), "gcp.lb"))
    df = df.withColumn("_source", source)
    s = F.col("_source")
    category = F.when(s == "gcp.audit", "audit").when(s == "gcp.lb", "access").when(s == "gcp.cloudrun", "application")
    region = first_of(r["gcp.label.location"], r["cloud.region"], r["gcp.label.region"], region_of_zone(r["gcp.label.zone"]))
    account = first_of(r["gcp.label.project_id"], r["cloud.account.id"], r["gcp.project"])
    return df.withColumns({
        "attributes": maps.overwrite(a, {"log.source": s, "event.category": category}),
        "resource": maps.overwrite(r, {"cloud.provider": F.lit("gcp"), "service.name": r["gcp.label.service_name"], "cloud.region": region, "cloud.account.id": account}),
    }).drop("_source")


def azure_source_tags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "attributes": maps.overwrite(F.col("attributes"), {"log.source": F.lit("azure.activity"), "event.category": F.lit("audit")}),
        "resource": maps.overwrite(F.col("resource"), {"cloud.provider": F.lit("azure")}),
    })


#: Old names and the official ones.
RENAMES = [
    ("file.size_final", "file.size"), ("common_name", "user.name"), ("interface", "network.interface.name"), ("client.mac", "client.mac.address"),
    ("client.ip", "client.address"), ("k8s.pod.phase", "k8s.pod.status.phase"), ("k8s.pod.restarts", "k8s.container.restart_count"),
    ("otelcol.component", "otel.component.name"), ("otelcol.component.id", "otel.component.name"), ("original_message", "log.record.original"),
    ("flow.src_as", "source.as.number"), ("flow.dst_as", "destination.as.number"), ("winlog.user.identifier", "user.id"), ("winlog.process.pid", "process.pid"),
    ("winlog.process.thread.id", "thread.id"), ("aws.region", "cloud.region"), ("machine.type", "host.type"), ("host.display_name", "host.name"),
    ("gcp.project", "cloud.account.id"), ("deployment.environment", "deployment.environment.name"), ("rpc.system", "rpc.system.name"),
    ("rpc.response.status_code", "rpc.status_code"), ("code.lineno", "code.line.number"), ("code.function", "code.function.name"),
]


def official_names(attributes: Column, more: tuple[tuple[str, str], ...] = ()) -> Column:
    """Old attribute names made official ones; an official name that is there keeps its value.

    real_address is split into client.address and client.port, code.filepath
    into file and line, rpc.service goes in front of rpc.method, and
    winlog.computer_name is dropped.
    """

    def split(attributes: Column) -> Column:
        real, path, service = attributes["real_address"], attributes["code.filepath"], attributes["rpc.service"]
        has_line = path.rlike(r"^.+:\d+$")
        found = {
            "client.address": network.host(real),
            "client.port": network.port(real).cast("string"),
            "code.file.path": F.when(has_line, F.regexp_extract(path, r"^(.+):\d+$", 1)).otherwise(path),
            "code.line.number": F.when(attributes["code.lineno"].isNull(), F.nullif(F.regexp_extract(path, r":(\d+)$", 1), F.lit(""))),
        }
        a = network.let(maps.without(attributes, ["real_address", "code.filepath", "rpc.service", "winlog.computer_name"]), lambda rest: maps.fill(rest, found))
        return maps.overwrite(a, {"rpc.method": F.when(service != "", F.concat(service, F.lit("/"), attributes["rpc.method"]))})

    return maps.rename(network.let(attributes, split), [*RENAMES, *more])


# -- lookups


def asset_lookup(df: DataFrame, assets: DataFrame, mac: str) -> DataFrame:
    """Adds asset_hostname and asset_location by MAC address in any form; of rows for one address the last by ``row_no`` wins."""
    key = network.mac(F.col("mac"))
    unique = assets.select(key.alias("_mac"), F.col("hostname"), F.col("location"), F.col("row_no")).where("_mac IS NOT NULL").groupBy("_mac").agg(F.max_by(F.struct("hostname", "location"), "row_no").alias("_a"))
    joined = df.withColumn("_mac", network.mac(F.col(mac))).join(small(unique), "_mac", "left")
    return joined.select(*df.columns, F.nullif("_a.hostname", F.lit("")).alias("asset_hostname"), F.nullif("_a.location", F.lit("")).alias("asset_location"))


def port_alias(df: DataFrame, aliases: DataFrame, host: str, port: str) -> DataFrame:
    """Adds alias by exact host and port, else by the short host name; of several short matches the smallest full name's.

    Case and blanks at the ends of hosts and ports do not matter, on either side.
    """
    plain = lambda c: F.lower(F.trim(F.col(c)))
    aliases = aliases.select(plain("hostname").alias("hostname"), plain("port").alias("port"), "alias")
    own = df.columns
    df = df.withColumns({"_host": plain(host), "_port": plain(port)})
    host, port = "_host", "_port"
    exact = aliases.groupBy("hostname", "port").agg(F.min("alias").alias("_exact"))
    by_short = aliases.groupBy(network.short_host(F.col("hostname")).alias("_short"), F.col("port").alias("_near_port")).agg(F.min_by("alias", "hostname").alias("_near"))
    one = df.join(small(exact), (df[host] == exact.hostname) & (df[port] == exact.port), "left").select(*[df[c] for c in df.columns], "_exact")
    two = one.withColumn("_s", network.short_host(F.col(host)))
    both = two.join(small(by_short), (two._s == by_short._short) & (two[port] == by_short._near_port), "left")
    return both.select(*own, F.coalesce("_exact", "_near").alias("alias"))


# -- addresses in text

#: Fixed patterns: addresses of hosts in the forms that logs have, most telling first.
MAC_FORMS = [
    r"(?i)\b00:03:00:01:((?:[0-9a-f]{2}:){5}[0-9a-f]{2})\b",
    r"(?i)\b00:01:00:01:(?:[0-9a-f]{2}:){4}((?:[0-9a-f]{2}:){5}[0-9a-f]{2})\b",
    r"(?i)(?<![0-9a-f:])((?:[0-9a-f]{2}:){5}[0-9a-f]{2})(?![0-9a-f:])",
    r"(?i)(?<![0-9a-f-])((?:[0-9a-f]{2}-){5}[0-9a-f]{2})(?![0-9a-f-])",
    r"(?i)(?<![0-9a-f.])([0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4})(?![0-9a-f.])",
]
EUI64 = r"(?i)(?<![0-9a-f:])(?:[0-9a-f:]*:)?([0-9a-f]{1,4}):([0-9a-f]{1,2})ff:fe([0-9a-f]{2}):([0-9a-f]{1,4})(?![0-9a-f:])"


def macs_in(text: Column) -> Column:
    """Distinct addresses as aa:bb:cc:dd:ee:ff, by form and then by place."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), 1), network.mac) for p in MAC_FORMS]
    a, b, c, d = (F.regexp_extract_all(text, F.lit(EUI64), i) for i in (1, 2, 3, 4))
    flipped = F.transform(
        F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")),
        lambda z: F.concat(
            F.lower(F.lpad(F.hex(F.conv(F.substring(F.lpad(z.a, 4, "0"), 1, 2), 16, 10).try_cast("long").bitwiseXOR(F.lit(2).cast("long"))), 2, "0")),
            F.lower(F.substring(F.lpad(z.a, 4, "0"), 3, 2)), F.lower(F.lpad(z.b, 2, "0")), F.lower(z.c), F.lower(F.lpad(z.d, 4, "0")),
        ),
    )
    return F.array_distinct(F.array_compact(F.concat(*found[:2], F.transform(flipped, network.mac), *found[2:])))


NO_HOST = ("0.0.0.0", "127.0.0.1", "::", "::1")


def ips_in(text: Column, v6: bool = False) -> Column:
    """Distinct addresses in order of place, IPv4 before IPv6, without the unspecified and the loopback ones."""
    four = F.regexp_extract_all(text, F.lit(rf"(?<![\d.])({network.IPV4})(?![\d.])"), 1)
    if not v6:
        return F.array_distinct(F.array_except(four, F.array(*map(F.lit, NO_HOST))))
    six = F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z:.])([0-9A-Fa-f:]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*)(?![0-9A-Za-z:])"), 1)
    six = F.filter(F.transform(F.filter(six, network.is_address), network.canonical), lambda x: x.isNotNull())
    return F.array_distinct(F.array_except(F.concat(four, six), F.array(*map(F.lit, NO_HOST))))


#: A text in quotes within a JSON document, and the colon behind it if it is a key.
_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*+(:?)'


def leaves(body: Column) -> Column:
    """The texts of a body in their order: of an object or list as JSON all values that are texts, however deep; else the body itself.

    Keys, numbers, truth values and nulls are left out. One scan over the
    document, so its depth has no bound. What looks like JSON but isn't is a text.
    """
    document = F.trim(body)
    nested = (document.startswith("{") | document.startswith("[")) & F.try_parse_json(document).isNotNull()
    text, colon = (F.regexp_extract_all(document, F.lit(_QUOTED), i) for i in (1, 2))
    values = F.filter(F.arrays_zip(text.alias("t"), colon.alias("c")), lambda z: z.c == "")
    # Escapes of all texts are undone at once.
    plain = F.from_json(F.concat(F.lit('["'), F.array_join(F.transform(values, lambda z: z.t), '","'), F.lit('"]')), "array<string>")
    none = F.array().cast("array<string>")
    return F.when(body.isNull(), none).when(~nested, F.array(body)).when(F.size(values) == 0, none).otherwise(plain)


def found_in(values: Column, find: Callable[[Column], Column]) -> Column:
    """What ``find`` gives for each of several texts, each thing once, in order."""
    return F.array_distinct(F.flatten(F.transform(values, lambda x: find(x))))


def address_attribute(df: DataFrame, target: str, find: Callable[[Column], Column] = ips_in, body: bool = True, attributes: Sequence[str] = (), first_only: bool = False) -> DataFrame:
    """Sets the attribute ``target`` to the addresses of the body and of some attributes: all with commas between, or the first.

    find: ips_in, macs_in or another function from a text to an array. Bodies and
    attributes may be JSON documents, see leaves(). The body comes first, then
    the attributes as listed. A record without an address stays as it is.
    """
    own = F.coalesce(F.col("attributes"), maps.empty())
    sources = ([F.col("body")] if body else []) + [own[a] for a in attributes]
    if not sources:
        return df
    found = found_in(F.concat(*[leaves(s) for s in sources]), find)
    value = F.get(found, F.lit(0)) if first_only else F.nullif(F.array_join(found, ","), F.lit(""))
    df = maps.once(df, {"_found": value})
    return df.withColumn("attributes", maps.overwrite(own, {target: F.col("_found")})).drop("_found")


# -- metrics

LOADS = {f"system.cpu.load_average.{m}": f"system.cpu.load_average.normalized.{m}" for m in ("1m", "5m", "15m")}
PER_CPU = {"process.cpu.utilization": "process.cpu.utilization.percpu"}


def normalized_load(points: DataFrame, cpus: int | str) -> DataFrame:
    """Adds points: load per processor, and processor shares times their number. cpus: a number or a column's name."""
    n = F.lit(cpus) if isinstance(cpus, int) else F.col(cpus)
    name = F.lit(None).cast("string")
    for old, new in (LOADS | PER_CPU).items():
        name = F.when(F.col("metric") == old, new).otherwise(name)
    value = F.when(F.col("metric").isin(*LOADS), F.col("value") / n).otherwise(F.col("value") * n)
    more = points.where(F.col("metric").isin(*LOADS, *PER_CPU) & (n > 0)).withColumns({"value": value, "metric": name})
    return points.unionByName(more)


def process_lifetime(points: DataFrame, resource: list[str], at_us: str = "at_us", scrape: str | None = None) -> DataFrame:
    """Adds points per process and scrape: processor time over its age, and bytes of each direction over its age.

    scrape: a column that a scrape's points share, by default their time, as the
    counters of one scrape are summed over states, and never over scrapes. One
    aggregate per resource and scrape, joined to its points of disk.io; processes
    without an age above 0, or which have such points already, get none.
    """
    m = F.col("metric")
    whole, resource = points.columns, [*resource, scrape or at_us]
    cumulative = (F.col("kind") == "sum") & (F.col("temporality") == "cumulative")
    per = points.groupBy(*resource).agg(
        F.max(F.when((m == "process.uptime") & (F.col("kind") == "gauge"), F.col("value"))).alias("_age"),
        F.sum(F.when((m == "process.cpu.time") & cumulative, F.col("value"))).alias("_cpu"),
        F.max(F.when((m == "process.cpu.time") & cumulative, F.col(at_us))).alias("_at"),
        F.max(m == "process.cpu.lifetime.ratio").alias("_has_cpu"),
        F.max(m == "process.disk.lifetime.rate").alias("_has_io"),
    ).where("_age > 0")
    null = F.lit(None).cast("string")
    keys = [c for c in resource if c != at_us]
    cpu = per.where("_cpu IS NOT NULL AND NOT _has_cpu").select(*keys, F.lit("process.cpu.lifetime.ratio").alias("metric"), null.alias("direction"), (F.col("_cpu") / F.col("_age")).alias("value"), F.col("_at").alias(at_us))
    cond = F.lit(True)
    for c in resource:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    ages = per.where("NOT _has_io").select(*resource, "_age")
    joined = points.where((m == "process.disk.io") & cumulative).alias("l").join(ages.alias("r"), cond).select("l.*", "r._age")
    io = joined.select(*keys, F.lit("process.disk.lifetime.rate").alias("metric"), "direction", (F.col("value") / F.col("_age")).alias("value"), at_us)
    more = cpu.unionByName(io).withColumns({"kind": F.lit("gauge"), "temporality": null})
    return points.unionByName(more, allowMissingColumns=True).select(*whole)
